"""Costs of deep signatures and of settling import names."""

import time

from pyspark.sql import functions as F

from codeloom.functions import gotext as G
from codeloom.operators import extract as X
from codeloom.plans.star_values import value_source
from codeloom.sources.corpus import with_package_path
from codeloom.sources.index_store import written
from source_rows import SOURCE


def test_signatures_of_many_levels_cost_a_pass_per_bracket(spark):
    """Two hundred signatures of 120 nested function types; looking at the whole text again at each level takes minutes."""
    deep = "func(a, b T, f " * 120 + "int" + ") (m, n R)" * 120
    rows = spark.createDataFrame([(f"func F{n}(g {deep}) error",) for n in range(200)], "text string").repartition(8)
    start = time.time()
    got = rows.select(G.expand_func_types(F.col("text")).alias("text")).collect()
    assert time.time() - start < 20
    apart = "func(a T, b T, f " * 120 + "int" + ") (m R, n R)" * 120
    assert {r.text for r in got} == {f"func F{n}(g {apart}) error" for n in range(200)}


def test_parsed_rows_lie_still_where_no_import_has_an_odd_name(spark):
    files = [("p", "example.com/p", f"a{n}/a.go", f"/p/a{n}/a.go", f'package a{n}\n\nimport "example.com/p/a{n + 1}"\n\nvar V{n} a{n + 1}.T\n') for n in range(300)]
    parsed = written(X.parse_files(with_package_path(spark.createDataFrame(files, SOURCE))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 << 10))
    try:
        named = X.with_aliases(parsed)
        plan = named._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert named.filter("size(aliases) = 1").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_files_with_deep_signatures_are_dealt_out(spark, tmp_path):
    """The tables are small and the work on their text is not: the files lie in as many partitions as a shuffle has."""
    tables = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(n, f"N{n}", n % 5) for n in range(25)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_size int", [(k, "x", "B", 1 + k % 50) for k in range(400)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    source = value_source(spark, str(tmp_path))
    sizes = [r["n"] for r in source.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 400
