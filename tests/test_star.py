"""References derived from the tables: the joins behind them run once, on narrow rows."""

import pytest

from codeloom.operators import compose as C
from codeloom.operators.resolve import resolve_uses
from codeloom.operators.uses import used_globals, used_types
from codeloom.plans.star import star_facts, star_sql, stored_facts
from codeloom.plans.star_queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Keys repeat and are null in every table; package 1 stands twice."""
    folder = str(tmp_path_factory.mktemp("star"))
    rows = {
        "nation": ([(n, f"N{n}", n % 2) for n in range(25)] + [(1, "N1B", 0), (None, "NULL", 1), (3, None, 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(c, c % 25) for c in range(12)] + [(3, 4), (5, None), (None, 1)], "c_custkey bigint, c_nationkey int"),
        "part": ([(p, f"part {p}", f"B{p % 3}", p % 50) for p in range(140)] + [(7, "again", "B9", 8), (34, None, None, None), (None, "x", "y", 1)], "p_partkey bigint, p_name string, p_brand string, p_size int"),
        "orders": ([(o, o % 14) for o in range(60)] + [(9, 2), (11, None), (None, 3)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(i % 63, (i * 7) % 145, i % 4) for i in range(400)] + [(None, 3, 1), (4, None, 1), (4, 5, None), (4, 5, None)], "l_orderkey bigint, l_partkey bigint, l_linenumber int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_references_are_those_of_the_definition(spark, tables):
    columns = ["project", "pkg_path", "file_path", "pos", "kind", "target_pkg", "target_name", "fq_name", "ext_type", "ext_value", "ext_is_const"]
    want = sorted(map(repr, star_sql(spark, tables, f"SELECT {', '.join(columns)} FROM uses").collect()))
    assert len(want) > 300
    for facts in (star_facts(spark, tables), stored_facts(spark, tables)):
        assert sorted(map(repr, facts.use_ref.select(*columns).collect())) == want


@pytest.mark.parametrize("name", ["compose_context", "serve_requests", "file_info", "export_json", "project_report", "has_content"])
def test_references_are_joined_once(spark, tables, name):
    """What looks at the references several times reads the stored ones; the largest table is not joined again for each."""
    assert not any("lineitem" in path for path in QUERIES[name](spark, tables).inputFiles())


def test_keys_of_items_are_not_shuffled(spark, tables):
    assert C.local_items(star_facts(spark, tables)).columns == ["project", "file_path", "section", "ord", "name", "text", "at"]


def test_types_are_made_distinct_once(spark, tables):
    facts = stored_facts(spark, tables)
    plan = used_types(facts)._jdf.queryExecution().optimizedPlan().toString()
    # One for the values, one for their declarations, one for each file's values, and one for all types.
    assert sum("Aggregate [" in line for line in plan.splitlines()) == 4
    assert used_types(facts).count() == used_types(facts).distinct().count() > 0


@pytest.mark.parametrize("name", ["project_json", "project_context_json", "prompt_messages"])
def test_entries_of_a_document_lie_still(spark, tables, name):
    """Only the first path of each project, whose size is known, is sent; the entries are not shuffled for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")
    try:
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [project" in plan and "SortMergeJoin" not in plan


def _exchanges(df) -> list[str]:
    """The plan from the result down: its shuffles and its lists that are begun ahead of one."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line or "partial_collect_list" in line]


@pytest.mark.parametrize("name", ["compose_context", "file_info", "project_report"])
def test_rows_reach_their_file_as_they_are(spark, tables, name):
    """Lists are begun behind the last shuffle: ahead of it, hardly two rows of a task are of one file."""
    assert "partial_collect_list" in _exchanges(QUERIES[name](spark, tables))[0]


def test_uses_are_shuffled_by_name_only(spark, tables):
    """The grouping of repeated uses has no shuffle of its own ahead of the one that brings them to their declarations."""
    facts = stored_facts(spark, tables)
    for df in (resolve_uses(facts), used_globals(facts)):
        assert not any("Exchange" in line and "ext_type" in line.split("REPARTITION")[0].split("ENSURE")[0] for line in _exchanges(df))
