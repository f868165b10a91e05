"""Formatted text takes patterns instead of folds; what the patterns don't tell still takes the fold, with the same result."""

import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import constants as K
from codeloom.functions import gotext as G
from codeloom.functions.brackets import AT_ONCE, flat, unflat

LISTS = {
    "func F(g func(a, b T, f func(x, y int) (m, n R)) (p, q *T, e error)) error": ("func F(g func(a T, b T, f func(x int, y int) (m R, n R)) (p *T, q *T, e error)) error", True),
    "func(int, *T) (string, error)": ("func(int, *T) (string, error)", True),
    # The shared type holds a bracket, the list is not formatted, a part has no name, a bracket has no partner.
    "func(a, b func(int) error)": ("func(a func(int) error, b func(int) error)", False),
    "func(a,b T)": ("func(a T, b T)", False),
    "func(a, b T, f func(\n\tc,\n\td T,\n))": ("func(a T, b T, f func(c T, d T))", False),
    "func(a, b int, c)": ("func(a int, b int, c )", False),
    "func(a, b struct{X, Y int}, m Map[K, V])": ("func(a struct{X, Y int}, b struct{X, Y int}, m Map[K, V])", False),
    "func(a, b T, f func(c, d T)": ("func(a, b T, f func(c T, d T)", False),
}


def test_lists_of_function_types(spark):
    told = G._shared_types(F.col("t")).isNotNull()
    rows = spark.createDataFrame([(t,) for t in LISTS], "t string").select("t", G.expand_func_types(F.col("t")).alias("got"), told.alias("told")).collect()
    assert {r.t: (r.got, r.told) for r in rows} == LISTS


@pytest.mark.parametrize("depth", [1, AT_ONCE, AT_ONCE + 1, 3 * AT_ONCE])
def test_brackets_of_any_depth_are_hidden(spark, depth):
    inner = "[a, {b;" * depth + "c" + "}]" * depth
    texts = [f"f({inner}, d), e", f"f({inner}, d", f"{inner})), x(y, z)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", flat(F.col("t")).alias("flat"), unflat(flat(F.col("t"))).alias("back")).collect()
    assert {r.t: r.back for r in rows} == {t: t for t in texts}
    shown = {r.t: "".join(c for c in r.flat if c in "()[]{},;") for r in rows}
    assert shown[texts[0]] == "(),"
    assert shown[texts[1]] == "("


def test_types_with_and_without_foreign_names(spark):
    want = {"func(a *T, b ...U) map[string]V": "func(a *p$1.T, b ...p$1.U) map[string]p$1.V", "[]q.T": "[]m/q.T", "func(a K, b T) x1": "func(a K, b p$1.T) p$1.x1", "...T": "[]p$1.T"}
    params = F.when(F.col("t").contains("K"), F.array(F.lit("K"))).otherwise(F.array().cast("array<string>"))
    rows = spark.createDataFrame([(t, "p$1", {"q": "m/q"}) for t in want], "t string, p string, q map<string,string>").withColumn("k", params)
    assert {r.t: r.got for r in rows.select("t", G.qualify_type(F.col("t"), F.col("q"), F.col("p"), F.col("k")).alias("got")).collect()} == want


def test_short_expressions(spark):
    want = {"x": ["xx"], "q.Y": ["xq.Y"], '"a"': ['l"a"'], "a + 1": ["xa", "l1", "o+"], "a +": None, "+ a": ["xa", "u+"], "F(a)": ["xa", "cF"], "a b c": None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", K.postfix(F.col("t")).alias("n")).collect()
    assert {r.t: None if r.n is None else [n.k + n.v for n in r.n] for r in rows} == want


def test_deep_signatures_take_patterns(spark):
    """Twenty thousand formatted signatures of 40 levels; a fold over their brackets takes several times as long."""
    deep = "func(a, b T, f " * 40 + "int" + ") (m, n R)" * 40
    text = F.concat(F.lit("func F"), F.col("id").cast("string"), F.lit(f"(g {deep}) error"))
    start = time.time()
    got = spark.range(0, 20_000, 1, 8).select(flat(G.expand_func_types(text)).alias("t")).agg(F.min(F.length("t")).alias("low"), F.count("t").alias("n")).first()
    assert time.time() - start < 15
    assert got.n == 20_000 and got.low == len("func F0(g ") + len("func(a T, b T, f " * 40 + "int" + ") (m R, n R)" * 40) + len(") error")
