"""Hot keys, stored tables, refresh, and loading from files."""

import pytest
from pyspark.sql import functions as F

from codeloom import extract, load_modules, load_source_corpus
from codeloom.operators.extract import parse_files
from codeloom.operators.resolve import resolve_uses
from codeloom.operators.uses import used_functions, used_globals, used_types
from codeloom.schemas import Facts
from codeloom.sources import corpus, index_store


def test_everything_resolves_the_same_when_hot_names_are_split(spark):
    """A hot name used by every file: split by adaptive execution, it gives what the plain plan gives."""
    names = "project string, pkg_path string, file_path string, "
    uses = spark.range(600).select(
        F.lit("p").alias("project"), F.lit("m/a").alias("pkg_path"), F.concat(F.lit("/f"), F.col("id") % 50).alias("file_path"), F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "type").when(F.col("id") % 3 == 1, "call").otherwise("value").alias("kind"),
        F.when(F.col("id") % 2 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("N"), F.col("id") % 90)).alias("target_name"),
    ).withColumn("target_pkg", F.lit("m/b")).withColumn("fq_name", F.concat(F.lit("m/b."), "target_name"))
    decls = spark.range(60).select(F.lit("p").alias("project"), F.lit("m/b").alias("pkg_path"), F.lit("/b").alias("file_path"), F.col("id").alias("pos"),
                                   F.when(F.col("id") == 0, "Hot").otherwise(F.concat(F.lit("N"), "id")).alias("name")).withColumn("fq_name", F.concat(F.lit("m/b."), "name"))
    facts = Facts.from_tables(
        go_file=spark.createDataFrame([], names + "package_name string, imports array<string>"),
        decl_func=decls, decl_struct=decls.withColumn("name", F.col("fq_name")), decl_iface=decls.limit(0), decl_global=decls, use_ref=uses,
    )
    steps = (resolve_uses, used_types, used_functions, used_globals)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plain = [sorted(map(str, s(facts).collect())) for s in steps]
    assert all(plain)
    small = {"enabled": "true", "skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.0", "advisoryPartitionSizeInBytes": "1k", "autoBroadcastJoinThreshold": "-1"}
    for key, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{key}", value)
    try:
        assert [sorted(map(str, s(facts).collect())) for s in steps] == plain
    finally:
        for key in small:
            spark.conf.unset(f"spark.sql.adaptive.{key}")


FILES = {
    "go.mod": "module example.com/top\n\ngo 1.22\n",
    "main.go": "package main\n\nimport \"example.com/top/lib\"\n\nfunc main() {\n\tlib.Run()\n}\n",
    "main_test.go": "package main\n\nfunc helper() {}\n",
    "lib/lib.go": "package lib\n\n// Run runs.\nfunc Run() {}\n",
    "vendor/x/x.go": "package x\n",
    "testdata/y.go": "package y\n",
    "_old/z.go": "package z\n",
    "nested/go.mod": "module example.com/inner // own\n",
    "nested/deep/d.go": "package deep\n",
    "notes.txt": "no code",
}


@pytest.fixture()
def tree(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "root")


def test_load_from_folder(spark, tree, tmp_path):
    files, modules = load_source_corpus(spark, tree), load_modules(spark, tree)
    assert sorted(r.file_path.removeprefix(tree) for r in files.select("file_path").collect()) == ["/lib/lib.go", "/main.go", "/nested/deep/d.go"]
    index = extract(files, modules, folder=str(tmp_path / "index"))
    out = {r.file_path.removeprefix(tree): (r.project.removeprefix(tree), r.pkg_path) for r in index.facts.go_file.collect()}
    assert out == {
        "/main.go": ("", "example.com/top"), "/lib/lib.go": ("", "example.com/top/lib"), "/nested/deep/d.go": ("/nested", "example.com/inner/deep"),
    }
    text = {r.file_path.removeprefix(tree): r.text for r in index.context().collect()}["/main.go"]
    assert text.endswith("  Function: example.com/top/lib.Run\n    Comment: Run runs.\n    Signature: ()\n")


def test_a_root_below_an_odd_folder_and_files_outside_modules(spark, tmp_path, monkeypatch):
    root = tmp_path / "vendor" / "_a b%+c"
    for name, text in {"in/go.mod": "module example.com/in\n", "in/x.go": "package x\n", "loose/l.go": "package l\n", "in/vendor/v.go": "package v\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    monkeypatch.chdir(root)
    files = load_source_corpus(spark, str(root) + "/")
    index = extract(files, load_modules(spark, str(root)), folder=str(tmp_path / "index"))
    assert [r.file_path for r in index.facts.go_file.collect()] == [f"{root}/in/x.go"]
    assert [(r.project, r.file_path, r.error) for r in index.errors().collect()] == [(None, f"{root}/loose/l.go", "no module")]
    assert index.status(spark.createDataFrame([(f"{root}/in",), ("/none",)], "project string")).filter("status = 'ok'").count() == 1


def test_errors_are_kept_aside(spark):
    rows = [("a", "package a\n\nvar s = \"{\"\n"), ("b", ""), ("c", "func x() {}\n"), ("d", "package d\n\nfunc x() {\n"), ("e", None), ("f", "// package f\n")]
    good, bad = corpus.quarantine(spark.createDataFrame(rows, "file_path string, content string"))
    assert [r.file_path for r in good.collect()] == ["a"]
    assert {r.file_path: r._error for r in bad.collect()} == {
        "b": "empty file", "c": "missing package clause", "d": "unbalanced braces", "e": "empty file", "f": "missing package clause",
    }


def test_refresh_parses_only_what_changed(spark, tmp_path):
    schema = "project string, pkg_path string, file_path string, content string"

    def source(**texts):
        return spark.createDataFrame([("p", "m/p", name, text) for name, text in texts.items()], schema)

    first = source(a="package a\n", b="package b\n", c="package c\n")
    parsed = index_store.written(parse_files(first.withColumn("content_hash", index_store.content_hash())), str(tmp_path / "one"))
    second = source(a="package a\n", b="package bb\n", d="package d\n")
    seen = []

    def parse(df):
        seen.extend(r.file_path for r in df.select("file_path").collect())
        return parse_files(df)

    out = index_store.refresh_parsed(parsed, second, parse)
    assert sorted(seen) == ["b", "d"]
    assert {r.file_path: r.package_name for r in out.collect()} == {"a": "a", "b": "bb", "d": "d"}
    assert [r.file_path for r in index_store.removed_files(index_store.fingerprints(second), index_store.fingerprints(first)).collect()] == ["c"]


def test_written_table_lies_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    stored = index_store.written(spark.range(5).select("id"))
    assert stored.count() == 5
    assert all(f.removeprefix("file:").replace("///", "/").startswith(root) for f in stored.inputFiles())


def test_text_is_gone_before_any_shuffle(spark):
    df = spark.createDataFrame([("p", "m", "a.go", "m/a.go", "package a\n")], "project string, module_path string, rel_path string, file_path string, content string")
    plan = parse_files(corpus.with_package_path(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
