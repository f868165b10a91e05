"""A refreshed index is the one a full rebuild gives, and what it calls stale is what reads differently."""

import os

import pytest
from source_rows import SOURCE

from codeloom import Index, extract
from codeloom.operators.extract import parse_files
from codeloom.schemas import Facts
from codeloom.sources import corpus, index_store

LIB = "package lib\n\nimport \"m/deep\"\n\n// T is a type.\ntype T struct {\n\tA int\n}\n\nconst N = deep.D + 1\n\nfunc Run(a int) error {\n\treturn nil\n}\n"
DEEP = "package deep\n\nconst D = 4\n"
USER = "package app\n\nimport \"m/lib\"\n\nfunc Main() {\n\t_ = lib.N\n\tlib.Run(1)\n}\n"
CALLER = "package app\n\nimport \"m/lib\"\n\nfunc Call() {\n\tlib.Run(2)\n}\n"
ALONE = "package alone\n\nvar X int\n"


def rows(spark, files):
    return spark.createDataFrame([(p, "m", path, f"/{p}/{path}", text) for (p, path), text in files.items()], SOURCE)


def everything(index):
    facts = {name: sorted(map(repr, getattr(index.facts, name).collect())) for name in Facts.NAMES}
    return facts, sorted(map(repr, index.errors().collect()))


def texts(index):
    return {(r.project, r.file_path): r.text for r in index.context().collect()}


BASE = {"lib/lib.go": LIB, "deep/d.go": DEEP, "app/u.go": USER, "app/c.go": CALLER, "alone/a.go": ALONE, "app/bad.go": "package app\n\nfunc {\n"}

# A project for each case: what changes in it, and which contexts are stale then.
CASES = {
    # A constant two packages away: lib derives its value from it, and the file that prints that value quotes it.
    "constant": ({"deep/d.go": DEEP.replace("4", "5")}, {"deep/d.go": "changed", "lib/lib.go": "derived", "app/u.go": "quotes"}),
    "signature": ({"lib/lib.go": LIB.replace("a int", "b int")}, {"lib/lib.go": "changed", "app/u.go": "quotes", "app/c.go": "quotes"}),
    "method": ({"lib/m.go": "package lib\n\nfunc (t *T) M() int {\n\treturn 1\n}\n"}, {"lib/m.go": "changed", "lib/lib.go": "derived"}),
    "removed": ({"lib/lib.go": None}, {"lib/lib.go": "removed", "app/u.go": "quotes", "app/c.go": "quotes"}),
    "gone": ({path: None for path in BASE}, {path: "removed" for path in BASE if path != "app/bad.go"}),
    "mended": ({"app/bad.go": "package app\n"}, {"app/bad.go": "changed"}),
    "same": ({}, {}),
}
FIRST = {(case, path): text for case in CASES for path, text in BASE.items()}


def test_refresh_equals_a_rebuild(spark, tmp_path):
    changes = {(case, path): text for case, (files, _) in CASES.items() for path, text in files.items()}
    second = {k: v for k, v in {**FIRST, **changes, ("new", "n/n.go"): "package n\n"}.items() if v is not None}
    want = {(case, f"/{case}/{path}"): reason for case, (_, reasons) in CASES.items() for path, reason in reasons.items()} | {("new", "/new/n/n.go"): "changed"}
    path = str(tmp_path / "index")
    old = extract(rows(spark, FIRST))
    old.write(path)
    before = texts(old)

    def listing():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    bucket = {r.project: r.bucket for r in index_store.read_table(spark, path, "go_file").select("project", "bucket").distinct().collect()}
    files = listing()
    index, stale = Index.refresh(spark, path, rows(spark, second))
    assert {(r.project, r.file_path): r.reason for r in stale.collect()} == want
    rebuilt = extract(rows(spark, second))
    assert everything(index) == everything(rebuilt)
    after = texts(index)
    assert {key for key in before.keys() | after.keys() if before.get(key) != after.get(key)} <= set(want)
    # Folders of projects without a change are not written, and a folder without projects is gone.
    alone = [c for c in bucket if list(bucket.values()).count(bucket[c]) == 1]
    assert "same" in alone and {f for f in files if f"bucket={bucket['same']}/" in f} <= listing()
    assert "gone" not in alone or not [f for f in listing() if f"bucket={bucket['gone']}/" in f]
    again, stale = Index.refresh(spark, path, rows(spark, second))
    assert stale.count() == 0


def test_modules_may_move(spark, tmp_path):
    """Without project columns the modules decide; a module that appears takes its files along, unparsed."""
    files = {"/r/a/a.go": "package a\n\nfunc F() {\n}\n", "/r/b/b.go": "package b\n", "/else/c.go": "package c\n"}
    source = spark.createDataFrame(list(files.items()), "file_path string, content string")
    modules = lambda *r: spark.createDataFrame(list(r), "module_dir string, module_path string")
    path = str(tmp_path / "index")
    extract(source, modules(("/r", "m/r"))).write(path)
    now = modules(("/r", "m/r"), ("/r/b", "m/own"))
    index, stale = Index.refresh(spark, path, source, now)
    assert everything(index) == everything(extract(source, now))
    assert {(r.project, r.file_path, r.reason) for r in stale.collect()} == {("/r", "/r/b/b.go", "removed"), ("/r/b", "/r/b/b.go", "changed")}
    assert [(r.project, r.file_path) for r in index.errors().collect()] == [(None, "/else/c.go")]


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_contents_are_not_shuffled(spark, tmp_path, monkeypatch, limit):
    """However many files changed: where their keys are too many to send, parsed rows meet them instead."""
    monkeypatch.setattr(index_store, "KEYS_AT_ONCE", limit)
    rows(spark, FIRST).write.parquet(str(tmp_path / "source"))
    source = corpus.with_package_path(spark.read.parquet(str(tmp_path / "source"))).withColumn("content_hash", index_store.content_hash())
    wanted = index_store.written(source.filter("project = 'same'").select(*index_store.FINGERPRINT))
    out = index_store.parse_only(source, wanted, index_store.FINGERPRINT, parse_files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.file_path for r in out.collect()) == sorted(f"/same/{path}" for path in BASE)
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert ("rightHint=(strategy=broadcast)" in join) == (limit > 0)
    if not limit:
        # The join stands above the projection that drops the text.
        assert "content#" not in plan[: plan.index("Join")] + join


def test_an_index_without_parsed_rows_cannot_be_refreshed(spark, tmp_path):
    with pytest.raises(ValueError):
        Index.refresh(spark, str(tmp_path / "facts"), rows(spark, FIRST))
