"""Hand-made file rows, requests, prompts, exports."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators.file_info import compose_file_info
from codeloom.operators.graph import package_edges
from codeloom.operators.requests import lookup_file, serve_requests
from codeloom.plans.prompts import EMPTY_TEXT, MINIFY_TEXT, SYSTEM_TEXT, has_content, prompt_messages
from codeloom.schemas import FILE_INFO
from codeloom.sources import export

FIELDS = ("PackageName", "Imports", "Functions", "Structs", "Interfaces", "GlobalVars", "UsedImportedStructs", "UsedImportedFunctions", "UsedImportedGlobalVars")


@pytest.fixture()
def rows(spark):
    def build(files: dict[str, dict], project: str = "p"):
        data = [(project, path, tuple(info.get(f) for f in FIELDS)) for path, info in files.items()]
        return spark.createDataFrame(data, f"project string, file_path string, info {FILE_INFO}")

    return build


def fn(name, comment=None, params=None, returns=None):
    return (name, comment, params, returns)


def used(name):
    return (name, None, None, None)


def texts(df):
    return {r.file_path: r.text for r in compose_file_info(df).collect()}


def test_a_file_with_imports_only(rows):
    assert texts(rows({"/bank/ledger.go": {"PackageName": "bank", "Imports": ["errors", "math/big"]}})) == {
        "/bank/ledger.go": "--- File: /bank/ledger.go ---\nPackage: bank\n\nImports:\n- errors\n- math/big\n\n"
    }


def test_names_that_no_file_declares(rows):
    out = texts(rows({"/bank/audit.go": {"PackageName": "bank", "UsedImportedStructs": [used("math/big.Int"), used("errors.Kind")]}}))
    assert out["/bank/audit.go"].split("\n\n")[1] == "Used Items From Other Packages:\n- errors.Kind\n- math/big.Int\n"


def test_type_section_comes_before_the_function_of_the_same_name(rows):
    both = "bank.example/rate.Convert"
    out = texts(rows({
        "/bank/rate/convert.go": {"PackageName": "rate", "Functions": [fn(both, "Convert at today's rate.", ["cents int64"], ["int64"])]},
        "/bank/pay.go": {"PackageName": "bank", "UsedImportedStructs": [used(both), used("bank.example/rate.Table")], "UsedImportedFunctions": [fn(both, None, ["cents int64"], ["int64"])]},
    }))
    section = out["/bank/pay.go"].split("Used Items From Other Packages:\n")[1]
    assert section == f"  Function: {both}\n    Comment: Convert at today's rate.\n    Signature: (cents int64) -> (int64)\n- bank.example/rate.Table\n"


def test_what_a_used_type_name_may_stand_for(rows):
    out = texts(rows({
        "/geo/shapes.go": {
            "PackageName": "geo",
            "Structs": [("geo.Circle", None, [("Radius", "float64")], [("Area", "Area in square metres.", [], ["float64"]), ("Move", None, ["float64", "float64"], [])])],
            "Interfaces": [("geo.Shape", "Shape has an area.", [("Area", None, [], ["float64"])], ["fmt.Stringer", "geo.Moving"])],
            "Functions": [fn("geo.Union", None, ["all []geo.Shape"], ["geo.Shape"])],
            "GlobalVars": [("geo.Origin", "Origin is zero.", "geo.Point", "Point{}", False)],
        },
        "/draw.go": {"PackageName": "draw", "UsedImportedStructs": [used(f"geo.{n}") for n in ("Shape", "Circle", "Union", "Origin")]},
    }))
    assert out["/draw.go"].endswith('''Used Items From Other Packages:
  Struct: geo.Circle
    Fields:
      - Radius float64
    Methods:
      - Area() (float64)
        Comment: Area in square metres.
      - Move(float64, float64) ()
- geo.Origin
  Interface: geo.Shape
    Comment: Shape has an area.
    Embeds:
      - fmt.Stringer
      - geo.Moving
    Methods:
      - Area() (float64)
  Function: geo.Union
    Signature: (all []geo.Shape) -> (geo.Shape)
''')


def test_struct_wins_over_interface_and_function(rows):
    out = texts(rows({
        "/o.go": {"PackageName": "o", "Functions": [fn("x.N")], "Interfaces": [("x.N", None, None, None)]},
        "/q.go": {"PackageName": "q", "Structs": [("x.N", None, None, None)]},
        "/m.go": {"PackageName": "main", "UsedImportedStructs": [used("x.N")]},
    }))
    assert out["/m.go"].endswith("Packages:\n  Struct: x.N\n")


def test_lookup_file(spark, rows):
    context = compose_file_info(rows({"/a.go": {"PackageName": "a"}}))
    asked = spark.createDataFrame([(1, "/a.go"), (2, "/a/b.go"), (3, None)], "request_id int, file_path string")
    out = {r.request_id: r for r in lookup_file(asked, context).collect()}
    assert out[1].found and out[1].error is None
    assert not out[2].found and out[2].text is None and out[2].error == "file info not found for path: /a/b.go"
    assert not out[3].found


def test_serve_requests(spark, rows):
    files = rows({"/w/p/main.go": {"PackageName": "main"}, "/w/p/sub/x.go": {"PackageName": "sub"}})
    asked = spark.createDataFrame(
        [(1, "/w/p", "main.go"), (2, None, None), (3, "/w/p", None), (4, "/non/existent", "main.go"), (5, "/w/p", "no.go"), (6, "/w/p/sub", "x.go"), (7, "/w/p", "sub/x.go")],
        "request_id int, project_path string, file_path string",
    )
    out = {r.request_id: (r.is_error, r.text) for r in serve_requests(asked, compose_file_info(files), files).collect()}
    assert out[1] == (False, "--- File: /w/p/main.go ---\nPackage: main\n\n")
    assert out[2] == (True, 'required argument "projectPath" not found')
    assert out[3] == (True, 'required argument "filePath" not found')
    assert out[4] == (True, "failed to parse project: no packages found in /non/existent")
    assert out[5] == (True, "failed to compose project info: file info not found for path: /w/p/no.go")
    assert out[6] == out[7] and not out[6][0]


def test_context_of_requests_equals_whole_context(spark, project):
    index = project({
        "main.go": 'package main\n\nimport "example.com/testproject/lib"\n\nfunc main() {\n\tlib.F()\n}\n',
        "lib/l.go": "package lib\n\n// F acts.\nfunc F() {}\n\n// T is a type.\ntype T struct{}\n",
    })
    whole = {r.file_path: r.text for r in index.context().collect()}
    asked = spark.createDataFrame([(1, "/testproject", "main.go"), (2, "/testproject", "lib/l.go")], "request_id int, project_path string, file_path string")
    out = {r.request_id: r.text for r in index.context(asked).collect()}
    assert out == {1: whole["/testproject/main.go"], 2: whole["/testproject/lib/l.go"]}


def test_prompt_messages(rows):
    df = rows({"/p/b.go": {"PackageName": "main", "Structs": [("m.My", "c", [], [])]}, "/p/a.go": {"PackageName": "main"}})
    plain = prompt_messages(df).orderBy("ordinal", "part").collect()
    assert [(r.ordinal, r.part, r.role) for r in plain] == [(0, "", "system"), (1, "0", "user"), (1, "1//p/a.go", "user"), (1, "1//p/b.go", "user"), (1, "2", "user")]
    assert plain[0].content == SYSTEM_TEXT
    body = "".join(r.content for r in plain[1:])
    assert body.startswith("Here is the project structure and parsed AST information:\n\n```json\n[") and body.endswith("]\n```")
    parsed = json.loads(body.split("```json\n")[1].removesuffix("\n```"))
    assert [p["filePath"] for p in parsed] == ["/p/a.go", "/p/b.go"]
    assert parsed[1]["fileInfo"]["Structs"][0]["Name"] == "m.My"
    assert list(parsed[0]) == ["fileInfo", "filePath"]
    more = {r.ordinal: r.content for r in prompt_messages(df, focus="My", minify="true").collect()}
    assert "'My' symbol" in more[2] and more[3] == MINIFY_TEXT
    assert len(prompt_messages(df, minify="yes").collect()) == 5


def test_empty_project_gets_the_stub_message(rows):
    df = rows({"/p/a.go": {"PackageName": ""}})
    assert [r.has_content for r in has_content(df).collect()] == [False]
    assert {r.ordinal: r.content for r in prompt_messages(df, focus="X").collect()}[2] == EMPTY_TEXT


def test_pieces_of_a_document_join_to_valid_json(rows):
    df = rows({f"/f{i}.go": {"PackageName": f"p{i}", "Imports": ["fmt"]} for i in range(5)}).unionByName(rows({"/g.go": {"PackageName": "g"}}, "q"))
    pieces = export.project_context_parts(df)
    assert sorted((r.project, r.part) for r in pieces.collect()) == [("p", "0"), *[("p", f"1//f{i}.go") for i in range(5)], ("p", "2"), ("q", "0"), ("q", "1//g.go"), ("q", "2")]
    out = {r.project: json.loads(r.text) for r in export.whole(pieces, ["project"]).collect()}
    assert [x["filePath"] for x in out["p"]] == [f"/f{i}.go" for i in range(5)] and out["q"][0]["fileInfo"]["PackageName"] == "g"
    by_path = {r.project: json.loads(r.text) for r in export.whole(export.project_json_parts(df), ["project"]).collect()}
    assert list(by_path["p"]) == [f"/f{i}.go" for i in range(5)]


def test_json_keeps_absent_and_empty_apart(infos, project):
    index = project({"a.go": 'package a\n\nimport "io"\n\nvar _ io.Reader\n'})
    out = json.loads(index.json().first().json)
    assert list(out) == list(FIELDS)
    assert out["UsedImportedFunctions"] is None and out["Functions"] == []
    assert out["UsedImportedStructs"] == [{"Name": "io.Reader", "Comment": "", "Fields": None, "Methods": None}]


def test_report(project):
    text = {r.file_path: r.text for r in project({
        "a.go": 'package a\n\n// Says "hi".\ntype T struct {\n\tA int\n}\n\nfunc (T) M(x int) error {\n\treturn nil\n}\n',
        "b.go": "package a\n",
    }).report().collect()}
    assert text["/testproject/a.go"] == '''
--- File: /testproject/a.go ---
  Package Name: a
  Imports:
    (None)
  Functions:
    (None)
  Local Structs:
    - example.com/testproject.T (Comment: "Says \\"hi\\".")
      Fields:
        - A int
      Methods:
        - M(int) (error) (Comment: "")
  Used Imported Structs:
    (None)
'''
    assert text["/testproject/b.go"].count("(None)") == 4


def test_package_edges_and_nodes(project):
    index = project({
        "a/x.go": 'package a\n\nimport (\n\t"fmt"\n\t"io"\n)\n\nfunc Up() {}\n\nfunc low() {}\n', "a/y.go": 'package a\n\nimport "fmt"\n\nfunc Also() {}\n',
    })
    node = index.package_nodes().first()
    assert (node.PkgPath, node.Functions, node.DependsOn) == ("example.com/testproject/a", ["Also", "Up"], ["fmt", "io"])
    assert node.Files == ["/testproject/a/x.go", "/testproject/a/y.go"]
    edges = {(r["list"], r.item) for r in package_edges(index.facts).collect()}
    assert edges == {(field, x) for field in ("Functions", "DependsOn", "Files") for x in node[field]}


def test_written_index_reads_back(project, spark, tmp_path):
    from codeloom import Index

    index = project({"a/x.go": "package a\n\n// F is.\nfunc F(a int) {}\n"})
    index.write(str(tmp_path / "stored"))
    again = Index.read(spark, str(tmp_path / "stored"), project="p")
    assert again.context().collect() == index.context().collect()
    assert Index.read(spark, str(tmp_path / "stored"), project="other").context().count() == 0
    plan = again.facts.decl_func.select(F.col("name"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(project,p)" in plan
