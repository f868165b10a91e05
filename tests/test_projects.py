"""Whole small projects from source text: a shop, a work queue and a few corner cases."""


def names(items):
    return [i["Name"] for i in items]


SHOP = "example.com/testproject"


def test_shop_file_info(infos):
    out = infos("shop")
    price = out["money/price.go"]
    assert price["PackageName"] == "money"
    assert [(g["Name"], g["Type"], g["Value"], g["IsConst"]) for g in price["GlobalVars"]] == [
        ("Euro", f"{SHOP}/money.Currency", "0", True), ("Dollar", f"{SHOP}/money.Currency", "1", True), ("Yen", f"{SHOP}/money.Currency", "2", True),
        ("_", "untyped int", "0", True), ("KiB", "untyped int", "2", True), ("MiB", "untyped int", "4", True),
        ("Rates", f"map[{SHOP}/money.Currency]float64", "map[Currency]float64{Euro: 1.0, Dollar: 1.1}", False),
    ]
    assert price["Structs"] == [{
        "Name": f"{SHOP}/money.Amount", "Comment": "Amount is so many units.\n\nNever negative.",
        "Fields": [{"Name": "Units", "Type": "int64"}, {"Name": "Of", "Type": f"{SHOP}/money.Currency"}],
        "Methods": [
            {"Name": "Plus", "Comment": "Plus adds.", "Parameters": [f"[]{SHOP}/money.Amount"], "ReturnTypes": [f"{SHOP}/money.Amount"]},
            # In another file of the package: known, but without its comment.
            {"Name": "Format", "Comment": "", "Parameters": ["io.Writer", f"func(unit string, n int64) {SHOP}/money.Amount"], "ReturnTypes": ["int", "error"]},
        ],
    }]
    assert names(out["money/print.go"]["UsedImportedStructs"]) == ["io.Writer"]


def test_shop_cart_uses_other_packages(infos):
    cart = infos("shop")["cart/cart.go"]
    assert cart["Imports"] == ["sort", "time", f"{SHOP}/money"]
    assert names(cart["UsedImportedStructs"]) == [f"{SHOP}/money.Amount", f"{SHOP}/money.Currency", "time.Duration", "time.Month"]
    assert [(f["Name"], f["Params"], f["Returns"]) for f in cart["Functions"]] == [
        ("Total", ["items []example.com/testproject/cart.Item", f"in {SHOP}/money.Currency"], [f"{SHOP}/money.Amount", "error"]),
        ("wait", [f"each func(n int, month time.Month) {SHOP}/money.Amount"], ["time.Duration"]),
    ]
    # '10 * time.Minute' multiplies a value; nothing else of that package is a value here.
    assert names(cart["UsedImportedGlobalVars"]) == [f"{SHOP}/money.Euro", "sort.Ints", "time.Minute"]
    assert names(cart["UsedImportedFunctions"]) == [f"{SHOP}/money.Parse"]


def test_shop_cart_text(contexts):
    assert contexts("shop")["cart/cart.go"].split("Used Items From Other Packages:\n")[1] == f'''  Struct: {SHOP}/money.Amount
    Comment: Amount is so many units.

Never negative.
    Fields:
      - Units int64
      - Of {SHOP}/money.Currency
    Methods:
      - Plus([]{SHOP}/money.Amount) ({SHOP}/money.Amount)
        Comment: Plus adds.
      - Format(io.Writer, func(unit string, n int64) {SHOP}/money.Amount) (int, error)
- {SHOP}/money.Currency
- time.Duration
- time.Month
  Function: {SHOP}/money.Parse
    Comment: Parse reads "3 EUR".
    Signature: (text string) -> ({SHOP}/money.Amount, error)
  Const: {SHOP}/money.Euro {SHOP}/money.Currency = 0
    Comment: Known currencies.
  Var: sort.Ints 
  Var: time.Minute 
'''


def test_queue_interfaces_and_embedding(infos, contexts):
    info = infos("queue")["work/queue.go"]
    w = f"{SHOP}/work"
    assert [(i["Name"], i["Embeddeds"], [(m["Name"], m["Parameters"], m["ReturnTypes"]) for m in i["Methods"]]) for i in info["Interfaces"]] == [
        (f"{w}.Job", ["fmt.Stringer", f"{w}.Named"], [("Retry", ["int", "error"], ["bool"]), ("Run", ["context.Context"], ["map[string][]byte", "error"])]),
        (f"{w}.Named", [], [("Name", [], ["string"])]),
    ]
    assert info["Structs"][0]["Fields"] == [
        {"Name": "Mutex", "Type": "*sync.Mutex"}, {"Name": "Named", "Type": f"{w}.Named"}, {"Name": "jobs", "Type": f"chan {w}.Job"},
        {"Name": "low", "Type": "int"}, {"Name": "high", "Type": "int"}, {"Name": "done", "Type": f"func(j {w}.Job, err error)"},
    ]
    assert names(info["UsedImportedStructs"]) == ["context.Context", "fmt.Stringer", "sync.Mutex"]
    text = contexts("queue")["work/queue.go"]
    assert "    Embeds:\n      - fmt.Stringer\n      - " in text and text.index("Local Structs:") < text.index("Local Interfaces:")


def test_nothing_but_a_clause(infos, contexts):
    info = infos("clause")["doc/doc.go"]
    assert info.pop("PackageName") == "doc" and not any(info.values())
    text = contexts("clause")["boot/boot.go"]
    assert "Function: init" in text and "Local Structs:" not in text and "Used Items" not in text


def test_strict_keeps_comments_of_methods_in_other_files(infos):
    files = {"lexer.go": "package lex\n\ntype Lexer struct{}\n", "next.go": "package lex\n\n// Next reads a token.\nfunc (l *Lexer) Next() {}\n"}
    assert infos(files)["lexer.go"]["Structs"][0]["Methods"][0]["Comment"] == ""
    assert infos(files, strict=True)["lexer.go"]["Structs"][0]["Methods"][0]["Comment"] == "Next reads a token."


def test_import_named_by_its_package_clause(contexts):
    assert f"  Function: {SHOP}/go-token.Scan\n" in contexts("clause")["cmd/tool.go"]


def test_typed_global_brings_its_type(contexts):
    assert contexts("typed")["cmd/run.go"].endswith(f'''Used Items From Other Packages:
  Struct: {SHOP}/level.Level
    Comment: Level of noise.
  Var: {SHOP}/level.Current {SHOP}/level.Level
''')


def test_external_symbols_describe_outside_names(spark, contexts):
    outside = spark.createDataFrame(
        [("math.Pi", "value", "math.Real", "3.14159", True)],
        "fq_name string, kind string, ext_type string, ext_value string, ext_is_const boolean",
    )
    out = contexts({"area.go": 'package area\n\nimport "math"\n\nvar half = math.Pi / 2\n'}, external_symbols=outside)
    assert out["area.go"].endswith("Used Items From Other Packages:\n- math.Real\n  Const: math.Pi math.Real = 3.14159\n")


def test_names_do_not_resolve_across_projects(spark, tmp_path):
    from codeloom import extract
    from source_rows import SOURCE

    rows = [
        ("one", "example.com/one", "see.go", "/one/see.go", 'package see\n\nimport "example.com/two/tree"\n\nvar root tree.Node\n'),
        ("two", "example.com/two", "tree/node.go", "/two/tree/node.go", "package tree\n\ntype Node struct{}\n"),
    ]
    out = {r.file_path: r.text for r in extract(spark.createDataFrame(rows, SOURCE), folder=str(tmp_path)).context().collect()}
    assert out["/one/see.go"].endswith("Used Items From Other Packages:\n- example.com/two/tree.Node\n")


def test_clash_takes_first_function_and_last_struct(contexts):
    out = contexts("typed")["cmd/clash.go"]
    assert "Comment: from b\n" in out and "Comment: Make of a\n" in out
    assert "Comment: from a\n" not in out and "Make of b" not in out


def test_bad_files_are_reported_and_left_out(spark, tmp_path):
    from codeloom import extract
    from source_rows import SOURCE

    rows = [
        ("p", "example.com/p", "good.go", "/p/good.go", "package p\n\nfunc F() {}\n"), ("p", "example.com/p", "cut.go", "/p/cut.go", "package p\n\nfunc G() {\n"),
        ("p", "example.com/p", "none.go", "/p/none.go", None), ("p", "example.com/p", "bare.go", "/p/bare.go", "func H() {}\n"),
    ]
    index = extract(spark.createDataFrame(rows, SOURCE), folder=str(tmp_path))
    assert {r.file_path: r.error for r in index.errors().collect()} == {
        "/p/cut.go": "unbalanced braces", "/p/none.go": "empty file", "/p/bare.go": "missing package clause",
    }
    assert [r.file_path for r in index.context().collect()] == ["/p/good.go"]


# Files of the tests above; all of them are indexed in one go, each as a project of its own.
CASES = {
    "shop": {
        "money/price.go": '''package money

// Currency numbers the known ones.
type Currency int

// Known currencies.
const (
	Euro Currency = iota
	Dollar
	Yen
)

const (
	_ = iota * 2
	KiB
	MiB
)

// Rates to one euro.
var Rates = map[Currency]float64{Euro: 1.0, Dollar: 1.1}

// Amount is so many units.
//
// Never negative.
type Amount struct {
	Units int64
	Of    Currency
}

// Plus adds.
func (a Amount) Plus(more ...Amount) Amount {
	return a
}

// Parse reads "3 EUR".
func Parse(text string) (Amount, error) {
	return Amount{}, nil
}
''',
        "money/print.go": '''package money

import "io"

// Format writes with a rounding.
func (a Amount) Format(w io.Writer, round func(unit string, n int64) Amount) (int, error) {
	return 0, nil
}
''',
        "cart/cart.go": f'''package cart

import (
	"sort"
	"time"

	"{SHOP}/money"
)

type Item struct {{
	Price money.Amount
	Seen  map[time.Month]int
}}

// Total of all items.
func Total(items []Item, in money.Currency) (money.Amount, error) {{
	_ = sort.Ints
	if in == money.Euro {{
		return money.Parse("1 EUR")
	}}
	return items[0].Price, nil
}}

func wait(each func(n int, month time.Month) money.Amount) (left time.Duration) {{
	return 10 * time.Minute
}}
''',
    },
    "queue": {"work/queue.go": '''package work

import (
	"context"
	"fmt"
	"sync"
)

type Queue struct {
	*sync.Mutex
	Named
	jobs      chan Job
	low, high int
	done      func(j Job, err error)
}

type Named interface{ Name() string }

// Job is one piece of work.
type Job interface {
	fmt.Stringer
	Named
	Run(ctx context.Context) (found map[string][]byte, err error)
	Retry(times int, last error) bool
}
'''},
    "clause": {
        "doc/doc.go": "// Package doc has no code.\npackage doc\n",
        "boot/boot.go": "package boot\n\nfunc init() {\n\tprintln(1)\n}\n",
        "cmd/tool.go": f'package cmd\n\nimport "{SHOP}/go-token"\n\nfunc Tool() {{\n\ttoken.Scan()\n}}\n',
        "go-token/scan.go": "package token\n\n// Scan scans.\nfunc Scan() {}\n",
    },
    "typed": {
        "cmd/run.go": f'package cmd\n\nimport "{SHOP}/level"\n\nvar noise = level.Current\n',
        "level/level.go": "package level\n\n// Level of noise.\ntype Level struct{}\n\nvar Current Level\n",
        "cmd/clash.go": f'package cmd\n\nimport "{SHOP}/twice"\n\nvar one twice.Box\n\nfunc box() {{\n\ttwice.Make()\n}}\n',
        "twice/a.go": "package twice\n\n// from a\ntype Box struct{}\n\n// Make of a\nfunc Make() {}\n",
        "twice/b.go": "package twice\n\n// from b\ntype Box struct{}\n\n// Make of b\nfunc Make() {}\n",
    },
}
