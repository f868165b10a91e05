"""Expressions over source text, and what holds at size."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import gotext as G
from codeloom.operators import extract as X

SOURCE = "project string, pkg_path string, file_path string, content string"


@pytest.fixture(scope="module")
def cell(spark):
    """Value of an expression over one text."""

    def value(text, expr):
        return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first().v

    return value


@pytest.fixture(scope="module")
def named(spark):
    def build(text, pkg="m.com/p"):
        df = spark.createDataFrame([("p", pkg, "/p/a.go", text)], SOURCE)
        return X.with_aliases(X.parse_files(df))

    return build


def test_shield_hides_and_restores(cell):
    text = 'a := "x{\\"y" // c "q\n/* b { \n } */ r := \'{\' + `raw "{\n`\n'
    shielded = cell(text, G.shield)
    assert "{" not in shielded and shielded.count("\n") == 2
    assert cell(text, lambda t: G.unshield(G.shield(t))) == text


def test_windows_line_ends(cell):
    assert cell("package a\r\n", G.shield) == "package a\n"


def test_package_name_skips_comments(cell):
    text = "// package no\n\n/*\npackage neither\n*/\n\npackage yes // package no\n"
    assert cell(text, lambda t: G.package_name(G.shield(t))) == "yes"


def test_import_forms(cell):
    text = 'package a\n\nimport "fmt"\nimport x "a/b"\n\nimport (\n\t. "dot/d"\n\t_ "blank/b" // "no"\n\t`raw/r`\n\t// "no"\n)\n\nvar s = "import \\"no\\""\n'
    found = cell(text, lambda t: G.imports(G.shield(t)))
    assert [(i.alias, i.path) for i in found] == [("", "fmt"), ("x", "a/b"), (".", "dot/d"), ("_", "blank/b"), ("", "raw/r")]


@pytest.mark.parametrize("path, alias", [("fmt", "fmt"), ("a/b", "b"), ("a/b/v2", "b"), ("gopkg.in/yaml.v3", "yaml")])
def test_default_alias(cell, path, alias):
    assert cell(path, G.default_alias) == alias


@pytest.mark.parametrize("doc, text", [
    ("// One.\n//\n//\n//   Two.  \n//go:noinline\n", "One.\n\n  Two."),
    ("/* Block\ntext */\n", "Block\ntext"),
    ("//tight\n", "tight"),
    ("//nolint:all\n", ""),
    ("", ""),
])
def test_doc_text(cell, doc, text):
    assert cell(doc, lambda t: G.doc_text(G.shield(t))) == text


@pytest.mark.parametrize("text, parts", [
    ("a, b int", [("a", "int"), ("b", "int")]),
    ("int, error", [("", "int"), ("", "error")]),
    ("chan int, <-chan T, func(a, b int) error", [("", "chan int"), ("", "<-chan T"), ("", "func(a, b int) error")]),
    ("f func(x, y int) (int, error), m map[string][]int, rest ...string", [("f", "func(x, y int) (int, error)"), ("m", "map[string][]int"), ("rest", "...string")]),
    ("a struct{ X, Y int }", [("a", "struct{ X, Y int }")]),
    ("", []),
    ("\n\tctx context.Context,\n\tn int,\n", [("ctx", "context.Context"), ("n", "int")]),
])
def test_expand_params(cell, text, parts):
    out = cell(text, lambda t: G.expand_params(G.split_list(t)))
    assert [(p.name, p.type) for p in out] == parts


@pytest.mark.parametrize("text, shown", [
    ("d.Data", "x.com/d.Data"), ("*T", "*m/p.T"), ("[]byte", "[]byte"), ("map[d.K][]*T", "map[x.com/d.K][]*m/p.T"), ("...T", "[]m/p.T"),
    ("func(a int, b d.K) (T, error)", "func(a int, b x.com/d.K) (m/p.T, error)"), ("chan<- d.K", "chan<- x.com/d.K"),
    ("interface{}", "interface{}"), ("any", "any"), ("E", "E"), ("unknown.X", "unknown.X"), ("struct {\n\tA int\n\tB d.K\n}", "struct{A int; B x.com/d.K}"),
    ("List[d.K]", "m/p.List[x.com/d.K]"),
])
def test_qualify_type(cell, text, shown):
    aliases = F.create_map(F.lit("d"), F.lit("x.com/d"))
    assert cell(text, lambda t: G.qualify_type(t, aliases, F.lit("m/p"), F.array(F.lit("E")))) == shown


@pytest.mark.parametrize("literal, shown", [
    ("42", "42"), ("1_000", "1000"), ("0x1F", "31"), ("-7", "-7"), ("2.50", "2.5"), ("1.0", "1"), ("3.14159265358979", "3.14159"), ("1e9", "1e+09"), ("0xFFFFFFFFFFFFFFFF", "18446744073709551615"), ("0b101", "5"), ("0o17", "15"), ("'a'", "97"), (r"'\n'", "10"), (r"'\u00e9'", "233"), ("1e999", ""), ("1 << 3", ""), ("iota", ""),
    ("true", "true"), ('"a{b"', '"a{b"'), ("`raw`", '"raw"'), ('"' + "x" * 100 + '"', '"' + "x" * 100 + '"'), ("010", "8"),
])
def test_constant_value(cell, literal, shown):
    assert cell(literal, G.constant_value) == shown


def test_globals_forms(named):
    rows = X.globals_(named('''package a

import "x.com/d"

// Group doc.
const (
	// Own doc.
	A, B = 1, "s, t" // trailing
	C d.Mode = 1 << iota
	E
	D d.Kind = 3
	G
)

var (
	e, f = call(1, 2), []d.T{{1}}
	g map[string]d.T
	h = &Local{A: "}"}
	k = make(chan int, 3)
)

var pair, other = two()
''')).orderBy("pos").collect()
    assert [(r.name, r.comment, r.type, r.value, r.is_const) for r in rows] == [
        ("A", "Own doc.", "untyped int", "1", True), ("B", "Own doc.", "untyped string", '"s, t"', True), ("C", "Group doc.", "x.com/d.Mode", "2", True),
        ("E", "Group doc.", "x.com/d.Mode", "4", True), ("D", "Group doc.", "x.com/d.Kind", "3", True), ("G", "Group doc.", "x.com/d.Kind", "3", True),
        ("e", "", "", "call(1, 2)", False), ("f", "", "[]x.com/d.T", "[]d.T{{1}}", False), ("g", "", "map[string]x.com/d.T", "", False),
        ("h", "", "*m.com/p.Local", '&Local{A: "}"}', False), ("k", "", "chan int", "make(chan int, 3)", False),
        ("pair", "", "", "two()", False), ("other", "", "", "", False),
    ]


def test_references(named):
    rows = X.foreign_names(named('''package a

import (
	"x.com/d"
	z "x.com/e/v2"
)

type T struct {
	d.Embedded
	F map[d.Key]*z.Val
}

func run(in ...d.In) (d.Out, error) {
	s := "d.Not" // d.Not
	x := d.Make{A: 1}
	z.Call(x.d.Not, d.Value)
	return d.Conv(s), local.d.Not
}
''')).orderBy("pos").collect()
    assert [(r.target_pkg[-1], r.target_name, r.kind) for r in rows] == [
        ("d", "Embedded", "type"), ("d", "Key", "type"), ("2", "Val", "type"), ("d", "In", "type"), ("d", "Out", "type"),
        ("d", "Make", "type"), ("2", "Call", "call"), ("d", "Value", "value"), ("d", "Conv", "call"),
    ]


def test_methods_and_generics(named):
    files = named('''package a

type List[T any] struct {
	items []T
}

// Push adds.
func (l *List[T]) Push(v T, more ...Other) (n int, err error) {
	return 0, nil
}

func Map[K comparable, V any](
	in map[K]V,
	f func(K) V,
) []V {
	return nil
}
''')
    method = X.methods(files).first()
    assert (method.recv_type, method.name, method.comment) == ("List", "Push", "Push adds.")
    assert (method.parameters, method.returns) == (["T", "[]m.com/p.Other"], ["int", "error"])
    func = X.functions(files).first()
    assert (func.params, func.returns) == (["in map[K]V", "f func(K) V"], ["[]V"])
    assert X.structs(files).first().name == "m.com/p.List[T any]"


def test_very_long_bodies(named):
    """Regular expressions must not recurse over a long body, comment or literal."""
    fields = "".join(f"\tF{i} int // c\n" for i in range(30_000))
    calls = "".join(f"\td.F{i}(\"x\")\n" for i in range(30_000))
    long_comment = "// line\n" * 30_000
    text = f'package a\n\nimport "x.com/d"\n\n{long_comment}\ntype T struct {{\n{fields}}}\n\nvar s = "{"y" * 300_000}"\n\nfunc run() {{\n{calls}}}\n'
    files = named(text)
    assert X.structs(files).select(F.size("fields")).first()[0] == 30_000
    assert X.foreign_names(files).count() == 30_000
    assert X.globals_(files).select(F.length("value")).first()[0] == 300_002


def test_deep_values_are_whole(named):
    deep = "[][][][][][][][][][][][]int{" + "{" * 11 + "1, 2" + "}" * 11 + ", nil}"
    body = "\n".join("\tfor i := range xs {\n\t\tif i > 2 {\n\t\t\tcall(map[string][]int{\"a\": {1, i}})\n\t\t}\n\t}" for _ in range(40))
    rows = {r.name: r for r in X.globals_(named(f"package a\n\nvar deep = {deep}\n\nvar act = func() int {{\n{body}\n\treturn 1\n}}\n\nvar p, q = {deep}, two(3)\n")).collect()}
    assert rows["deep"].value == deep and rows["p"].value == deep and rows["q"].value == "two(3)"
    assert rows["act"].value == f"func() int {{\n{body}\n\treturn 1\n}}"


def test_lists_inside_function_types(named):
    files = named("""package a

import "x.com/d"

type T struct {
	Do func(a, b d.K) (n, m int, err error)
}

func Each(f func(x, y d.K, g func(p, q int) T), rest ...d.K) {}

var hook func(a, b int) error
""")
    assert X.structs(files).first().fields[0].Type == "func(a x.com/d.K, b x.com/d.K) (n int, m int, err error)"
    assert X.functions(files).first().params == ["f func(x x.com/d.K, y x.com/d.K, g func(p int, q int) m.com/p.T)", "rest []x.com/d.K"]
    assert X.globals_(files).first().type == "func(a int, b int) error"


def test_products_are_no_pointers(named):
    rows = X.foreign_names(named("""package a

import "x.com/d"

func wait(w any) (d.Out, error) {
	n := 10 * d.Second + 2*d.Minute
	f := w.(d.Flusher)
	var m map[d.Key]*d.Val
	return []*d.Item{}, nil
}
""")).orderBy("pos").collect()
    assert [(r.target_name, r.kind) for r in rows] == [
        ("Out", "type"), ("Second", "value"), ("Minute", "value"), ("Flusher", "type"), ("Key", "type"), ("Val", "type"), ("Item", "type"),
    ]
