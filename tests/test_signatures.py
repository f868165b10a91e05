"""Functions and methods are told apart before their signatures are looked at."""

from codeloom.operators import extract as X
from codeloom.sources import corpus
from source_rows import SOURCE


def test_signatures_are_folded_once_for_each_declaration(spark):
    text = "package a\n\nfunc F(x int) {\n}\n\nfunc (r *T) M(y int) string {\n\treturn \"\"\n}\n\nfunc G[K any](f func(a, b K)) (K, error) {\n}\n"
    rows = spark.createDataFrame([("p", "m", "a.go", "/a.go", text)], SOURCE)
    parsed = X.with_aliases(X.parse_files(corpus.with_package_path(rows)))
    told = {True: ["M"], False: ["F", "G"]}
    for received, names in told.items():
        # The declarations that reach the fold are those of the one kind.
        assert [r.name for r in X._signatures(parsed, received).orderBy("pos").collect()] == names
    assert [r.name for r in X.functions(parsed).orderBy("pos").collect()] == ["F", "G"]
    assert [(r.recv_type, r.name) for r in X.methods(parsed).collect()] == [("T", "M")]
