"""The pipeline's stages one after another, against what each has to do by brute force."""

import collections
import random
import re

import pytest

import corpus_pipeline
from codeloom.llm import exact_dedup, queries, sentencepieces
from codeloom.llm.store import written


@pytest.fixture()
def table(docs):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ge"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(60)), lang, f"s{i % 4}"))
    rows += [(300 + i, rows[3][1].replace(" ", "  "), "aa", "s0") for i in range(20)]
    for i in range(20):
        w = rows[7][1].split()
        w[i] = "kamituloka"
        rows.append((400 + i, " ".join(w), rows[7][2], "s1"))
    rows += [(500, None, "aa", "s0"), (501, "12 34", None, None), (502, "", "aa", "s0")]
    return docs(rows)


def test_stages(spark, table):
    docs = table
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, "/nowhere"), "test-stage")
        if name != "sentencepiece":
            assert docs.columns == table.columns
        seen[name] = (before, docs.collect())
    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {500, 501, 502}
    before, after = seen["exact_dedup"]
    groups = collections.defaultdict(list)
    for r in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(min(g)[1] for g in groups.values())
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(range(400, 420))
    before, after = seen["mixing"]
    times = collections.Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and 1.3 < len(after) / len(before) < 1.7
    before, after = seen["sentencepiece"]
    assert collections.Counter(r.doc_id for r in before) == collections.Counter(r.doc_id for r in after)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_registered():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_without_labels_documents_with_letters_stay(spark, docs):
    rows = docs([(1, "some text", None, "a"), (2, "12 34", None, "a"), (3, None, None, "a"), (4, "ü", None, None), (4, "ü", None, None)])
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, rows, "/nowhere").collect()) == [1, 4, 4]


def test_near_copies_without_ids(spark, docs):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (0, 59)]
    rows = docs([(None, near[0], "aa", "a"), (None, near[1], "aa", "a"), (None, "quite another text of more than five words", "aa", "a")])
    left = [r.text for r in corpus_pipeline.drop_near_copies(spark, rows, "/nowhere").collect()]
    assert len(left) == 2 and sum(t in near for t in left) == 1
    # A text with an id comes before one without.
    rows = docs([(None, near[0], "aa", "a"), (8, near[1], "aa", "a")])
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "/nowhere").collect()] == [8]


def test_a_new_index_starts_no_python_workers(spark, monkeypatch):
    """An empty list from the driver is turned into rows by Python workers, which then stay on every executor."""
    def refuse(*_, **__):
        raise AssertionError("made by Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    table = exact_dedup.DigestIndex.create(spark, buckets=4).table()
    assert table.count() == 0 and table.dtypes == [("text_sha256", "string"), ("keep_id", "bigint"), ("n_points", "bigint"), ("group_size", "bigint")]


def test_remembered_pairs_are_numbers():
    """One number for a pair of arcs, also of those below zero: an arc before a fallback, and a fallback before an arc."""
    with open(queries.tokenizer("piece_bpe_32k.model"), "rb") as f:
        fst = sentencepieces.Transducer(f.read())
    fst.shortest_paths(["▁the▁words", "▁a\U0010fffdb\U0010fffe\U0010fffd", "▁ü€the"])
    assert fst.follows and all(type(key) is int for key in fst.follows)
    arcs = [(((key + (1 << 31)) >> 32), ((key + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)) for key in fst.follows]
    assert {min(a < 0, b < 0) for a, b in arcs} == {False, True}
    assert all(fst.may_follow(a, b) == may for (a, b), may in zip(arcs, fst.follows.values()))
