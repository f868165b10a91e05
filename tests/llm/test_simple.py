"""Exact dedup, mixing, top-k, token counts and encoding on small hand-made rows against brute force."""

import hashlib
import os
import re

import numpy as np
import pytest

from codeloom.llm import exact_dedup, exact_topk, mixing, sentencepieces, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ROWS = [
    (1, "Hello  world", "en", "a"), (2, "Helloworld", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\x0b\x0c\r", "en", "b"),
    (6, "Hello\nworld ", "en", None), (7, "one two three", "en", "c"), (7, "one two three", "en", "c"), (None, "onetwothree", "en", "c"), (9, "x" * 70_000, "en", "c"),
    (10, "straße ▁ mark▁ 日本 🙂é", "de", "b"), (11, "a " * 9_000, "en", "a"),
]


def spaces_gone(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs(ROWS), buckets=3).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(spaces_gone(text), []).append((-len(text or ""), i is None, i if i is not None else 0, i))
    want = sorted((str(i), str(min(groups[spaces_gone(t)])[3]), len(groups[spaces_gone(t)]), i == min(groups[spaces_gone(t)])[3], hashlib.sha256(spaces_gone(t).encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_keeps_one_row_of_each_group(docs):
    frame = docs(ROWS)
    kept = exact_dedup.drop_exact_copies(frame, buckets=3)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 7, 9, 10, 11]
    assert kept.count() == len({spaces_gone(t) for _, t, *_ in ROWS})


def test_index_takes_later_batches_and_can_be_opened_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex.create(spark, path, buckets=4)
    exact_dedup.exact_dedup(docs([(1, "a b"), (2, "c")]), index).collect()
    again = exact_dedup.DigestIndex.open(spark, path, buckets=4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs([(8, "ab  "), (9, "d"), (10, "d ")]), again).collect()}
    assert got == {8: (1, False), 9: (10, False), 10: (10, True)}
    assert again.table().count() == 3
    plan = again.table().join(index.table().select("text_sha256"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_empty_tables(docs):
    empty = docs([(1, "x")]).filter("doc_id < 0")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert token_counts.token_counts(empty, MODEL).count() == 0
    assert sentencepieces.encode(empty, MODEL).count() == 0


def filled(sizes, weights, share=1.5, epochs=2):
    """Reshare the excess by weight until no source is above its cap."""
    capped, target = set(), {}
    total = share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        target = {s: epochs * sizes[s] for s in capped} | {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return target
        capped.update(over)


def test_mixing_against_resharing(docs):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), None, None if i % 13 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    got = mixing.mix_sources(docs(rows)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20
    assert sorted(map(str, mixing.mix_sources(docs(rows).repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mix_documents(docs(rows)).groupBy("doc_id").count().collect()
    times = {r.doc_id: r.taken // r.size for r in got if r.size}
    assert {r.doc_id: r["count"] for r in mixed if times.get(r.doc_id)} == {d: n for d, n in times.items() if n}


def test_mixing_of_odd_rows(docs):
    got = mixing.mix_sources(docs(ROWS)).collect()
    assert len(got) == len(ROWS) and {r.source for r in got} == {"a", "b", "c", None}
    assert all(r.taken == 0 for r in got if r.size == 0)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, list(rows[5][1])) for i in range(300, 360)]  # ties
    rows += [(400, None), (401, [None] + [0.0] * 7), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (405, [0.5] * 3), (410, [1e6] * 8), (None, [1.0] * 8), (450, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, q int")
    v = exact_topk.quantised(frame)
    got = exact_topk.top_k(v.filter("vec_id % 50 = 0"), v, query_block=3, row_block=50)
    good = {i: np.floor(256 * np.array(e)).astype(object) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in good:
        if q % 50 == 0:
            scores = sorted((-int((good[q] * good[i]).sum()), i) for i in good if i != q and len(good[i]) == len(good[q]))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_k_with_fewer_rows_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    v = exact_topk.quantised(frame)
    assert sorted(tuple(r) for r in exact_topk.top_k(v.filter("vec_id = 0"), v).collect()) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert exact_topk.top_k(v.filter("vec_id = 9"), v).count() == 0


HARD = [
    "a  b", "  a", " ", "▁ x ▁▁y", "\t\n", "a▁b c", "日本語 テスト🙂é́ ẞ", "x" * 300, "aaaa aaaaaaa 1234567 ...", "", "a▁ b\n  ▁ c", "<s>hi</s> <unk>\x00", "\n\n x\r\ny",
    "the " * 5000, "Das  ist gut, l'été!  ", "trailing   ", "   ", "a\nb", "\na", " \n ",
]


def test_encoding_and_counts_equal_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (None, "null id"), (0, "a  b")]
    want = sorted((str(i), len((t or "").encode()), tuple(library.encode(t or ""))) for i, t in rows)
    text = {i: t or "" for i, t in rows if i is not None}
    encoded = sentencepieces.encode(docs(rows), MODEL)
    got = encoded.collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((i, ids) for i, _, ids in want)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert all(r.round_trip == ("▁" not in text[r.doc_id]) for r in got if r.doc_id is not None)
    for r in sentencepieces.decode(encoded, MODEL).collect():
        if r.doc_id is not None:
            assert r.text == library.decode(library.encode(text[r.doc_id]))
    counts = token_counts.token_counts(docs(rows), MODEL, limit=20, cache_size=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((i, n, len(ids), len(ids) > 20) for i, n, ids in want)


def test_shortest_path_is_the_cheapest_of_all_paths():
    """With unigram weights: all ways to cut a short text, enumerated."""
    with open(MODEL, "rb") as f:
        fst = sentencepieces.Transducer(f.read())
    fst.merges = False

    def cheapest(text):
        if not text:
            return 0.0
        best = float("inf")
        for i in range(1, len(text) + 1):
            piece = fst.pieces.get(text[:i])
            cost = piece[1] if piece else fst.fallback if i == 1 else None
            if cost is not None:
                best = min(best, cost + cheapest(text[i:]))
        return best

    price = {i: w for i, w in fst.pieces.values()}
    texts = sorted(["▁the", "▁thesis", "ation", "▁üx", "aaaa", "▁of🙂a", "ing"])
    for text, ids in zip(texts, fst.shortest_paths(texts)):
        paid = sum(price.get(i, fst.fallback / len("🙂".encode())) for i in ids)
        assert abs(paid - cheapest(text)) < 1e-6


def test_model_path_is_a_parameter():
    assert os.path.isfile(MODEL)
    with pytest.raises(OSError):
        sentencepieces._read("/nowhere/x.model")
