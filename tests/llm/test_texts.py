"""Near-dedup, repeats, passages, language models and the pipeline on small fixtures against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import components, language_id, lm_scoring, near_dedup, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One "), (None, "null id here"), (905, "é" * 30_000), (906, "two words"), (906, "two words"), (907, "Ünïcode 🙂 x")]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(n))


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(40)]
    for edits in (1, 3, 6):  # groups around the threshold, where links chain
        texts += copies(rng, prose(rng, 90), 25, edits)
    texts += copies(rng, prose(rng, 12), 12, 1) + [prose(rng, 60)] * 15
    chain = prose(rng, 100).split()
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 40, 3)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + ODD


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_against_all_pairs(docs, near_rows, width):
    sets = []
    for _, t in near_rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = near_rows[a][0] is not None and near_rows[b][0] is not None
            if sets[a] and sets[b] and same and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(near_rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = [(str(d), len(s), str(low[find(i)] if d is not None else None), d is None or low[find(i)] == d) for i, ((d, _), s) in enumerate(zip(near_rows, sets))]
    frame = docs(near_rows)
    got = near_dedup.near_dedup(frame, width=width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(want)
    kept = near_dedup.drop_near_copies(frame, width=width)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[3])


def test_signatures_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, near_dedup.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        for at in rng.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False):
            b[0, at] ^= 1
        assert set(near_dedup.chunk_keys(a)[0]) & set(near_dedup.chunk_keys(b)[0])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 7)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        if len(seen) > 1:
            want[x] = min(seen)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.id: r.root for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats_against_all_strings(docs, group):
    rng = random.Random(8)
    length, sample = 40, 10
    passage, other = prose(rng, 14), prose(rng, 9)
    texts = [prose(rng, 10) + f" {passage} " + prose(rng, 3) for _ in range(6)] + [other[k:] + passage[: 50 + k] for k in range(8)]
    texts += ["ab" * 60, "x" * 39, "x" * 40, "y" * 41, passage, passage, "Grüße " * 12 + other, prose(rng, 30)]
    rows = list(enumerate(texts)) + ODD
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    want = []
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.remove_repeats(docs(rows), length, sample, group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_interval_tree_gives_all_maximal_repeats():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(60)).encode() + b"c"
    places = [i for i in range(len(text)) if text[i : i + 2] == b"ab"]
    groups = {(left + right, tuple(sorted(places[m] - left for m in members))) for left, right, members in suffix_dedup.maximal_groups([text[:p][::-1] for p in places], [text[p:] for p in places], 3)}
    want = set()
    for n in range(3, 40):
        for s in {text[i : i + n] for i in range(len(text) - n + 1)}:
            at = [i for i in range(len(text) - n + 1) if text[i : i + n] == s]
            first = s.find(b"ab")
            if len(at) > 1 and first >= 0:
                before = {text[i - 1 : i] if i else None for i in at}
                after = {text[i + n : i + n + 1] for i in at}
                if (len(before) > 1 or None in before) and len(after) > 1:
                    want.add((n, tuple(at)))
    assert want <= groups


def test_passages(docs):
    rng = random.Random(9)

    def sentences(n):
        return " ".join(" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(6, 14))).capitalize() + "." for _ in range(n))

    passage = sentences(8)
    near = passage.split()
    near[len(near) // 2] = "other"
    line = "This line of eight words stands in many."
    rows = [(i, f"{sentences(4)}\n{line}\n{sentences(2)} {passage if i % 5 == 0 else ''} {sentences(3)}") for i in range(40)]
    rows += [(100, sentences(5) + " " + " ".join(near)), (101, passage.upper()), (102, sentences(3) + f"\n{passage}\n{passage}")] + ODD
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(docs(rows)).collect() if r.doc_id is not None}
    caught = {d for d, r in got.items() if r.n_removed}
    assert caught == {5, 10, 15, 20, 25, 30, 35, 100, 101, 102}
    assert got[0].n_repeated > 0 and got[0].n_removed == 0 and passage in got[0].kept_text
    assert passage not in got[5].kept_text and line in got[5].kept_text
    assert got[900].kept_text == "" and got[907].kept_text == "Ünïcode 🙂 x"
    assert substring_dedup.dedup_passages(docs(rows)).count() == len(rows)
    assert substring_dedup.dedup_passages(docs(rows).filter("doc_id < 0")).count() == 0


def test_similar_paragraphs_share_a_class(docs):
    rng = random.Random(3)
    base = [f"u{rng.randrange(9000)}" for _ in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 12):
        w = list(base)
        w[i * 5] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(docs(rows)).collect()}
    assert all(got[i].n_removed == 1 for i in range(1, 12)) and got[0].n_removed == 0
    assert len({tuple(got[i].classes) for i in range(1, 12)}) == 1


def test_language_models_are_distributions():
    rng = random.Random(7)
    counts = {lang: collections.Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(800)) for lang, letters in (("aa", "abcde"), ("bb", "defgé"))}
    models = language_id.fit(counts)
    letters = sorted(set("abcdefgé")) + ["\n", "☃"]
    for start in ("", "a", "de", "ded", "ggg"):
        total = np.zeros(2)
        for c in letters[:-1]:
            code, context, word = language_id.symbols([start + c if c != "\n" else start]) if c != "\n" else language_id.symbols([start])
            if c == "\n" and not start:
                continue
            at = np.flatnonzero(word == 0)[len(start)]
            p = np.full(2, models.floor)
            for n, (gram, head, _) in enumerate(language_id.grams(code[at : at + 1], context[:, at : at + 1])):
                i, hit = language_id.found(models.grams[n], gram)
                j, seen = language_id.found(models.contexts[n], head)
                p = (models.share[n][i[0]] if hit[0] else 0) + (models.rest[n][j[0]] if seen[0] else 1) * p
            total += p
        # What is missing is the share of characters that no language has (and of the end, where a text cannot begin with it).
        assert (total <= 1 + 1e-9).all() and (total > (0.5 if not start else 0.9)).all()


def test_language_id(docs):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ge"], "cc": ["ée", "ou", "tion", "é"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([4, 60]))), lang, "s"))
    rows += [(500 + i, t, "aa", "s") for i, (_, t) in enumerate(ODD)] + [(600, "123 ... !", "aa", "s"), (601, "kalo mitu kalo", None, None)]
    got = {r.doc_id: r for r in language_id.identify(docs(rows)).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [d for d in range(400) if got[d].held_out]
    assert np.mean([got[d].lang_pred == rows[d][2] for d in held]) > 0.97
    assert np.mean([got[d].rejected for d in range(400)]) < 0.01
    for d in (500, 501, 502, 600):
        assert got[d].lang_pred == "und" and got[d].rejected and got[d].score == 0
    assert got[601].lang_pred == "aa"
    none = language_id.identify(docs([(1, "text", None, None)])).collect()
    assert none[0].lang_pred == "und"
    assert language_id.identify(docs(rows).filter("doc_id < 0")).count() == 0


def test_lm_scores(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "cat", "sat", f"r{rng.randrange(900)}"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + ODD
    got = lm_scoring.score(docs(rows)).collect()
    assert len(got) == len(rows)

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    count = collections.Counter(w for d, t in rows if not held(d) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.score(docs(rows).filter("doc_id < 0")).count() == 0
    alone = lm_scoring.score(docs([(d, "a b") for d in range(40) if held(d)])).collect()
    assert alone and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in alone)


def test_automaton_against_its_definition(docs):
    """Every document token by token, and the probabilities of a state add up to one."""
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", f"r{rng.randrange(50)}"]) for _ in range(40))) for i in range(200)]
    frame = docs(rows)
    got = {r.doc_id: r.score for r in lm_scoring.score(frame).collect()}
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for _, t in train for w in [*words(t), None])
    pairs = collections.Counter(p for _, t in train for p in zip(words(t), [*words(t)[1:], None]))
    n, v = sum(count.values()), len(count)
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
    p = {w: (c - d) / n for w, c in count.items()}
    arcs = {(a, b): (c - 0.75) / count[a] for (a, b), c in pairs.items() if c >= 2 and count[a] >= 2 and count[b] >= 2}
    back = {}
    for a in {a for a, _ in arcs}:
        mine = [b for x, b in arcs if x == a]
        back[a] = (1 - sum(arcs[a, b] for b in mine)) / (1 - sum(p[b] for b in mine))
        assert abs(sum(arcs[a, b] for b in mine) + back[a] * (1 - sum(p[b] for b in mine)) - 1) < 1e-9
    for i, t in rows:
        total, before = 0.0, None
        for w in [*words(t), None]:
            one = p.get(w, d * v / n)
            total += math.log10(arcs[before, w] if before is not None and (before, w) in arcs else back.get(before, 1) * one if before is not None else one)
            before = w
        assert abs(total - got[i]) < 1e-6


def test_rare_states_and_arcs_give_the_same_scores(docs, monkeypatch):
    """However little is broadcast, every bigram seen twice is an arc."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", f"r{rng.randrange(80)}"]) for _ in range(rng.randrange(40)))) for i in range(150)] + ODD
    want = sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in lm_scoring.score(docs(rows)).collect())
    for share in (0.01, 2.0):
        monkeypatch.setattr(lm_scoring, "LOOKED_UP", share)
        monkeypatch.setattr(lm_scoring, "ARC", share)
        monkeypatch.setattr(lm_scoring, "BITS", 64, raising=False)
        assert sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in lm_scoring.score(docs(rows)).collect()) == want


def test_passages_of_short_lines(docs):
    """Verse, lists and dialogue: no line has enough words to be looked up alone."""
    rng = random.Random(17)

    def verse(lines, end=""):
        return "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))) + end for _ in range(lines))

    same, spoken = verse(60), verse(40, ".").replace("\n", " ")
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(docs([(1, same), (2, same), (3, verse(60)), (4, spoken), (5, spoken)])).collect()}
    assert [got[i].words_removed for i in (1, 2, 3, 4, 5)] == [0, len(words(same)), 0, 0, len(words(spoken))]


def test_passages_in_text_without_sentences(docs):
    """A passage that begins and ends in the middle of an unpunctuated text is removed but for its edges."""
    rng = random.Random(18)

    def plain(n):
        return " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))

    passage = plain(150)
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(docs([(i, f"{plain(200)} {passage} {plain(170)}") for i in (1, 2, 3)])).collect()}
    assert got[1].words_removed == 0
    for i in (2, 3):
        assert 80 <= got[i].words_removed <= 190
        assert got[i].words_removed - len(set(words(passage)) - set(words(got[i].kept_text))) <= 8
