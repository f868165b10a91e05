"""Shared lines against a brute-force version."""

import collections
import hashlib
import random
import string

from codeloom.llm import line_dedup

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(_LOWER)


def brute(rows, min_docs, min_chars=1):
    places = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            places[key(line)].add((i, text or ""))
    gone = {k for k, docs in places.items() if len(k) >= max(min_chars, 1) and len(docs) >= min_docs}
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if key(p) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sample(seed=5, n=160):
    rng = random.Random(seed)
    common = ["Cookie notice", "  cookie NOTICE\t", "ÄRGER Über", "ärger über", "\r", "İstanbul ΣΑΣ", "x", " "]
    rows = []
    for i in range(n):
        parts = [f"own {i} {j}" for j in range(rng.randrange(4))] + rng.sample(common, rng.randrange(len(common)))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    return rows


def test_against_brute_force(docs):
    rows = sample() + [
        (900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "cookie notice\ncookie notice\ncookie notice"), (905, "no\n" * 40000 + "Cookie notice"),
        (7, "a row that shares its id\ncookie notice"), (None, "cookie notice\nwithout id"), (None, "x\nwithout id either"), (906, "a" * 200000 + "\nx"),
    ]
    rows += [rows[3]] * 3
    for least in (2, 10, 200):
        assert rows_of(line_dedup.dedup_lines(docs(rows), least)) == brute(rows, least)
    assert rows_of(line_dedup.dedup_lines(docs(rows), 5, min_chars=3)) == brute(rows, 5, 3)


def test_a_line_in_one_document_many_times_is_no_shared_line(docs):
    rows = [(i, "same\n" * 20) for i in range(9)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs(rows)).collect())
    rows.append((9, "SAME "))
    assert [r.n_dropped for r in line_dedup.dedup_lines(docs(rows)).orderBy("doc_id").collect()] == [20] * 9 + [1]
    # Copies of a row under one id are one document.
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs(rows[:1] * 30)).collect())


def test_bitmaps_are_runs_of_kept_lines(docs):
    rows = [(1, "a\nb\nb\nc\n\nb"), (2, "b\nd"), (3, "c"), (4, "b")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, [tuple(x) for x in r.kept]) for r in line_dedup.keep_bitmaps(docs(rows), 2).collect()}
    assert got == {1: (6, 4, [(0, 1), (4, 1)]), 2: (2, 1, [(1, 1)]), 3: (1, 1, []), 4: (1, 1, [])}


def test_first_occurrence_stays_on_request(docs):
    rows = [(5, "b\na"), (2, "a\nb\nA "), (None, "a\nz"), (9, "b")]
    got = {r.doc_id: r.kept_text for r in line_dedup.keep_lines(docs(rows), line_dedup.keep_bitmaps(docs(rows), 2, keep_first=True)).collect()}
    assert got == {2: "a\nb", 5: "", 9: "", None: "z"}


def test_empty_table_and_missing_columns(spark, docs):
    assert line_dedup.dedup_lines(docs([])).collect() == []
    only_text = spark.createDataFrame([("a",)] * 2 + [("b",)], "text string")
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(only_text, 2).collect()) == [0, 0, 0]


def test_plan_has_no_python_and_one_range_exchange(docs):
    hashes = line_dedup.line_hashes(docs(sample()))
    plan = line_dedup.first_occurrences(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    whole = line_dedup.dedup_lines(docs(sample()))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in whole for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
