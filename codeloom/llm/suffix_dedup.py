"""Removal of repeated byte strings by common-prefix interval trees over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Spans, chunks
from codeloom.llm.store import column, written

#: Bytes of a repeat (fixed by the contract), and of the stretch that suffixes are sampled by.
LENGTH, SAMPLE = 400, 100
#: Different surroundings of one stretch that a tree is built over.  More are told apart by all of their strings instead.
GROUP = 16384


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, sample: int) -> tuple[np.ndarray, ...]:
    """``(row, key, place, first, last)``: the sampled places, and the strings of ``length`` bytes that each answers for.

    Every string is answered for by the place in it whose ``sample`` bytes hash lowest, leftmost on a tie.  That depends on
    the string alone, so equal strings are answered for at the same place in them.  Places are offsets in the row.
    """
    n = len(data) - length + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n <= 0:
        return none
    hashes = Spans(data).windows(sample)
    width = length - sample + 1
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    # Minimum over each `width` values: of the end of one block and the beginning of the next.
    blocks = -(-len(packed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(blocks, width)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(up[:n], down[width - 1 : width - 1 + n])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.flatnonzero(sizes >= length)
    if not len(starts):
        return none
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, offsets[starts], 1)
    np.add.at(inside, offsets[starts + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    place = place[at]
    # A string of the next row never follows with the same place, as places lie in their strings.
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    row = np.searchsorted(offsets, at[first], "right") - 1
    begin = offsets[row]
    return row, hashes[place[first]].view(np.int64), place[first] - begin, at[first] - begin, at[last] - begin


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The nodes ``(length, first, last)`` of the common-prefix interval tree, children first, by one stack scan.

    ``lcp[i]`` is the common prefix of the sorted strings i - 1 and i; ``lcp[0]`` is not used.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else -1
        begin = i - 1
        while stack and stack[-1][0] > here:
            length, begin = stack.pop()
            yield length, begin, i - 1
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, begin))


def _sorted_lcp(strings: list[bytes]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0] + [common(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:])]


def maximal_groups(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through one place: ``(bytes to the left, bytes to the right, members)``.

    ``lefts`` are read away from the place.  Each node of the tree over ``rights`` cannot be extended to the right; within
    it, a node of the tree over ``lefts`` has members that differ in the next byte to the left, or begin there, so that
    it cannot be extended to the left either.  Nodes of at least ``length`` bytes come out, with all occurrences.
    """
    reach = max(map(len, lefts), default=0)
    order, lcp = _sorted_lcp(rights)
    for right, i, j in intervals(lcp):
        if right + reach < length or i == j:
            continue
        members = order[i : j + 1]
        back, left_lcp = _sorted_lcp([lefts[m] for m in members])
        for left, a, b in intervals(left_lcp):
            if left + right >= length and a < b:
                yield left, right, [members[k] for k in back[a : b + 1]]


def repeated(places: list[int], firsts: list[int], lasts: list[int], lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a group the ranges of its strings that stand elsewhere too.

    A node with ``right`` bytes in common makes a member's strings repeated that reach at most ``right`` bytes to the right
    and at most as far to the left as the member agrees with its nearest other member, a neighbour in left order.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in places]
    done = [False] * len(places)
    reach = max(map(len, lefts), default=0)
    order, lcp = _sorted_lcp(rights)
    for right, i, j in intervals(lcp):
        if right + reach < length or i == j:
            continue
        members = order[i : j + 1]
        if all(done[m] for m in members):
            continue
        back, left_lcp = _sorted_lcp([lefts[m] for m in members])
        left_lcp.append(0)
        for k, b in enumerate(back):
            m = members[b]
            left = max(left_lcp[k] if k else 0, left_lcp[k + 1])
            low, high = max(length - right, places[m] - lasts[m]), min(left, places[m] - firsts[m])
            if low <= high and not done[m]:
                out[m].append((places[m] - high, places[m] - low))
                done[m] = low == places[m] - lasts[m] and high == places[m] - firsts[m]
    return out


RUNS = "key long, c binary, low int, high int"


def _scan(length: int):
    """Rows of one partition, sorted by key, to runs of repeated strings; a group is held one at a time."""

    def close(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        # Each suffix as if its text began with the first string that it answers for.
        places, lasts = [r[2] for r in rows], [len(r[3]) - length for r in rows]
        found = repeated(places, [0] * len(rows), lasts, [r[3][: r[2]][::-1] for r in rows], [r[3][r[2] :] for r in rows], length)
        return [(r[0], r[1], a, b) for r, runs in zip(rows, found) for a, b in runs]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        key, c, a, b = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(c, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "c", "low", "high"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "c", "at", "bytes"))):
                if held and held[0][0] != row[0]:
                    out += close(held)
                    held = []
                held.append(row)
            yield batch_of(out)
        yield batch_of(close(held))

    return run


def _strings(length: int):
    """The hash of each string of the contents of crowded groups."""

    def run(batches):
        for batch in batches:
            for key, c, text in zip(*(batch.column(n).to_pylist() for n in ("key", "c", "bytes"))):
                data = np.frombuffer(text, np.uint8)
                low = np.arange(len(data) - length + 1)
                hashes = Spans(data).hashes(low, low + length)
                n = len(low)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([c] * n, pa.binary()), pa.array(low.astype(np.int32)), pa.array(hashes.view(np.int64))], ["key", "c", "low", "string"])

    return run


SUFFIX = "key long, t binary, place int, first int, last int"


def repeated_runs(texts: DataFrame, length: int = LENGTH, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """``(t, runs array<struct<first, last>>)``: where strings of ``length`` bytes begin that stand at another place too.

    ``texts(t, text)`` with t naming the text; rows that repeat t are one text.  Places of one text count as different places.
    """

    def find(batches):
        for batch in batches:
            ids = batch.column("t")
            for lo, data, offsets in chunks(batch.column("text")):
                row, *rest = anchors(data, offsets, length, sample)
                key, place, first, last = rest
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(row + lo)), *(pa.array(x.astype(np.int32)) for x in (place, first, last))], ["key", "t", "place", "first", "last"])

    suffixes = written(texts.mapInArrow(find, SUFFIX), "repeat-suffixes")
    where = F.xxhash64("t", "place")
    groups = suffixes.groupBy("key").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a != b").select("key")
    wanted = suffixes.join(groups, "key").groupBy("t").agg(F.collect_set(F.struct("key", "place", "first", "last")).alias("s"))
    one = texts.groupBy("t").agg(F.first("text").alias("text"))
    names = ("key", "place", "first", "last")
    found = one.join(wanted, "t").select("t", "text", *(F.col(f"s.{c}").alias(c) for c in names))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, t = batch.column("text")[i].as_py().encode("utf-8"), batch.column("t")[i].as_py()
                key, place, first, last = (batch.column(c)[i].values.to_numpy() for c in names)
                for lo in range(0, len(key), 4096):
                    at = slice(lo, lo + 4096)
                    parts = [text[a : b + length] for a, b in zip(first[at].tolist(), last[at].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at]), pa.array([t] * len(parts), pa.binary()), pa.array(first[at]), pa.array(place[at] - first[at]), pa.array(parts, pa.binary())], ["key", "t", "first", "at", "bytes"]
                    )

    cuts = found.mapInArrow(cut, "key long, t binary, first int, at int, bytes binary")
    cuts = written(cuts.withColumn("c", F.unhex(F.md5(F.concat("bytes", F.col("at").cast("string").cast("binary"))))), "repeat-cuts")
    # Equal surroundings are one content, combined before they are shuffled: of a passage in very many texts, or one that
    # repeats within a text, little is left for a tree.
    place = F.xxhash64("t", "first")
    contents = cuts.groupBy("key", "c").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    contents = written(contents.withColumn("twice", F.col("a") != F.col("b")).drop("a", "b"), "repeat-contents")
    counts = contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", (F.col("n") > group).alias("crowded"))
    placed = contents.select("key", "c", "at", "bytes").join(counts, "key")
    runs = placed.filter("not crowded").drop("crowded").repartition("key").sortWithinPartitions("key").mapInArrow(_scan(length), RUNS)
    each = placed.filter("crowded").select("key", "c", "bytes").mapInArrow(_strings(length), "key long, c binary, low int, string long")
    shared = each.groupBy("string").agg(F.min(F.xxhash64("c", "low")).alias("a"), F.max(F.xxhash64("c", "low")).alias("b")).filter("a != b").select("string")
    crowded = each.join(shared, "string").select("key", "c", "low", F.col("low").alias("high"))
    whole = contents.filter("twice").select("key", "c", F.lit(0).alias("low"), (F.octet_length("bytes") - length).alias("high"))
    # Runs count from the first string of their content.
    told = runs.unionByName(crowded).unionByName(whole).groupBy("key", "c").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    return cuts.select("key", "c", "t", "first").join(told, ["key", "c"]).select("t", F.transform("runs", lambda r: F.struct((F.col("first") + r["low"]).alias("first"), (F.col("first") + r["high"]).alias("last"))).alias("runs"))


REMOVED = "t binary, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    Each byte goes that is covered by a string of ``length`` bytes which also starts anywhere else, in this or another
    text; strings are judged on the input and do not cross texts.  Null text is empty; texts shorter than ``length`` are left
    alone.  Of texts with copies nothing is left, and one of them stands for all in comparison with others.
    """
    rows = docs.select(column(docs, "doc_id", "long"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.unhex(F.md5(F.encode("text", "UTF-8")))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    texts = rows.filter(F.col("n_bytes") >= length).select("t", "text")
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("t").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumn("whole", F.lit(True)).select("t", "whole")
    runs = written(repeated_runs(texts, length, sample, group), "repeat-runs")
    listed = runs.groupBy("t").agg(F.flatten(F.collect_list("runs")).alias("r")).join(copies, "t", "left_anti")
    found = texts.join(listed, "t").select("t", "text", F.col("r.first").alias("first"), F.col("r.last").alias("last"))

    def cut(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column("text")[i].as_py().encode("utf-8"), np.uint8)
                first, last = (batch.column(c)[i].values.to_numpy() for c in ("first", "last"))
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((batch.column("t")[i].as_py(), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], [x.split()[0] for x in REMOVED.split(", ")])

    changed = found.mapInArrow(cut, REMOVED)
    answers = changed.withColumn("whole", F.lit(False)).unionByName(
        copies.select("t", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), "whole")
    )
    narrow = rows.select("doc_id", "n_bytes", "t", F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    zero = F.lit(0).cast("long")
    return narrow.join(answers, "t", "left").select(
        "doc_id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )
