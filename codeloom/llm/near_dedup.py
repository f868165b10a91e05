"""MinHash near-dedup by a multi-index Hamming join over signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import chunks, lists, lowered, mix, words
from codeloom.llm.linking import colliding, ends, link, similar_size
from codeloom.llm.store import column, written

#: A signature has CHUNKS * WIDTH symbols of 16 bits.  Signatures that differ in at most 2 * CHUNKS - 1 symbols have a chunk
#: with at most one difference, so a chunk's keys are the chunk with each one symbol left out.  At similarity 0.8 a chunk has at
#: most one difference with a chance of 0.655, so a pair is missed with 0.345^12 = 3 in 10^6.
CHUNKS, WIDTH = 12, 6
SYMBOLS = CHUNKS * WIDTH
#: Pairs that meet are compared on full sets unless their signatures differ in more symbols than this: at similarity 0.8
#: 14.4 are expected with a deviation of 3.4, so a linked pair beyond it is a matter of one in 10^7.
RADIUS = 33
_SHINGLE = np.uint64(0x9DDFEA08EB382D69)
_rng = np.random.Generator(np.random.PCG64(6))
_A = (_rng.integers(0, 1 << 63, SYMBOLS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, number per row)``: each row's distinct shingles of ``width`` words, sorted.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    rows, _, _, h = words(lowered(data), offsets)
    n = len(offsets) - 1
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    # A word sequence is folded from the left; each shingle starts at its own word.
    folded = mix(h + np.uint64(1))
    reach = np.minimum(count[rows] - (np.arange(len(h)) - first[rows]), width)
    for k in range(1, width):
        on = reach > k
        at = np.flatnonzero(on)
        folded[at] = mix(folded[at] * _SHINGLE + h[at + k])
    start = np.arange(len(h)) - first[rows]
    whole = (reach == width) | (start == 0)
    rows, folded = rows[whole], folded[whole]
    ends = np.searchsorted(rows, np.arange(n + 1))
    sets = [np.unique(folded[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def set_ids(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ np.uint64(0x51ED270B)), out=sums[1:])
    ends = np.cumsum(sizes)
    total = sums[ends] - sums[ends - sizes]
    return np.where(sizes > 0, mix(total + sizes.astype(np.uint64)), np.uint64(0))


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16-bit symbols (row, symbol) of rows that are not empty: a scramble of the smallest hash under each function."""
    full = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    out = np.zeros((len(begin), SYMBOLS), np.uint16)
    if len(begin):
        for k in range(SYMBOLS):
            low = np.minimum.reduceat((sets ^ _B[k]) * _A[k], begin)
            out[:, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(row, key): the symbols of a chunk but one, scrambled together with which chunk and which symbol is left out."""
    parts = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        kept = [i for i in range(WIDTH) if i != left_out]
        key = parts[:, :, kept[0]]
        for i in kept[1:4]:
            key = (key << np.uint64(16)) | parts[:, :, i]
        for i in kept[4:]:
            key = mix(key) + parts[:, :, i]
        which = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, :, left_out] = mix(key + which)
    return out.reshape(len(sig), -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signed_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, node, n_shingles, sig)``: node is a hash of the shingle set, 0 if it is empty; sig is binary."""

    def run(batches):
        for batch in batches:
            for lo, data, offsets in chunks(batch.column("text")):
                sets, sizes = shingle_sets(data, offsets, width)
                sig = np.zeros((len(sizes), SYMBOLS), np.uint16)
                sig[sizes > 0] = signatures(sets, sizes)
                raw = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sizes)), _signed(set_ids(sets, sizes)), pa.array(sizes), raw], ["doc_id", "node", "n_shingles", "sig"])

    return docs.mapInArrow(run, "doc_id long, node long, n_shingles long, sig binary")


def _keys(nodes: DataFrame) -> DataFrame:
    """``(key, node)``: CHUNKS * WIDTH rows per node."""

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            for lo in range(0, len(node), 4096):
                part = batch.column("sig").slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = chunk_keys(sig)
                yield pa.RecordBatch.from_arrays([_signed(keys.ravel()), pa.array(np.repeat(node[lo : lo + 4096], keys.shape[1]))], ["key", "node"])

    # A node is few bytes and many keys: dealt to as many tasks as a shuffle has, or a task's keys would fill its memory.
    dealt = nodes.select("node", "sig").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    return dealt.mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose signatures are within RADIUS and whose sizes allow the similarity."""
    left = nodes.select(F.col("node").alias("u"), F.col("n_shingles").alias("n_u"), F.col("sig").alias("sig_u"))
    right = nodes.select(F.col("node").alias("v"), F.col("n_shingles").alias("n_v"), F.col("sig").alias("sig_v"))
    sized = pairs.join(right, "v").join(left, "u").filter(similar_size("n_u", "n_v", percent))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_u", "sig_v"))
                near = (a != b).sum(axis=1) <= RADIUS
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(near)), batch.column("v").filter(pa.array(near))], ["u", "v"])

    return sized.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, s array<long>)`` for ``wanted(node, doc_id)``, from the texts of those documents."""
    texts = docs.join(wanted, "doc_id")

    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for lo, data, offsets in chunks(batch.column("text")):
                sets, sizes = shingle_sets(data, offsets, width)
                own = set_ids(sets, sizes).view(np.int64) == nodes[lo : lo + len(sizes)]
                flat = sets[np.repeat(own, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + len(sizes)][own]), lists(flat.view(np.int64), sizes[own], pa.int64())], ["node", "s"])

    # Rows that repeat an id and a text would give a set twice.
    return texts.select("node", "text").mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("s").alias("s_v")), "v")
    both = with_v.join(sets.select(F.col("node").alias("u"), F.col("s").alias("s_u")), "u")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            u, v = batch.column("s_u"), batch.column("s_v")
            for i in range(batch.num_rows):
                a, b = u[i].values.to_numpy(), v[i].values.to_numpy()
                common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])

    return both.select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def near_links(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, root)`` of the nodes with a link, from ``rows(doc_id, node, n_shingles, sig)``; equal sets are one node."""
    nodes = rows.filter("node != 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = written(nodes, "near-nodes")

    def compare(pairs: DataFrame) -> DataFrame:
        near = written(_near(pairs, nodes, percent), "near-pairs")
        sets = written(full_sets(docs, nodes.join(ends(near), "node").select("node", "doc_id"), width), "near-sets")
        return linked(near, sets, percent)

    def sets_of(some: DataFrame) -> DataFrame:
        return full_sets(docs, nodes.join(some, "node").select("node", "doc_id"), width)

    return link(colliding(_keys(nodes), "near"), compare, sets_of, percent, "near")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents with 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word shingles (words between ASCII white
    space, A-Z lower-cased) are linked; a component's id is its smallest doc_id, which stays.  A document without words
    is alone.  A null id is alone too: component null, kept.  Rows that repeat an id and set are equal, all with the same answer.
    Links are confirmed on full sets; the chance to miss one is at most 3 in 10^6 (see CHUNKS), less for more similar texts.
    """
    texts = docs.select(column(docs, "doc_id", "long"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    rows = written(signed_sets(texts, width), "near-rows")
    roots = written(near_links(texts, rows, width, percent), "near-roots")
    # A document without words is its own node; the empty set links nothing.
    node = F.when(F.col("node") == 0, F.lit(None)).otherwise(F.col("node"))
    placed = rows.select("doc_id", "n_shingles", node.alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
    joined = placed.join(lowest, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("low"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("low"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: Where the stand-ins for missing ids begin.
_STAND_IN = 1 << 62


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; where different texts share an id, one that stays keeps all.

    Each text without an id is a document of its own with a stand-in from its hash, above all usual ids.
    """
    own, text = column(docs, "doc_id", "long"), F.coalesce(column(docs, "text", "string"), F.lit(""))
    stand_in = F.coalesce(own, F.xxhash64(text).bitwiseAND(F.lit(_STAND_IN - 1)) + F.lit(_STAND_IN)).alias("doc_id")
    answers = near_dedup(docs.select(stand_in, text.alias("text")), width, percent).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("_kept")).filter("not _kept").select("_gone")
    rows = docs.select(F.struct("*").alias("row"), stand_in)
    return rows.join(answers, F.col("doc_id") == F.col("_gone"), "left_anti").select("row.*")
