"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.store import column, written

#: Rows, by lowest hash of their vector, that the split points are chosen from; every row is then put into the tree.
SAMPLE = 4096
#: Split points of a node, depth of the tree, and sampled rows below which a node is a leaf.
FANOUT, DEPTH, SMALL = 8, 3, 16
#: Rows and anchors that a task compares at once; a crowded leaf, or one that many anchors ask for, has several blocks.
ROW_BLOCK, ANCHOR_BLOCK = 512, 512
#: Relative slack of distances, far above what rounding does to them.
SLACK = 1e-9

NOWHERE = -1


def labelled(df: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)`` with integer components floor(scale * x), x as double.

    Rows with a null id or label, a null or empty vector, or a component that is null, not finite or beyond a long take
    no part.
    """
    rows = df.select(column(df, "vec_id", "long"), column(df, "label", "long"), column(df, "embedding", "array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= 2.0**62))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~bad)
    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where they cannot round, by 64-bit integers or else whole numbers of any size."""
    size = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if size < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if size < 2.0**62 else a.astype(object) @ b.astype(object).T


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper scores, anchors x windows; anchors with fewer windows have empty ones at the end."""
    los, his = part.column("los").to_pylist(), part.column("his").to_pylist()
    most = max(map(len, los), default=0)
    return tuple(np.array([x + [rest] * (most - len(x)) for x in lists], float).reshape(len(los), most) for lists, rest in ((los, 1), (his, 0)))


@dataclass(eq=False)
class Node:
    """Split points, the child of each, and ranges low[i, j]..high[i, j]: distances of child i's rows to point j."""

    at: int
    points: np.ndarray
    lifts: np.ndarray
    children: list["Node | int"] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Tree:
    """The tree over vectors of one length, each with one more component that makes all lengths the same.

    With every row on a sphere of radius ``reach`` around the origin, the distance from a query, whose further component is
    0, falls as the inner product grows: d^2 = |q|^2 + reach^2 - 2 q.x.  So a window of scores is an annulus around the query.
    """

    def __init__(self, sample: np.ndarray, reach2: float):
        self.reach2, self.nodes, self.leaves = reach2, [], 0
        self.root = self._build(sample.astype(float), DEPTH)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.reach2 - np.einsum("ij,ij->i", x, x), 0.0))

    def _build(self, x: np.ndarray, depth: int) -> Node | int:
        distinct = np.unique(x, axis=0)
        if not depth or len(x) < SMALL or len(distinct) < 2:
            self.leaves += 1
            return self.leaves - 1
        # Far apart: each next split point is the row farthest from those chosen.
        lifts = self.lift(distinct)
        chosen = [0]
        near = self._between(distinct, lifts, distinct[:1], lifts[:1])[:, 0]
        while len(chosen) < min(FANOUT, len(distinct)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self._between(distinct, lifts, distinct[chosen[-1:]], lifts[chosen[-1:]])[:, 0])
        node = Node(len(self.nodes), distinct[chosen], lifts[chosen])
        self.nodes.append(node)
        side = self._between(x, self.lift(x), node.points, node.lifts).argmin(axis=1)
        node.children = [self._build(x[side == i], depth - 1) for i in range(len(chosen))]
        node.low = np.full((len(chosen),) * 2, np.inf)
        node.high = np.full((len(chosen),) * 2, -np.inf)
        return node

    @staticmethod
    def _between(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
        d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T) + (lx[:, None] - ly[None]) ** 2
        return np.sqrt(np.maximum(d2, 0.0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Leaf of each row, and per node the ranges of distances that these rows bring to its split points."""
        x = x.astype(float)
        leaf, seen = np.zeros(len(x), np.int64), []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                leaf[rows] = node
                continue
            if not len(rows):
                continue
            d = self._between(x[rows], self.lift(x[rows]), node.points, node.lifts)
            side = d.argmin(axis=1)
            k = len(node.points)
            low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
            np.minimum.at(low, side, d)
            np.maximum.at(high, side, d)
            seen.append((node.at, low, high))
            todo += [(child, rows[side == i]) for i, child in enumerate(node.children)]
        return leaf, seen

    def asks(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(needed, nearness)`` per query and leaf: whether one of the query's annuli can meet the leaf, and how far
        the leaf's split point is from the annuli's inner edge.  ``inner`` and ``outer`` are queries x windows; an inner
        edge beyond the outer one is no window."""
        q = q.astype(float)
        needed, nearness = np.zeros((len(q), self.leaves), bool), np.full((len(q), self.leaves), np.inf)
        if not inner.shape[1]:
            return needed, nearness
        if isinstance(self.root, int):
            nearness[:] = 0.0
            return (inner <= outer).any(axis=1, keepdims=True), nearness
        todo: list[tuple[Node, np.ndarray]] = [(self.root, inner <= outer)]
        while todo:
            node, alive = todo.pop()
            d = self._between(q, np.zeros(len(q)), node.points, node.lifts)
            slack = SLACK * (1 + d + np.sqrt(self.reach2))
            for i, child in enumerate(node.children):
                with np.errstate(invalid="ignore"):
                    # Rows of child i are at low..high from each split point, so at least / at most this far from the query.
                    least = np.maximum(np.maximum(node.low[i] - d, d - node.high[i]), 0.0) - slack
                    most = d + node.high[i] + slack
                least, most = least.max(axis=1)[:, None], most.min(axis=1)[:, None]
                # A child without rows has least = inf; comparisons with NaN keep the child.
                still = alive & ~((least > outer) | (most < inner))
                if isinstance(child, int):
                    needed[:, child] = still.any(axis=1)
                    away = np.where(alive, np.abs(d[:, i, None] - inner), np.inf).min(axis=1)
                    nearness[:, child] = np.where(needed[:, child], away, np.inf)
                elif still.any():
                    todo.append((child, still))
        return needed, nearness


def _forest(rows: DataFrame) -> dict[int, Tree]:
    """A tree per vector length that the sample has; rows of other lengths stay outside and are compared one by one.

    At most SAMPLE vectors come to the driver, besides one radius per length of theirs.
    """
    picked = rows.select("v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(r["dim"], []).append(r["v"])
    if not by:
        return {}
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    reach = rows.filter(F.size("v").isin(*by)).groupBy(F.size("v").alias("dim")).agg(F.max(norm2).alias("r")).collect()
    return {r["dim"]: Tree(np.array(by[r["dim"]], np.int64), r["r"] * (1 + SLACK)) for r in reach}


def _placed(rows: DataFrame, forest: dict[int, Tree]) -> DataFrame:
    """``(vec_id, label, v, dim, leaf)``; ranges come back as one row per task, node and pair of siblings, reduced in Spark."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                tree = forest.get(int(dim))
                leaf = tree.place(_matrix(part.column("v")))[0] if tree else np.full(part.num_rows, NOWHERE, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], names=[*part.schema.names, "leaf"])

    return rows.withColumn("dim", F.size("v")).mapInArrow(place, "vec_id long, label long, v array<long>, dim int, leaf long")


def _fill_ranges(placed: DataFrame, forest: dict[int, Tree]) -> None:
    """Distance ranges over all rows: the tree has a bounded number of nodes, so these are a bounded number of numbers."""
    if not forest:
        return

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims):
                if int(dim) not in forest:
                    continue
                for at, low, high in forest[int(dim)].place(_matrix(batch.filter(pa.array(dims == dim)).column("v")))[1]:
                    have = total.get((int(dim), at))
                    total[int(dim), at] = (np.minimum(have[0], low), np.maximum(have[1], high)) if have else (low, high)
        cells = [(dim, at, i, j, low[i, j], high[i, j]) for (dim, at), (low, high) in total.items() for i, j in np.ndindex(*low.shape) if np.isfinite(low[i, j])]
        columns = list(zip(*cells)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["dim", "node", "i", "j", "low", "high"])

    kind = "dim int, node int, i int, j int, low double, high double"
    found = placed.select("dim", "v").mapInArrow(ranges, kind).groupBy("dim", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():
        node = forest[r["dim"]].nodes[r["node"]]
        node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = r["low"], r["high"]


ASKED = "anchor_id long, label long, v array<long>, dim int, los array<long>, his array<long>"
FOUND = "anchor_id long, w int, vec_id long, score long"
_TOP, _BOTTOM = (1 << 63) - 1, -(1 << 63)


class Index:
    """All rows in the leaves of the trees, with the number of blocks of each leaf."""

    def __init__(self, rows: DataFrame):
        self.forest = _forest(rows)
        self.rows = written(_placed(rows, self.forest), "negatives-leaves")
        _fill_ranges(self.rows, self.forest)
        counts = self.rows.groupBy("dim", "leaf").count()
        # One row per leaf; written, so that Spark knows its size when it chooses how to join.
        self.blocks = written(counts.select("dim", "leaf", F.ceil(F.col("count") / ROW_BLOCK).cast("int").alias("blocks")), "negatives-blocks")

    def asked(self, anchors: DataFrame, seeds: bool) -> DataFrame:
        """``anchors`` with one row per leaf to look at: the likeliest leaf (``seeds``), or all others that are needed."""
        forest = self.forest

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dim"))
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    tree = forest.get(int(dim))
                    if tree is None:
                        lists = [[NOWHERE] if seeds else []] * part.num_rows
                    else:
                        q = _matrix(part.column("v"))
                        edge = np.einsum("ij,ij->i", q.astype(float), q.astype(float))[:, None] + tree.reach2
                        # Scores as annuli; slack keeps what rounding could push over an edge.
                        wide = SLACK * (1 + np.abs(edge))
                        los, his = _windows(part)
                        empty = los > his
                        inner = np.where(empty, np.inf, np.sqrt(np.maximum(edge - 2 * his - wide, 0.0)))
                        outer = np.where(empty, -np.inf, np.sqrt(np.maximum(edge - 2 * los + wide, 0.0)))
                        inner = np.where(~empty & (edge - 2 * los + wide < 0), np.inf, inner)
                        needed, nearness = tree.asks(q, inner, outer)
                        first = nearness.argmin(axis=1)
                        if seeds:
                            lists = [[int(f)] if needed[i, f] else [] for i, f in enumerate(first)]
                        else:
                            at = np.array(part.column("seed").to_pylist(), float)
                            lists = [[int(x) for x in np.flatnonzero(needed[i]) if x != at[i]] for i in range(len(q))]
                    names = [c for c in part.schema.names if c != "seed"]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(lists, pa.list_(pa.int64()))], names=[*names, "leaves"])

        return anchors.mapInArrow(route, f"{ASKED}, leaves array<long>").withColumn("leaf", F.explode("leaves")).drop("leaves")

    def compare(self, asked: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of each window, per leaf: exact scores of anchors and rows, block by block."""
        a_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))
        met = asked.join(self.blocks, ["dim", "leaf"])
        left = met.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        left = left.withColumn("ab", F.pmod(F.xxhash64("anchor_id"), F.lit(a_blocks)).cast("int"))
        # A row's place among the blocks of its leaf: one id that repeats very often is spread too.
        place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
        right = self.rows.join(self.blocks, ["dim", "leaf"]).withColumn("rb", place).drop("blocks")
        right = right.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
        key = ["dim", "leaf", "ab", "rb"]

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            out = []
            if a.num_rows and b.num_rows:
                ids, own, labels = b.column("vec_id").to_numpy(), a.column("anchor_id").to_numpy(), b.column("label").to_numpy()
                scores = _scores(_matrix(a.column("v")), _matrix(b.column("v")))
                fits = (a.column("label").to_numpy()[:, None] == labels[None]) == same
                fits &= own[:, None] != ids[None]
                order = np.argsort(ids, kind="stable")
                for i, (los, his) in enumerate(zip(a.column("los").to_pylist(), a.column("his").to_pylist())):
                    mine = order[fits[i][order]]
                    s = scores[i][mine]
                    for w, (lo, hi) in enumerate(zip(los, his)):
                        within = np.flatnonzero((s >= lo) & (s <= hi))
                        best = within[np.argsort(-s[within], kind="stable")[:k]]
                        out += [(int(own[i]), w, int(ids[mine[x]]), int(s[x])) for x in best]
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(FOUND.split(", "), columns, kinds)})

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block, FOUND)

    def best(self, anchors: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """``(anchor_id, w, rank, vec_id, score)``: per window the first ``k`` rows by falling score, ties to the smaller id.

        The likeliest leaf of each anchor is looked at first; its k-th score narrows the window, so that more siblings are
        eliminated when the rest of the tree is asked.
        """
        n_anchors = anchors.count()
        seeds = written(self.asked(anchors, True), f"{name}-seeds")
        first = written(_ranked(self.compare(seeds, n_anchors, k, same), k), f"{name}-first")
        kth = first.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        narrowed = anchors.join(kth, "anchor_id", "left").join(seeds.select("anchor_id", F.col("leaf").alias("seed")), "anchor_id", "left")
        los = F.transform("los", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("kth", w), lo)))
        rest = narrowed.select("anchor_id", "label", "v", "dim", los.alias("los"), "his", F.coalesce("seed", F.lit(-2)).alias("seed"))
        return written(_ranked(self.compare(self.asked(rest, False), n_anchors, k, same).unionByName(first.drop("rank")), k), f"{name}-best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # At most k rows per window and block of rows meet here.
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` and ``anchors`` are ``(vec_id, label, v)`` as ``labelled`` gives them.  An anchor's positives are its first
    rows of the same label with other ids; for each positive, the first rows of other labels whose score is between
    low[0]/low[1] of the positive's score and that score come back, all if there are fewer.  Higher scores come first,
    ties go to the smaller id.  A negative positive score leaves no window.

    Rows that repeat an id count one by one; of anchors that repeat an id, the one with the smallest (label, vector)
    is used.  Vectors of different lengths are not compared.  Empty tables give no rows.
    """
    index = Index(rows)
    own = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    own = written(own.select(F.col("vec_id").alias("anchor_id"), "a.label", "a.v", F.size("a.v").alias("dim")), "negatives-anchors")
    every = own.withColumn("los", F.array(F.lit(_BOTTOM))).withColumn("his", F.array(F.lit(_TOP)))
    near = index.best(every, positives, True, "negatives-positive")
    # Copies of one id are one positive each; w numbers them.
    a, b = low
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    windows = own.join(lists, "anchor_id")
    # Least whole score at or above a/b of the positive's: rounded up without overflow.
    least = F.transform("near", lambda p: F.ceil(p["score"].cast("decimal(38,6)") * a / b).cast("long"))
    asked = windows.select("anchor_id", "label", "v", "dim", least.alias("los"), F.transform("near", lambda p: p["score"]).alias("his"))
    far = index.best(asked, negatives, False, "negatives-negative")
    named = near.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["anchor_id", "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS anchor_id, r.vec_id, q.label = r.label AS same, CAST(list_sum([q.v[i] * r.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM e q JOIN e r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
