"""Whitening of embeddings; the principal axes come from spectral divide and conquer by polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.store import column, written

#: Rows that are multiplied at once in a task.
ROWS = 8192
#: An eigenvalue below this share of the largest, times the dimensions, is rounding: nothing can be divided by its root.
NOISE = 1e-14


def vectors(df: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, x)``: each entry c, as double, as the long floor(scale * c) + shift.

    Vectors that are null, empty or hold a null, NaN or infinite entry, or one that no long can hold, take no part.
    """
    rows = df.select(column(df, "vec_id", "long"), column(df, "embedding", "array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) >= 2.0**62))
    rows = rows.filter(F.col("e").isNotNull() & ~bad & (F.size("e") > 0))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension; one partial sum per task and dimension is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for _, x in _blocks(batches, width):
            n += len(x)
            small = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
            total += (x if small else x.astype(object)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()),
                "s": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
            })

    each = rows.mapInArrow(partial, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = sorted(map(tuple, each.collect()))
    return (got[0][1], [int(s) for _, _, s in got]) if got else (0, [])


def _products(rows: DataFrame, width: int, project) -> np.ndarray:
    """Sum of the outer products of ``project(block)``: one matrix per task, summed row by row; width^2 numbers come back."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, width):
            y = project(x)
            part = y.T @ y
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "r": pa.array(list(total), pa.list_(pa.float64()))})

    # (row, column, part) cells: the sums combine inside tasks before they are shuffled.
    cells = rows.mapInArrow(partial, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = np.array(cells.collect(), dtype=float).reshape(-1, 3)
    out = np.zeros((int(got[:, 0].max()) + 1,) * 2)
    out[got[:, 0].astype(int), got[:, 1].astype(int)] = got[:, 2]
    return (out + out.T) / 2


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, centred before multiplying.

    Entries are centred by the whole number next to the mean, so products of usual sizes are whole numbers that add up
    exactly in any order; the rest of the mean, at most a half, is taken off at the end.
    """
    centre = np.array([(2 * s + n) // (2 * n) for s in total])
    rest = np.array([(s - int(c) * n) / n for s, c in zip(total, centre)])
    return _products(rows, len(total), lambda x: (x - centre).astype(float)) / n - np.outer(rest, rest)


def polar_factor(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iteration with QR factorisations.

    For a symmetric matrix it is the matrix sign: +1 on the axes with positive eigenvalues, -1 on the others.
    """
    size = len(a)
    upper = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x, eye = a / upper, np.eye(size)
    # A lower bound of the smallest singular value; too low a guess only costs steps.
    low = 1e-16
    for _ in range(steps):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / (low2 * low2))
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low2) / (low2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        moved = np.abs(new - x).max()
        x, low = new, min(1.0, low * (wa + wb * low2) / (1 + wc * low2))
        if moved < 1e-15 * size and abs(1 - low) < 1e-8:
            break
    return x


def _divide(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the axes with eigenvalues above ``shift``; None if that is no split."""
    size = len(a)
    project = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
    k = int(round(float(np.trace(project))))
    if not 0 < k < size:
        return None
    # The range of a projector: one step from random columns, one more to take off what rounding mixed in.
    start = np.linalg.qr(project @ rng.standard_normal((size, k)))[0]
    basis = np.linalg.qr(project @ start, mode="complete")[0]
    off = np.abs(basis[:, k:].T @ a @ basis[:, :k]).max()
    return (basis, k) if off <= 1e-12 * np.abs(a).max() * size else None


def eigen(a: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    The polar factor of a - shift gives the projector on one of two invariant subspaces; each of them is a smaller
    problem.  The mean of the eigenvalues always lies between them, so it is the shift when the median of the diagonal
    is none.  A block that is a multiple of the identity up to rounding is finished: any of its bases will do.
    """
    rng, scale = np.random.default_rng(seed), float(np.abs(a).max()) or 1.0
    todo, done = [(np.eye(len(a)), a)], []
    while todo:
        basis, block = todo.pop()
        block = (block + block.T) / 2
        size, mean = len(block), float(np.trace(block)) / len(block)
        if size == 1 or np.abs(block - mean * np.eye(size)).max() <= 1e-15 * scale:
            done += [(float(block[i, i]), basis[:, i]) for i in range(size)]
            continue
        split = _divide(block, float(np.median(np.diag(block))), rng) or _divide(block, mean, rng)
        if split is None:
            # Eigenvalues that differ by rounding only: the projector is not sharp, and no axis is better than another.
            done += [(float(block[i, i]), basis[:, i]) for i in range(size)]
            continue
        q, k = split
        for part in (q[:, :k], q[:, k:]):
            todo.append((basis @ part, part.T @ block @ part))
    done.sort(key=lambda pair: -pair[0])
    axes = np.linalg.qr(np.array([v for _, v in done]).T)[0]
    return np.einsum("ij,ik,kj->j", axes, a, axes), axes


def whiten(df: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, one row per vector and component.

    Vectors take part as ``vectors`` says; rows that repeat an id count one by one.  The vectors of the commonest length
    are fitted and whitened (the longer of two that are equally common); vectors of other lengths have no such axes and
    give no rows.  A component whose eigenvalue is rounding (no spread on it: constant dimensions, fewer vectors than
    dimensions) can't be whitened and gives no rows; ``explained`` of the others is unchanged by that.  An empty table,
    or vectors that are all the same, give no rows.  ``deviation`` is exact and null if it doesn't fit a long.

    Sums, covariance and the check of the result are partial sums per task; the driver holds matrices of the number of
    dimensions only, and sends the axes back, components times dimensions.
    """
    spark = df.sparkSession
    every = written(vectors(df, scale, shift), "whiten-vectors")
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], kind)
    width = int(lengths["d"])
    rows = every.filter(F.size("x") == width)
    n, total = sums(rows, width)
    v = covariance(rows, n, total)
    values, axes = eigen(v)
    used = int((values[:components] > NOISE * width * max(values[0], 0.0)).sum())
    if not used or values[0] <= 0:
        return spark.createDataFrame([], kind)
    whole = np.array([s // n for s in total])
    rest = np.array([(s % n) / n for s in total])
    weights = axes[:, :used] / np.sqrt(values[:used])
    explained = values[:used] / np.trace(v)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ weights

    error = float(np.abs(_products(rows, width, project) / n - np.eye(used)).max())
    # n*x - S = n*(x - whole) - (S mod n): whole numbers of moderate size.
    left = np.array([s % n for s in total], dtype=object)

    def deviation(x: np.ndarray) -> pa.Array:
        near = x - whole
        if n * (float(np.abs(near).max()) + 1) < 2**31 / np.sqrt(width):
            off = n * near - left.astype(np.int64)
            return pa.array((off * off).sum(axis=1))
        exact = ((n * near.astype(object) - left) ** 2).sum(axis=1)
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width):
            white = project(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids, "deviation": deviation(x),
                "white": pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, used), pa.int32()), pa.array(white.ravel())),
            })

    out = rows.mapInArrow(apply, "vec_id long, deviation long, white array<double>").select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("i") + 1)
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
