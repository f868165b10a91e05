"""Connected components of an edge table, by alternating stars; nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.store import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` of longs → ``(id, root)`` with the smallest id that is reachable.

    Only nodes on an edge between two different nodes appear.  Loops, repeated edges and either direction are fine.
    Each round is written, so lineage stays short; the driver sees a count and a checksum.
    A node with very many neighbours is one side of a join with a single row, which adaptive execution can split.
    """
    now = written(edges.filter("u != v").select("u", "v").distinct(), name)
    mark = _mark(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)), name)
        new = _mark(after)
        if new == mark:
            break
        now, mark = after, new
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
