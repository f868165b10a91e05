"""From things that share keys to linked components, without listing all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import found, ragged
from codeloom.llm.components import connected_components
from codeloom.llm.store import written


def colliding(keys: DataFrame, name: str) -> DataFrame:
    """``keys(key, node)`` → ``(key, node, u)`` of keys with more than one node; u is the key's smallest node, its centre."""
    centres = keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("high")).filter("u != high").select("key", "u")
    return written(keys.join(centres, "key").select("key", "node", "u").distinct(), f"{name}-keys")


def link(shared: DataFrame, compare: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], percent: int, name: str) -> DataFrame:
    """``(node, root)`` of the nodes with a link; ``compare`` keeps the linked ones of ``pairs(u, v)``.

    1. The nodes of a key are compared with its centre only: a pair per node and key, whatever the size of a group.
    2. In keys whose nodes are not all in one component then, the nodes outside the key's largest component are held
       against all others of different components, on full sets, inside tasks and by blocks of a bounded number of sets.
       A block joins what it finds linked and returns the links that joined something: fewer than it has nodes.
    So every pair that shares a key is compared or already connected, no link between components is lost, and rows are made
    for centres and for links that connect, never for all pairs of a group.  ``sets_of(nodes)`` gives ``(node, s array<long>)``.
    """
    stars = written(shared.filter("u != node").select("u", F.col("node").alias("v")).distinct(), f"{name}-stars")
    links = written(compare(stars), f"{name}-links")
    parts = connected_components(links, f"{name}-parts").withColumnRenamed("id", "node")
    labelled = written(shared.select("key", "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}-labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    left = written(labelled.join(mixed, "key"), f"{name}-mixed")
    sets = written(sets_of(left.select("node").distinct()), f"{name}-mixed-sets")
    more = written(_held_against(left, sets, percent), f"{name}-rest")
    return connected_components(links.unionByName(more), f"{name}-components").withColumnRenamed("id", "node")


#: Sets that a task holds at a time, besides the ones that are held against them.
BLOCK = 2048


def _held_against(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)``, u < v, that connect the different components of a key, from ``left(key, node, root)``."""
    # A member that stands in one set only is no common member; a set whose rest is too small has no partner at all.
    members = sets.select("node", F.explode("s").alias("x")).groupBy("x").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = members.filter("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    able = sets.join(alone, "node", "left").filter(100 * (F.size("s") - F.coalesce("alone", F.lit(0))) >= percent * F.size("s")).select("node", "s")
    rows = written(left.join(able.select("node"), "node"), "linking-able")
    per_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = per_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    placed = rows.join(keys.select("key", "main", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "key")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Held and asking sides are both cut into blocks, and each pair of blocks is a group of its own.
    own = placed.select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), every.alias("side"), "node", "root", F.lit(False).alias("asks"))
    asking = placed.filter("root != main").select("key", every.alias("block"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"), "node", "root", F.lit(True).alias("asks"))
    full = own.unionByName(asking).join(able, "node")
    return full.repartition("key", "block", "side").sortWithinPartitions("key", "block", "side", "asks").mapInArrow(_asked(percent), "u long, v long")


def _asked(percent: int):
    def close(group: list[tuple]) -> list[tuple[int, int]]:
        held = [g for g in group if not g[3]]
        asking = [g for g in group if g[3]]
        if not held or not asking:
            return []
        sizes = np.array([len(g[4]) for g in held])
        node, root = np.array([g[1] for g in held]), np.array([g[2] for g in held])
        values, which = np.unique(np.concatenate([g[4] for g in held]), return_inverse=True)
        order = np.argsort(which, kind="stable")
        of_set = np.repeat(np.arange(len(held)), sizes)[order]
        begin = np.searchsorted(which[order], np.arange(len(values) + 1))
        # Components that are joined here already; a link within one tells nothing new.
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        out = []
        for _, own, own_root, _, s in asking:
            at, hit = found(values, s)
            at = at[hit]
            many = begin[at + 1] - begin[at]
            common = np.bincount(of_set[np.repeat(begin[at], many) + ragged(many)], minlength=len(held))
            near = np.flatnonzero((root != own_root) & (100 * common >= percent * (len(s) + sizes - common)))
            # One link to each component is enough.
            for k in near[np.unique(root[near], return_index=True)[1]].tolist():
                a, b = top(own_root), top(int(root[k]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((min(own, int(node[k])), max(own, int(node[k]))))
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        group: list[tuple] = []
        now = None
        for batch in batches:
            key, block, side, node, root, asks = (batch.column(c).to_pylist() for c in ("key", "block", "side", "node", "root", "asks"))
            s = batch.column("s")
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                if (key[i], block[i], side[i]) != now:
                    out += close(group)
                    group, now = [], (key[i], block[i], side[i])
                group.append((key[i], node[i], root[i], asks[i], s[i].values.to_numpy()))
            yield batch_of(out)
        yield batch_of(close(group))

    return run


def similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of ``pairs(u, v)``."""
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
