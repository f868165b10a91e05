"""Mix sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.store import column, written

#: Weights of the sources in code-point order, repeating (fixed by the contract).
WEIGHTS = (3, 1, 2)
#: Ranges of the sampling hash per source; the range that a target ends in is settled row by row.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A seeded number in [0, 2^48) that any SQL engine can compute."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 12), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(source, source_size)`` → with ``target``; one row per source, so the window is over sources only.

    Sources by code point, null last, take the weights in turn.  A source whose share would exceed ``epochs`` times its
    size stops there.  Sorted by the level at which they stop, the level of the rest follows from running sums:
    (wanted - what the stopped ones take) / (weights of the rest), the fixed point of resharing until none is above.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(epochs).cast("long") * F.col("source_size"))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("left", left).withColumn("rest", rest)
    # The first source that is not stopped sets the level for itself and all after it.
    free = F.col("left") * F.col("w") < F.col("cap") * F.col("rest")
    rows = rows.withColumn("first", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("rest")).alias("level"))).over(every))
    rows = rows.withColumn("level", F.col("first.left")).withColumn("over", F.col("first.rest"))
    target = F.when(F.col("over").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w") / F.col("over")))
    return rows.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, seed: str) -> tuple:
    u = draw(column(docs, "doc_id", "long"), seed)
    return column(docs, "source", "string"), word_count(column(docs, "text", "string")), u, F.shiftright(u, 48 - 12).cast("int")


def source_plan(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: ``(source, source_size, target, whole, cut_r, cut)``.

    target/size = n + f: every document counts n (``whole``) times, and a seeded part f once more, namely the documents
    up to ``cut`` in the order of their draw.  The cut is found from sums per range of draws; only the range in which a
    target ends is sorted row by row, so no source ever stands in one task.
    """
    source, size, u, r = _sized(docs, seed)
    sized = written(docs.select(column(docs, "doc_id", "long"), source, size.alias("size"), u.alias("u"), r.alias("r")), "mix-sizes")
    ranges = sized.groupBy("source", "r").agg(F.sum("size").alias("in_range"))
    filled = water_fill(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), share, epochs, weights)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    # At most RANGES rows of a source meet in this window.
    earlier = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(earlier), F.lit(0))).alias("s")
    same = F.col("s.source").eqNullSafe(F.col("f.source"))
    ends = placed.join(filled.alias("f"), same).filter("before + in_range > part").groupBy("s.source").agg(
        F.min(F.struct("s.r", "s.before", "f.part")).alias("end")
    ).select("source", "end.*")
    near = sized.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.r") == F.col("e.r")))
    until = F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    near = near.select("d.source", "doc_id", "size", "u", "before", "part").withColumn("until", F.col("before") + until)
    cuts = near.filter(F.col("until") - F.col("size") / 2 <= F.col("part")).groupBy("source").agg(F.max(F.struct("u", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")).alias("cut"))
    plan = filled.alias("f").join(ends.alias("e"), F.col("f.source").eqNullSafe(F.col("e.source")), "left").join(cuts.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")), "left")
    # Read twice by some callers and tiny: one row per source.
    return written(plan.select("f.source", "source_size", "target", "whole", F.col("e.r").alias("cut_r"), "cut"), "mix-plan")


def _repeats(docs: DataFrame, seed: str, *options) -> DataFrame:
    """``(row, doc_id, source, size, source_size, target, times)``: each row of ``docs`` as a whole and what it is taken."""
    plan = source_plan(docs, seed, *options)
    source, size, u, r = _sized(docs, seed)
    own = column(docs, "doc_id", "long")
    rows = docs.select(F.struct("*").alias("row"), own, source.alias("of"), size.alias("size"), u.alias("u"), r.alias("r"))
    # A plan of few sources is broadcast by its measured size; else the join's large side can be split.
    joined = rows.join(plan, F.col("of").eqNullSafe(F.col("source")))
    at = F.struct("u", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")
    more = (F.col("r") < F.col("cut_r")) | ((F.col("r") == F.col("cut_r")) & F.coalesce(at <= F.col("cut"), F.lit(False)))
    times = F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix_sources(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per row of ``docs``.

    A source misses its target by at most half a document, no document exceeds ``epochs`` times its size, and reruns agree.
    Null text has size 0; a null source is a source of its own; rows that repeat id and size share one decision.
    An empty table gives an empty result.
    """
    rows = _repeats(docs, seed, share, epochs, weights)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns."""
    rows = _repeats(docs, seed, share, epochs, weights).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
f AS (SELECT lft AS level, rest AS over_w FROM l WHERE lft * w < cap * rest ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM f) * w / (SELECT over_w FROM f)), cap::DOUBLE)::DOUBLE AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
             sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (size * (whole + CASE WHEN until - size / 2.0 <= part AND until - size < part THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
