"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.store import column, shared_folder, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """One row per distinct text: ``(text_sha256, keep_id, n_points, group_size)``.

    The table is stored bucketed and sorted by digest, so a later batch is compared by a
    sort-merge anti-join in which only the batch is shuffled.  ``buckets`` is fixed when an
    index is made; size it for the data to come (one bucket is read by one task).
    """

    KEYS = "text_sha256 string, keep_id long, n_points long, group_size long"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 64) -> "DigestIndex":
        """A new, empty index whose files lie at ``path`` (a new shared folder by default)."""
        name = name or f"digest_index_{uuid.uuid4().hex}"
        path = path or shared_folder(spark, "digest-index")
        # Made by the engine: an empty list from the driver would start Python workers on every executor, which then stay.
        empty = spark.range(0).selectExpr(*(f"cast(null as {kind}) {key}" for key, kind in (k.split() for k in cls.KEYS.split(", "))))
        empty.write.format("parquet").bucketBy(buckets, "text_sha256").sortBy("text_sha256").option("path", path).saveAsTable(name)
        return cls(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None) -> "DigestIndex":
        """An index that an earlier session stored at ``path``."""
        name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({cls.KEYS}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        return cls(spark, name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Add the texts of ``digests(doc_id, n_points, text_sha256)`` that the index has not seen.

        Of equal texts within the batch the one with most code points, then the smallest id, represents them.
        A digest that is already stored keeps its row: what an earlier batch kept stays kept.
        Copies are combined before the shuffle, so a group of any size costs a row per task.
        """
        best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
        new = digests.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        rows = new.select("text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("n_points"), "group_size")
        fresh = rows.hint("merge").join(self.table().select("text_sha256"), "text_sha256", "left_anti")
        n = self.buckets()
        fresh.select("text_sha256", "keep_id", "n_points", "group_size").repartition(n, "text_sha256").write.format("parquet").mode("append").bucketBy(n, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def buckets(self) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").collect()
        return int(rows[0].data_type)


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_points, text_sha256)`` of every row; null text counts as empty."""
    text = column(docs, "text", "string")
    rows = docs.select(column(docs, "doc_id", "long"), text)
    return rows.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), digest(F.col("text")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, buckets: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when identical without ASCII white space; null text is empty, and all empty texts are equal.
    Of equal texts the one with most code points, then the smallest doc_id stays; a null id comes after all others.
    Rows that repeat both text and id are all marked kept.  An empty table gives an empty result.
    With an ``index`` the batch is also compared with what the index holds, and its new texts are added.
    """
    index = index or DigestIndex.create(docs.sparkSession, buckets=buckets)
    rows = written(digests(docs), "digests")
    index.append(rows)
    joined = rows.join(index.table().select("text_sha256", "keep_id", "group_size"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS kept, h AS text_sha256 FROM d
"""


def drop_exact_copies(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row even where rows repeat text and id."""
    index = DigestIndex.create(docs.sparkSession, buckets=buckets)
    text, own = column(docs, "text", "string"), column(docs, "doc_id", "long")
    keyed = docs.select(F.struct("*").alias("row"), own, digest(text).alias("text_sha256"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("points"))
    index.append(digests(docs))
    same = keyed.join(index.table().select("text_sha256", "keep_id", "n_points"), "text_sha256")
    same = same.filter((F.col("points") == F.col("n_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return same.dropDuplicates(["text_sha256"]).select("row.*")
