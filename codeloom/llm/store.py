"""Tables between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A session without that setting can only be one process of its own, as in tests:
    it gets a folder once.  On a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: computed once, and safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str, kind: str):
    """The first column called ``name`` in any case, as ``kind``; a null column if there is none."""
    found = [c for c in df.columns if c.lower() == name]
    return df[found[0]].cast(kind).alias(name) if found else F.lit(None).cast(kind).alias(name)


def documents(df: DataFrame) -> DataFrame:
    """``(doc_id, text)``; null text counts as empty, other columns are left behind."""
    return df.select(column(df, "doc_id", "long"), F.coalesce(column(df, "text", "string"), F.lit("")).alias("text"))
