"""From raw documents to encoded training text: five operators, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, language_id, mixing, near_dedup, sentencepieces
from codeloom.llm.queries import tokenizer
from codeloom.llm.store import column, shared_folder

#: Bytes that go to a Python worker at once.  Batches of ten thousand whole documents, Spark's default, stand several times in
#: the memory of an executor: in the engine, on the way and in the worker.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that no model fits, or without letters, go.

    The models learn from the labelled documents of the stage's own input whose crc32(doc_id) mod 3 is not 1.  Where none of
    those has a label and text there is no model that could reject anything: every document with a letter stays.  Null and
    empty texts go; rows that repeat stay as often as they are there.
    """
    _small_batches(spark)
    models = language_id.train(docs.filter(language_id.third(docs) != 1))
    if models is None:
        return docs.filter(F.coalesce(column(docs, "text", "string"), F.lit("")).rlike(r"\p{L}"))
    return language_id.with_language(docs, models).filter("not rejected").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % of their five-word shingles.

    The smallest id stays; rows without an id come last, each text of theirs being a document of its own.  Documents
    without words stay; rows that repeat an id and a text stay or go together.
    """
    _small_batches(spark)
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them: not at all, once or twice.

    Null text has no words and is never repeated; a null source is a source; rows that repeat an id are taken alike.
    """
    return mixing.mix_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, round_trip)`` of every row; null text has no tokens."""
    _small_batches(spark)
    return sentencepieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_text),
]

#: SQL can express neither the language models nor the near-duplicate links nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = shared_folder(spark, f"pipeline-{STAGES[-1][0]}")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
