"""Lines that many documents share, as compressed keep bitmaps per document; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.store import column, written

#: Characters stripped from a line before it is compared (fixed by the contract).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A document, and the key of a line: 128 bits of hash each.
DOC, KEY = ["d1", "d2"], ["h1", "h2"]


#: Letters that ``lower`` changes besides A-Z.
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def _ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; only lines with other capitals take the slow way letter by letter."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_OTHER_UPPER)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _prints(*values: Column, names: list[str]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in enumerate(names)]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _documents(docs: DataFrame) -> DataFrame:
    """``(d1, d2, doc_id, text)``: id and text together are the document."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    rows = docs.select(column(docs, "doc_id", "long"), text.alias("text"))
    return rows.select(*_prints(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"), names=DOC), "doc_id", "text")


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``(h1, h2, doc_id, d1, d2, pos)`` of all lines whose key has at least ``min_chars`` characters.

    The key is the line without blanks at both ends, A-Z in lower case.  One row more per document, without a hash, has
    the number of its lines as ``pos``.
    """
    whole = F.concat(_split(F.col("text")), F.array(F.lit(None).cast("string")))
    each = _documents(docs).select(*DOC, "doc_id", F.posexplode(whole).alias("pos", "line"))
    bare = each.select(*DOC, "doc_id", "pos", F.btrim(F.col("line"), F.lit(BLANKS)).alias("bare"))
    # Lower case keeps the length, so it waits for the filter.
    keyed = bare.filter(F.col("bare").isNull() | (F.char_length("bare") >= max(min_chars, 1)))
    keyed = keyed.select(*DOC, "doc_id", "pos", _ascii_lower(F.col("bare")).alias("key"))
    hashes = [F.when(F.col("key").isNotNull(), h).alias(n) for h, n in zip(_prints(F.col("key"), names=KEY), KEY)]
    return keyed.select(*hashes, "doc_id", *DOC, "pos")


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id, d1, d2, pos)``: the first line of each key in each document.

    Hashes are range-partitioned together with the document, so a key that a third of all lines share is dealt over many
    ranges; sorted by document and position, a range streams past the window that picks the first line.
    """
    group = [*KEY, "doc_id", *DOC]
    dealt = hashes.filter("h1 is not null").repartitionByRange(*group)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("pos"))
    return dealt.withColumn("place", place).filter("place = 1").drop("place")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``(d1, d2, doc_id, n_lines, n_dropped, kept)``, one row per document and no text.

    ``kept`` is the document's keep bitmap as runs, ``array<struct<start, n>>`` of kept lines: one entry for a document
    that keeps all.  A key of at least ``min_chars`` characters that stands in at least ``min_docs`` documents loses all
    its lines, or, with ``keep_first``, all but the first one of the smallest document id (null ids last).

    Null text is one empty line; an empty key is never dropped.  Rows that repeat both id and text are one document; rows
    that share an id, or have none, with different texts are documents of their own.  An empty table gives no rows.
    """
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    # First lines are counted inside each range, so what is shuffled is about one row per key, however common it is.
    counted = first_occurrences(hashes).groupBy(*KEY).agg(F.count("*").alias("docs"), *([F.min(_place()).alias("leader")] if keep_first else []))
    # Many lines, one row per key: written, the keys are a side of known size, and a key with very many lines is split by
    # adaptive skew handling, which it is not where a join stands right on an aggregate.
    common = written(counted.filter(F.col("docs") >= min_docs).drop("docs"), "line-common")
    met = hashes.join(common, KEY)
    drops = met.filter(_place() != F.col("leader")) if keep_first else met
    ends = hashes.filter("h1 is null")
    marks = drops.select(*DOC, "doc_id", "pos", F.lit(False).alias("end")).unionByName(ends.select(*DOC, "doc_id", "pos", F.lit(True).alias("end")))
    # Copies of a row under one id repeat its marks; sets hold them once.
    folded = marks.groupBy(*DOC).agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("end"), F.col("pos"))).alias("n_lines"),
        F.array_sort(F.collect_set(F.when(~F.col("end"), F.col("pos")))).alias("gone"),
    )
    before, after = F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.col("n_lines")))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n")))
    return folded.select(
        *DOC, "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.filter(runs, lambda r: r["n"] > 0).alias("kept"),
    )


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("d1"), F.col("d2"), F.col("pos"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)``: the texts of ``docs`` with their bitmaps applied, one row per row."""
    texts = _documents(docs)
    met = texts.join(bitmaps.drop("doc_id"), DOC)
    parts = met.select("doc_id", "n_lines", "n_dropped", "kept", "text", _split(F.col("text")).alias("_lines"))
    text = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice("_lines", r["start"] + 1, r["n"]))), "\n")
    return parts.select("doc_id", "n_lines", "n_dropped", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(text).alias("kept_text"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)``, one row per row of ``docs``; see ``keep_bitmaps``."""
    kept = keep_lines(docs, keep_bitmaps(docs, min_docs, min_chars))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
