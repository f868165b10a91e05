"""Keep the fact tables on shared storage, and find what has to be extracted again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import FILE_KEY, TABLES, Facts

FINGERPRINT = [*FILE_KEY, "content_hash"]


def content_hash() -> Column:
    return F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256)


def fingerprints(source_files: DataFrame) -> DataFrame:
    """``(project, file_path, content_hash)``."""
    return source_files.select(*FILE_KEY, content_hash().alias("content_hash"))


def changed_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are new or whose text changed since they were indexed."""
    return current.join(indexed.select(*FINGERPRINT), FINGERPRINT, "left_anti")


def removed_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed files that no longer exist."""
    return indexed.select(*FILE_KEY).join(current.select(*FILE_KEY), FILE_KEY, "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is not set: both are shared storage."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/codeloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
    target = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


# Folders per table.  Projects are hashed to them, so their number does not grow with the data.
BUCKETS = 64


def _bucket(project) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(BUCKETS)).cast("int")


#: Text of the keys of changed files up to which they are sent to where the contents lie; beyond it all contents are
#: parsed where they lie and parsed rows are joined instead.  Contents move in neither case.
KEYS_AT_ONCE = 32 << 20


def _table(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def materialise_index(facts: Facts, path: str, parsed: DataFrame | None = None) -> None:
    """Write the fact tables so that reading one project touches one folder of each.

    The rebalance hint lets the engine split a bucket that holds a huge project over
    several writers and join small ones, so neither big tasks nor tiny files appear.
    ``parsed`` is kept beside them; it is what a refresh starts from.
    """
    tables = {name: getattr(facts, name) for name in Facts.NAMES} | ({} if parsed is None else {PARSED: parsed})
    for name, df in tables.items():
        _placed(df).write.mode("overwrite").partitionBy("bucket").parquet(_table(path, name))


PARSED = "parsed"


def _placed(df: DataFrame) -> DataFrame:
    rows = df.withColumn("bucket", _bucket(F.col("project")))
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "project")


def read_table(spark: SparkSession, path: str, name: str, buckets: list[int] | None = None) -> DataFrame:
    """One stored fact table with its ``bucket``; with ``buckets`` only their folders are read."""
    columns = {**TABLES[name], "bucket": "int"}
    df = spark.read.schema(", ".join(f"{c} {kind}" for c, kind in columns.items())).parquet(_table(path, name))
    return df if buckets is None else df.filter(F.col("bucket").isin(buckets))


def read_index(spark: SparkSession, path: str, project: str | None = None) -> Facts:
    def load(name: str) -> DataFrame:
        df = read_table(spark, path, name)
        if project is not None:
            df = df.filter((F.col("bucket") == _bucket(F.lit(project))) & (F.col("project") == project))
        return df.drop("bucket")

    return Facts.from_tables(**{name: load(name) for name in Facts.NAMES})


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def read_parsed(spark: SparkSession, path: str, project: str | None = None) -> DataFrame | None:
    """The parsed rows with their ``bucket``, None for an index that was written without them."""
    files, target = _folder(spark, _table(path, PARSED))
    if not files.exists(target):
        return None
    df = spark.read.parquet(_table(path, PARSED))
    return df if project is None else df.filter((F.col("bucket") == _bucket(F.lit(project))) & (F.col("project") == project))


def replace_projects(path: str, name: str, stored: DataFrame, fresh: DataFrame, projects: DataFrame, buckets: list[int]) -> None:
    """Put ``fresh`` in the place of the stored rows of ``projects``, all of which lie in ``buckets``.

    Only the folders of those buckets are written; a folder whose last project went away is removed.
    """
    rest = stored.filter(F.col("bucket").isin(buckets)).drop("bucket").join(projects, F.expr("project <=> touched"), "left_anti")
    rows = rest.unionByName(fresh.drop("bucket"), allowMissingColumns=True)
    filled = {r.bucket for r in rows.select(_bucket(F.col("project")).alias("bucket")).distinct().collect()}
    _placed(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(_table(path, name))
    for bucket in set(buckets) - filled:
        files, target = _folder(stored.sparkSession, f"{_table(path, name)}/bucket={bucket}")
        files.delete(target, True)


def matching(df: DataFrame, keys: DataFrame, columns: list[str], kind: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``columns`` are among ``keys``; nulls are equal."""
    named = keys.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(named, F.expr(" AND ".join(f"{c} <=> _{c}" for c in columns)), kind)


def parse_only(source_files: DataFrame, wanted: DataFrame, columns: list[str], parse) -> DataFrame:
    """Parsed rows of the ``wanted`` files, without a shuffle of contents whatever their number."""
    size = F.lit(0)
    for c in columns:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    if (wanted.agg(F.sum(size)).first()[0] or 0) <= KEYS_AT_ONCE:
        return parse(matching(source_files, F.broadcast(wanted), columns))
    return matching(parse(source_files), wanted, columns)


def refresh_parsed(parsed: DataFrame, source_files: DataFrame, parse, columns: list[str] = FINGERPRINT) -> DataFrame:
    """Bring parsed rows (with ``content_hash``) up to date, parsing changed files only.

    A parsed row depends on nothing but its own file, so rows of unchanged files are
    taken over as they are; whatever looks across files is derived afterwards.
    Contents are hashed and parsed where they are read; what meets in joins is keys and parsed rows.
    """
    hashed = source_files.withColumn("content_hash", content_hash())
    current = written(hashed.select(*columns))
    fresh = written(current.subtract(parsed.select(*columns)))
    return matching(parsed, current, columns).unionByName(parse_only(hashed, fresh, columns, parse), allowMissingColumns=True)
