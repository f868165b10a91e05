"""Load source files, give them a package path, and set bad ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import gotext as G

# Test files, and folders that a build leaves out.
_LEFT_OUT = r"(?:_test\.go$|/(?:testdata|vendor)/|/[_.][^/]*)"


def source_path() -> Column:
    """The path of the file a row was read from, without scheme and percent signs for odd characters."""
    plain = F.regexp_replace(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    return F.url_decode(plain)


def left_out(path: Column) -> Column:
    return path.rlike(_LEFT_OUT)


def _root(spark: SparkSession, path: str) -> str:
    """The folder as the file system names it, so that it can be told from what lies below it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().getPath().rstrip("/")


def load_source_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, content)`` of all Go files below ``path``, one row per file.

    What is left out by name is judged below ``path`` only, however ``path`` is written and wherever it lies.
    For very many small files keep the corpus as Parquet with the ``source_files``
    columns and use ``load_source_table``: same rows, far fewer file handles.
    """
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.go")
    files = reader.load(path).select(source_path().alias("file_path"), F.col("value").alias("content"))
    return files.filter(~left_out(F.substring(F.col("file_path"), F.lit(len(_root(spark, path)) + 1), F.length("file_path"))))


def load_source_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet corpus with the ``source_files`` columns."""
    return spark.read.parquet(path).filter(~left_out(F.concat(F.lit("/"), F.col("rel_path"))))


def load_modules(spark: SparkSession, path: str) -> DataFrame:
    """``(module_dir, module_path)`` from the module files below ``path``."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "go.mod")
    rows = reader.load(path).select(source_path().alias("file"), F.regexp_extract("value", r"(?m)^module\s++\"?([^\s\"]++)", 1).alias("module_path"))
    return rows.filter("module_path != ''").select(F.regexp_replace("file", r"/go\.mod$", "").alias("module_dir"), "module_path")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def package_path(module_path: Column, rel_path: Column) -> Column:
    """Module path plus the folder inside the module."""
    inner = F.regexp_extract(rel_path, r"^/?(.*)/[^/]*$", 1)
    return F.when(inner == "", module_path).otherwise(F.concat_ws("/", module_path, inner))


def with_package_path(files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Add ``pkg_path``, and with ``modules`` also ``project`` (the module's folder).

    Rows that carry ``module_path`` and ``rel_path`` need no join.  Otherwise each
    folder is matched to its nearest module above it by an equi-join on its parent
    folders; apply this to parsed rows, which no longer carry the text.  A file outside all modules
    stays, with null ``project`` and ``pkg_path``; ``with_errors`` and ``quarantine`` report it.
    """
    if modules is None:
        return files.withColumn("pkg_path", package_path(F.col("module_path"), F.col("rel_path"))).drop("module_path", "rel_path")
    placed = files.withColumn("_dir", _folder(F.col("file_path")))
    dirs = placed.select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    # Every folder names the topmost ones, so those are hot keys: the many side of the join, which can be split.
    under = dirs.select("_dir", F.explode(above).alias("module_dir")).join(modules, "module_dir")
    nearest = under.groupBy("_dir").agg(F.max_by(F.struct("module_dir", "module_path"), F.length("module_dir")).alias("_m"))
    inner = F.substring(F.col("_dir"), F.length("_m.module_dir") + 2, F.length("_dir"))
    path = F.when(inner == "", F.col("_m.module_path")).otherwise(F.concat_ws("/", "_m.module_path", inner))
    joined = placed.join(nearest, "_dir", "left")
    return joined.withColumn("pkg_path", F.when(F.col("_m").isNotNull(), path)).withColumn("project", F.col("_m.module_dir")).drop("_dir", "_m")


NO_MODULE = "no module"


def error_of(code: Column, content: Column, in_module: Column) -> Column:
    """'' for good source, else what is wrong with it; ``code`` is the shielded text."""

    def count(mark: str) -> Column:
        return F.length(code) - F.length(F.replace(code, F.lit(mark), F.lit("")))

    bare = F.regexp_replace(code, G.LITERAL_OR_COMMENT, " ")
    return (
        F.when(content.isNull() | (F.trim(code) == ""), F.lit("empty file"))
        .when(G.package_name(bare) == "", F.lit("missing package clause"))
        .when(count("{") != count("}"), F.lit("unbalanced braces"))
        .when((count("(") != count(")")) | (count("[") != count("]")), F.lit("unbalanced brackets"))
        .when(~in_module, F.lit(NO_MODULE))
        .otherwise(F.lit(""))
    )


def with_errors(source_files: DataFrame) -> DataFrame:
    """Add ``_error``, '' for a good row; no row is dropped.  With a ``project`` column a null there is an error too."""
    placed = F.col("project").isNotNull() if "project" in source_files.columns else F.lit(True)
    shielded = source_files.withColumn("_code", G.shield(F.coalesce("content", F.lit(""))))
    return shielded.withColumn("_error", error_of(F.col("_code"), F.col("content"), placed)).drop("_code")


def quarantine(source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows to process, and rows to report with their ``_error``."""
    marked = with_errors(source_files)
    return marked.filter("_error = ''").drop("_error"), marked.filter("_error != ''")


def require_nonempty(projects: DataFrame, files: DataFrame) -> DataFrame:
    """``projects(project)`` → ``(project, n_packages, n_files, status)``; a project without packages gets the error text."""
    # Two-level count: distinct packages first, so a huge project is never one group of raw rows.
    per_package = files.groupBy("project", "pkg_path").agg(F.count(F.lit(1)).alias("_f"))
    sizes = per_package.groupBy("project").agg(F.count(F.lit(1)).alias("n_packages"), F.sum("_f").alias("n_files"))
    zero = F.lit(0).cast("bigint")
    rows = projects.select("project").distinct().join(sizes, "project", "left")
    status = F.when(F.col("n_packages").isNull(), F.concat(F.lit("no packages found in "), F.col("project"))).otherwise(F.lit("ok"))
    return rows.select("project", F.coalesce("n_packages", zero).alias("n_packages"), F.coalesce("n_files", zero).alias("n_files"), status.alias("status"))
