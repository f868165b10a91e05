"""References to other packages and what they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schemas import FILE_KEY, Facts

SYMBOL_KEY = ["project", "fq_name"]
#: Uses of one name are dealt to so many tasks by their file, so that a name that most files use is not one task's work.
PIECES = 4
BY_NAME = [*SYMBOL_KEY, "piece"]

# A bare named type with a package path: 'time.Duration' or 'example.com/a/b.T', but not '*a.T' or '[]a.T'.
NAMED_TYPE = r"^[^\s*()\[\]{}]+\.\w+$"


def package_of(fq_name: Column) -> Column:
    return F.regexp_extract(fq_name, r"^(.*)\.[^.]+$", 1)


def is_named_type(type_text: Column) -> Column:
    return F.coalesce(type_text.rlike(NAMED_TYPE), F.lit(False))


def foreign_refs(use_ref: DataFrame) -> DataFrame:
    """References whose target has a package that is not the file's own."""
    return use_ref.filter((F.coalesce("target_pkg", F.lit("")) != "") & (F.col("target_pkg") != F.col("pkg_path")))


def with_value_types(refs: DataFrame) -> DataFrame:
    """Add a type reference for each value whose known type is a named type of another package."""
    adds = (F.col("kind") == "value") & is_named_type(F.col("ext_type")) & (package_of(F.col("ext_type")) != F.col("pkg_path"))
    empty = F.lit(None).cast("string")
    own = F.struct("kind", "fq_name", "ext_type", "ext_value", "ext_is_const")
    typ = F.struct(
        F.lit("type").alias("kind"), F.col("ext_type").alias("fq_name"), empty.alias("ext_type"),
        empty.alias("ext_value"), F.lit(None).cast("boolean").alias("ext_is_const"),
    )
    rows = F.when(adds, F.array(own, typ)).otherwise(F.array(own))
    return refs.select("project", "pkg_path", "file_path", "pos", F.inline(rows))


def distinct_uses(use_ref: DataFrame) -> DataFrame:
    """One row per (file, kind, name) with its first position and its ``piece``, dealt out ``BY_NAME``.

    Uses lie where the join with ``in_pieces`` needs them, so the grouping has no shuffle of its own.  Only fixed-width
    values sit in the aggregation buffer, so this stays a hash aggregate and shrinks repeated calls before any join.
    """
    rows = with_value_types(foreign_refs(use_ref)).withColumn("piece", F.pmod(F.xxhash64(*FILE_KEY), F.lit(PIECES)).cast("int"))
    return (
        rows.repartition(*BY_NAME)
        .groupBy("project", "file_path", "pkg_path", "kind", "fq_name", "ext_type", "ext_value", "ext_is_const", "piece")
        .agg(F.min("pos").alias("pos"))
    )


def in_pieces(symbols: DataFrame) -> DataFrame:
    """Symbols for each piece of the uses of their name, dealt out as ``distinct_uses`` are."""
    return symbols.withColumn("piece", F.explode(F.array(*map(F.lit, range(PIECES))))).repartition(*BY_NAME)


def first_functions(decl_func: DataFrame) -> DataFrame:
    """One declaration per qualified function name: the first in file order."""
    best = F.min_by(F.struct("comment", "params", "returns"), F.struct("file_path", "pos"))
    return decl_func.groupBy(*SYMBOL_KEY).agg(best.alias("_d")).select(*SYMBOL_KEY, "_d.*")


def first_globals(decl_global: DataFrame) -> DataFrame:
    """One declaration per (package, bare name): the first in file order."""
    best = F.min_by(F.struct("comment", "type", "value", "is_const"), F.struct("file_path", "pos"))
    return decl_global.groupBy(*SYMBOL_KEY).agg(best.alias("_d")).select(*SYMBOL_KEY, "_d.*")


def used_functions(facts: Facts) -> DataFrame:
    """One row per call site of another package's function that the project declares."""
    calls = foreign_refs(facts.use_ref).filter(F.col("kind") == "call").select("project", "file_path", "pos", "fq_name")
    return calls.join(first_functions(facts.decl_func), SYMBOL_KEY)


def used_globals(facts: Facts) -> DataFrame:
    """Distinct variables and constants of other packages, from their declaration or else from what the reference knows."""
    values = distinct_uses(facts.use_ref).filter(F.col("kind") == "value")
    found = values.join(in_pieces(first_globals(facts.decl_global).withColumn("_hit", F.lit(True))), BY_NAME, "left")
    hit = F.col("_hit").isNotNull()

    def pick(decl: Column, fallback: Column) -> Column:
        return F.when(hit, decl).otherwise(fallback)

    is_const = F.coalesce("ext_is_const", F.lit(False))
    rows = found.select(
        *FILE_KEY, "pkg_path", "fq_name", "piece", "pos",
        pick(F.col("comment"), F.lit("")).alias("comment"),
        pick(F.col("type"), F.coalesce("ext_type", F.lit(""))).alias("type"),
        pick(F.col("value"), F.when(is_const, F.coalesce("ext_value", F.lit(""))).otherwise("")).alias("value"),
        pick(F.col("is_const"), is_const).alias("is_const"),
        F.coalesce("ext_type", F.when(hit, F.col("type"))).alias("object_type"),
    )
    # Differing ext_* on one name leave several rows; the earliest reference wins.  The piece follows from the file.
    best = F.min_by(F.struct("pkg_path", "comment", "type", "value", "is_const", "object_type"), F.struct("pos", "type", "value"))
    return rows.groupBy(*FILE_KEY, "fq_name", "piece").agg(best.alias("_g")).select(*FILE_KEY, "fq_name", "_g.*")


def type_uses(facts: Facts) -> DataFrame:
    """Named types of other packages, with repeats: those written in the file and those of the values it uses."""
    written = with_value_types(foreign_refs(facts.use_ref)).filter(F.col("kind") == "type").select(*FILE_KEY, "fq_name")
    of_values = (
        used_globals(facts)
        .filter(is_named_type(F.col("object_type")) & (package_of(F.col("object_type")) != F.col("pkg_path")))
        .select(*FILE_KEY, F.col("object_type").alias("fq_name"))
    )
    return written.unionByName(of_values)


def used_types(facts: Facts) -> DataFrame:
    """The distinct ones of ``type_uses``: all repeats fall away in one grouping."""
    return type_uses(facts).dropDuplicates([*FILE_KEY, "fq_name"])
