"""Assemble one nested row per file, and take such rows apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import render as R
from codeloom.operators import resolve as S
from codeloom.operators.compose import compose_items, local_items, used_items
from codeloom.operators.uses import type_uses, used_functions, used_globals
from codeloom.schemas import (
    FIELDS, FILE_INFO, FILE_KEY, FUNC, GLOBAL, IFACE, METHODS, STRINGS, STRUCT, Facts, global_struct, normalise,
)

_LISTS = {"fn": FUNC, "gv": GLOBAL, "st": STRUCT, "it": IFACE, "ut": STRUCT, "uf": FUNC, "ug": GLOBAL}
#: A row of any list while it is on the way to its file: (a, b, c) places it, b is its name.
_COLUMNS = {
    "tag": "string", "a": "bigint", "b": "string", "c": "bigint", "package_name": "string", "imports": STRINGS, "comment": "string",
    "params": STRINGS, "returns": STRINGS, "fields": FIELDS, "methods": METHODS, "embeddeds": STRINGS, "type": "string", "value": "string", "is_const": "boolean",
}


def assemble_file_info(facts: Facts) -> DataFrame:
    """``file_info(project, file_path, info)`` with the lists of every file.

    All child tables are stacked into one narrow-keyed union and folded by a single
    shuffle on the file, instead of one grouping and one join per list.
    """

    def rows(df: DataFrame, tag: str, order: Column, name: Column, at: Column, **values: Column) -> DataFrame:
        own = {"tag": F.lit(tag), "a": order.cast("bigint"), "b": name, "c": at.cast("bigint"), **values}
        return df.select(*FILE_KEY, *[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS.items()])

    def each(*columns: str) -> dict[str, Column]:
        return {c: F.col(c) for c in columns}

    pos, name, used, zero = F.col("pos"), F.col("name"), F.col("fq_name"), F.lit(0)
    value = {**each("comment", "type", "is_const"), "value": global_struct("fq_name")["Value"]}
    stacked = rows(facts.go_file, "head", zero, F.lit(None), zero, **each("package_name", "imports"))
    for part in (
        rows(facts.decl_func, "fn", pos, name, pos, **each("comment", "params", "returns")),
        rows(facts.decl_global, "gv", pos, name, pos, **value),
        rows(facts.decl_struct, "st", zero, name, pos, **each("comment", "fields", "methods")),
        rows(facts.decl_iface, "it", zero, name, pos, **each("comment", "methods", "embeddeds")),
        rows(type_uses(facts), "ut", zero, used, zero),
        rows(used_functions(facts), "uf", pos, used, pos, **each("comment", "params", "returns")),
        rows(used_globals(facts), "ug", zero, used, zero, **value),
    ):
        stacked = stacked.unionByName(part)
    # Dealt out first: a partial aggregate ahead of the shuffle finds few rows of one file, and its lists are wider than they.
    listed = [c for c in _COLUMNS if c not in ("package_name", "imports")]
    folded = stacked.repartition(*FILE_KEY).groupBy(*FILE_KEY).agg(
        F.max("package_name").alias("package_name"), F.first("imports", ignorenulls=True).alias("imports"),
        F.collect_list(F.when(~F.col("tag").isin("head", "ut"), F.struct(*listed))).alias("_rows"),
        # A type is a name only, so its repeats are left out here rather than by a shuffle of their own.
        F.collect_set(F.when(F.col("tag") == "ut", F.struct("b"))).alias("_types"),
    ).filter(F.col("package_name").isNotNull())

    def of(tag: str, *fields: str) -> Column:
        def one(x: Column) -> Column:
            return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), F.struct(x["b"], *[x[c] for c in fields]).cast(_LISTS[tag]).alias("v"))

        return F.array_sort(F.transform(F.filter("_rows", lambda x: x["tag"] == tag), one)).alias(tag)

    only_name = F.transform("_types", lambda x: F.struct(
        zero.cast("bigint").alias("a"), x["b"].alias("b"), zero.cast("bigint").alias("c"),
        F.struct(x["b"], F.lit(""), F.lit(None).cast(FIELDS), F.lit(None).cast(METHODS)).cast(STRUCT).alias("v")))
    func, glob = ("comment", "params", "returns"), ("comment", "type", "value", "is_const")
    folded = folded.select(
        *FILE_KEY, "package_name", "imports", of("fn", *func), of("gv", *glob), of("st", "comment", "fields", "methods"),
        of("it", "comment", "methods", "embeddeds"), F.array_sort(only_name).alias("ut"), of("uf", *func), of("ug", *glob),
    )

    def last_of_name(arr: str):  # sorted by (name, pos): the next row has another name, or there is none
        return F.filter(arr, lambda x, i: (i == F.size(arr) - 1) | (F.col(arr)[F.least(i + 1, F.size(arr) - 1)]["b"] != x["b"]))

    merged = folded.withColumn("st", last_of_name("st")).withColumn("it", last_of_name("it"))

    def plain(arr: str) -> Column:
        return F.transform(arr, lambda x: x["v"])

    info = F.struct(
        F.col("package_name").alias("PackageName"), F.coalesce("imports", F.array().cast("array<string>")).alias("Imports"),
        plain("fn").alias("Functions"), plain("st").alias("Structs"), plain("it").alias("Interfaces"), plain("gv").alias("GlobalVars"),
        plain("ut").alias("UsedImportedStructs"),
        # No used functions is an absent list, not an empty one.
        F.when(F.size("uf") > 0, plain("uf")).alias("UsedImportedFunctions"),
        plain("ug").alias("UsedImportedGlobalVars"),
    ).cast(FILE_INFO)
    return merged.select(*FILE_KEY, info.alias("info"))


def facts_of(file_info: DataFrame) -> tuple[Facts, DataFrame]:
    """Take nested rows apart: the declaration tables, and the used items that need no lookup."""
    empty = F.array().cast("array<string>")
    head = F.lit("").alias("pkg_path")

    def each(field: str) -> DataFrame:
        return file_info.select(*FILE_KEY, head, F.posexplode(f"info.{field}").alias("pos", "d"))

    funcs = each("Functions").select(*FILE_KEY, "pkg_path", "pos", F.col("d.Name").alias("name"), F.col("d.Comment").alias("comment"), F.col("d.Params").alias("params"), F.col("d.Returns").alias("returns"))
    structs = each("Structs").select(*FILE_KEY, "pkg_path", "pos", F.col("d.Name").alias("name"), F.col("d.Comment").alias("comment"), F.col("d.Fields").alias("fields"), F.col("d.Methods").alias("methods"))
    ifaces = each("Interfaces").select(*FILE_KEY, "pkg_path", "pos", F.col("d.Name").alias("name"), F.col("d.Comment").alias("comment"), F.col("d.Methods").alias("methods"), F.col("d.Embeddeds").alias("embeddeds"))
    values = each("GlobalVars").select(
        *FILE_KEY, "pkg_path", "pos", F.col("d.Name").alias("name"), F.col("d.Comment").alias("comment"), F.col("d.Type").alias("type"),
        F.col("d.Value").alias("value"), F.col("d.IsConst").alias("is_const"),
    )
    types = each("UsedImportedStructs").select(*FILE_KEY, "pkg_path", "pos", F.lit("type").alias("kind"), F.col("d.Name").alias("fq_name"))
    facts = Facts(
        go_file=normalise(file_info.select(*FILE_KEY, head, F.col("info.PackageName").alias("package_name"), F.coalesce("info.Imports", empty).alias("imports")), "go_file"),
        decl_func=normalise(funcs, "decl_func"), decl_struct=normalise(structs, "decl_struct"), decl_iface=normalise(ifaces, "decl_iface"),
        decl_global=normalise(values, "decl_global"), use_ref=normalise(types, "use_ref"),
    )

    def given(field: str, section: int, order: Column, text) -> DataFrame:
        rows = file_info.select(*FILE_KEY, F.posexplode(f"info.{field}").alias("pos", "d"))
        return rows.select(*FILE_KEY, F.lit(section).alias("section"), order.cast("bigint").alias("ord"), F.col("d.Name").alias("fq_name"), text(F.col("d")).alias("text"), F.col("pos").cast("bigint").alias("at"))

    done = given("UsedImportedFunctions", S.USED_FUNCTIONS, F.col("pos"), R.format_function).unionByName(
        given("UsedImportedGlobalVars", S.USED_GLOBALS, F.lit(0), R.format_global)
    )
    return facts, done


def compose_file_info(file_info: DataFrame) -> DataFrame:
    """Context of nested rows: their used types are looked up among the rows of the same project."""
    facts, done = facts_of(file_info)
    used = facts.use_ref.select(*FILE_KEY, "fq_name").distinct()
    found = S.resolve_used_types(used, S.type_symbols(S.symbol_rows(facts)))
    types = found.select(*FILE_KEY, F.lit(S.USED_TYPES).alias("section"), F.lit(0).cast("bigint").alias("ord"), "fq_name", "text", F.lit(0).cast("bigint").alias("at"))
    return compose_items(local_items(facts).unionByName(used_items(types.unionByName(done))))
