"""Table contracts.  Absent values are '' or an empty array, never null."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.gotext import shown_constant


STRINGS = "array<string>"
FIELDS = "array<struct<Name:string,Type:string>>"
METHODS = "array<struct<Name:string,Comment:string,Parameters:array<string>,ReturnTypes:array<string>>>"
FUNC = "struct<Name:string,Comment:string,Params:array<string>,Returns:array<string>>"
STRUCT = f"struct<Name:string,Comment:string,Fields:{FIELDS},Methods:{METHODS}>"
IFACE = f"struct<Name:string,Comment:string,Methods:{METHODS},Embeddeds:array<string>>"
GLOBAL = "struct<Name:string,Comment:string,Type:string,Value:string,IsConst:boolean>"
FILE_INFO = (
    f"struct<PackageName:string,Imports:array<string>,Functions:array<{FUNC}>,Structs:array<{STRUCT}>,"
    f"Interfaces:array<{IFACE}>,GlobalVars:array<{GLOBAL}>,UsedImportedStructs:array<{STRUCT}>,"
    f"UsedImportedFunctions:array<{FUNC}>,UsedImportedGlobalVars:array<{GLOBAL}>>"
)

FILE_KEY = ["project", "file_path"]
_HEAD = {"project": "string", "pkg_path": "string", "file_path": "string"}
_DECL = {**_HEAD, "pos": "bigint", "name": "string"}

TABLES: dict[str, dict[str, str]] = {
    "source_files": {"project": "string", "module_path": "string", "rel_path": "string", "file_path": "string", "content": "string"},
    "go_file": {**_HEAD, "package_name": "string", "imports": STRINGS},
    "decl_func": {**_DECL, "fq_name": "string", "comment": "string", "params": STRINGS, "returns": STRINGS},
    "decl_struct": {**_DECL, "comment": "string", "fields": FIELDS, "methods": METHODS},
    "decl_iface": {**_DECL, "comment": "string", "methods": METHODS, "embeddeds": STRINGS},
    "decl_global": {**_DECL, "fq_name": "string", "comment": "string", "type": "string", "value": "string", "is_const": "boolean"},
    "use_ref": {
        **_HEAD, "pos": "bigint", "kind": "string", "target_pkg": "string", "target_name": "string", "fq_name": "string",
        "ext_type": "string", "ext_value": "string", "ext_is_const": "boolean",
    },
}

# ext_* stay null when the indexer knows nothing; keys must be present.
_NULLABLE = {"ext_type", "ext_value", "ext_is_const", "project", "pkg_path", "file_path", "pos", "kind", "target_pkg", "target_name", "fq_name"}


def normalise(df: DataFrame, table: str) -> DataFrame:
    """Cast to the contract and turn nulls into ''/empty arrays/false at the table edge."""
    exprs = []
    for name, kind in TABLES[table].items():
        value = f"cast({name if name in df.columns else 'null'} as {kind})"
        if name not in _NULLABLE:
            empty = f"cast(array() as {kind})" if kind.startswith("array") else "false" if kind == "boolean" else "''"
            value = f"coalesce({value}, {empty})"
        exprs.append(f"{value} as {name}")
    return df.selectExpr(*exprs)


@dataclass(frozen=True)
class Facts:
    """The fact tables every later step works on, from any indexer or from source text."""

    go_file: DataFrame
    decl_func: DataFrame
    decl_struct: DataFrame
    decl_iface: DataFrame
    decl_global: DataFrame
    use_ref: DataFrame

    NAMES = ("go_file", "decl_func", "decl_struct", "decl_iface", "decl_global", "use_ref")

    @classmethod
    def from_tables(cls, **tables: DataFrame) -> "Facts":
        return cls(**{name: normalise(tables[name], name) for name in cls.NAMES})

    def only_files(self, wanted: DataFrame) -> "Facts":
        """Keep the rows of the wanted files; declarations stay whole, as any of them may be looked up."""
        keys = wanted.select(*FILE_KEY).distinct()
        refs = self.use_ref.join(keys, FILE_KEY, "left_semi")
        return replace(self, go_file=self.go_file.join(keys, FILE_KEY, "left_semi"), use_ref=refs)


def func_struct(name: str = "name") -> Column:
    return F.struct(F.col(name).alias("Name"), F.col("comment").alias("Comment"), F.col("params").alias("Params"), F.col("returns").alias("Returns"))


def struct_struct() -> Column:
    return F.struct(F.col("name").alias("Name"), F.col("comment").alias("Comment"), F.col("fields").alias("Fields"), F.col("methods").alias("Methods"))


def iface_struct() -> Column:
    return F.struct(F.col("name").alias("Name"), F.col("comment").alias("Comment"), F.col("methods").alias("Methods"), F.col("embeddeds").alias("Embeddeds"))


def global_struct(name: str = "name") -> Column:
    return F.struct(
        F.col(name).alias("Name"), F.col("comment").alias("Comment"), F.col("type").alias("Type"),
        F.when(F.col("is_const"), shown_constant(F.col("value"))).otherwise(F.col("value")).alias("Value"), F.col("is_const").alias("IsConst"),
    )
