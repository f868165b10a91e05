"""Types of a file: methods joined to their struct, and same-name types merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.schemas import METHODS


def struct_methods(decl_struct: DataFrame, decl_method: DataFrame, strict: bool = False) -> DataFrame:
    """Fill ``methods`` of each struct from all files of its package.

    ``decl_method(project, pkg_path, file_path, pos, recv_type, name, comment,
    parameters, returns)``.  A comment is kept only when the method sits in the
    struct's own file; ``strict`` keeps all comments.
    """
    owner = ["project", "pkg_path", "recv_type"]
    rows = F.struct("file_path", "pos", "name", "comment", "parameters", "returns")
    gathered = decl_method.groupBy(*owner).agg(F.array_sort(F.collect_list(rows)).alias("_m"))
    bare = F.regexp_extract(F.substring(F.col("name"), F.length("pkg_path") + 2, F.length("name")), r"^(\w+)", 1)
    structs = decl_struct.drop("methods").withColumn("recv_type", bare)
    joined = structs.join(gathered, owner, "left")

    def method(m):
        comment = m["comment"] if strict else F.when(m["file_path"] == F.col("file_path"), m["comment"]).otherwise("")
        return F.struct(m["name"].alias("Name"), comment.alias("Comment"), m["parameters"].alias("Parameters"), m["returns"].alias("ReturnTypes"))

    methods = F.coalesce(F.transform("_m", method), F.array().cast(METHODS))
    return joined.withColumn("methods", methods).drop("_m", "recv_type")


def dedupe_types(decl: DataFrame) -> DataFrame:
    """Of several types with one name in a file, keep the last."""
    keys = ["project", "file_path", "name"]
    rest = [c for c in decl.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "pos")
    return decl.groupBy(*keys).agg(last.alias("_d")).select(*keys, "_d.*").select(*decl.columns)
