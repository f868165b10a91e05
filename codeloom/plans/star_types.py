"""Queries over Go text whose types are defined by the names of other types.

Every part of the star schema is a file with a type named after it, defined by the type of the next part of its project,
which lies in another package; some are aliases.  Each 37th is a struct or an interface, so chains are up to 37 types long
and cross packages at each step.  The last part of a project names itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.index import extract
from codeloom.plans.star import STAR_CTES, star_sql
from codeloom.plans.star_queries import joined
from codeloom.schemas import FILE_KEY

#: Distance of the types with a body, and the parts that are aliases, as remainder of 7.
BODY, ALIAS = 37, 3

# Both engines run this.  j is the next part of the project; 25 parts in a row have every package, so it is at most 25 away.
CHAIN = """
  SELECT d.project, d.pkg_path, d.pkg_name, d.k, '/corpus/' || d.project || '/' || d.pkg_name || '/t' || CAST(d.k AS varchar(20)) || '.go' AS file_path,
         coalesce(u.j, -1) AS j, coalesce(o.pkg_path, '') AS next_path
  FROM decls d LEFT JOIN (
    SELECT a.k, min(b.k) AS j
    FROM (SELECT project, k, floor(k / 25) AS g FROM decls UNION ALL SELECT project, k, floor(k / 25) + 1 AS g FROM decls) a
    JOIN decls b ON b.project = a.project AND floor(b.k / 25) = a.g WHERE b.k > a.k GROUP BY a.k) u ON u.k = d.k
  LEFT JOIN decls o ON o.k = u.j"""


def type_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` with one file per part."""
    rows = star_sql(spark, sf_dir, f"SELECT * FROM ({CHAIN})")
    k, j, body, last = F.col("k").cast("string"), F.col("j").cast("string"), F.col("k") % BODY == 0, F.col("j") < 0
    defined = (
        F.when(body & (F.col("k") % 2 == 0), F.concat(F.lit("struct {\n\tF"), k, F.lit(" int\n\tG *T\n}")))
        .when(body, F.concat(F.lit("interface {\n\tDo"), k, F.lit("(a int) error\n\tT\n}"))).when(last, F.concat(F.lit("D"), k))
        .when(F.col("k") % 7 == ALIAS, F.concat(F.lit("= q.D"), j)).otherwise(F.concat(F.lit("q.D"), j))
    )
    parts = [
        F.lit("package "), F.col("pkg_name"), F.when(last, F.lit("")).otherwise(F.concat(F.lit('\n\nimport q "'), "next_path", F.lit('"'))),
        F.lit("\n\n// D"), k, F.lit(" is a type.\ntype D"), k, F.lit(" "), defined, F.lit("\n\nfunc (d *D"), k, F.lit(") M"), k, F.lit("() {\n}\n"),
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("\ntype E"), k, F.lit(" error\n"))).otherwise(F.lit("")),
    ]
    return rows.select(
        "project", F.concat(F.lit("example.com/"), "project").alias("module_path"), F.concat_ws("/", "pkg_name", F.concat(F.lit("t"), k, F.lit(".go"))).alias("rel_path"),
        "file_path", F.concat(*parts).alias("content"),
    )


def defined_types(spark, sf):
    """Structs, interfaces and circles, with the members they have from the end of their chain and with their own methods."""
    index = extract(type_source(spark, sf))
    methods = joined(F.transform("methods", lambda m: F.concat(m["Name"], F.lit("("), joined(m["Parameters"]), F.lit(")"), joined(m["ReturnTypes"])))).alias("methods")
    fields = joined(F.transform("fields", lambda f: F.concat(f["Name"], F.lit(" "), f["Type"])))
    structs = index.facts.decl_struct.select(*FILE_KEY, "name", "comment", F.lit("struct").alias("kind"), fields.alias("members"), methods)
    ifaces = index.facts.decl_iface.select(*FILE_KEY, "name", "comment", F.lit("interface").alias("kind"), joined("embeddeds").alias("members"), methods)
    none = [F.lit("").alias(c) for c in ("members", "methods")]
    circles = index.recursive_types().select(*FILE_KEY, "name", F.lit("").alias("comment"), F.lit("circle").alias("kind"), *none)
    return structs.unionByName(ifaces).unionByName(circles)


_SELECTS: dict[str, str] = {
    "defined_types": f"""
        SELECT project, file_path, pkg_path || '.D' || k AS name, CASE WHEN root IS NULL THEN '' ELSE 'D' || k || ' is a type.' END AS comment,
          CASE WHEN root IS NULL THEN 'circle' WHEN root % 2 = 0 THEN 'struct' ELSE 'interface' END AS kind,
          CASE WHEN root IS NULL THEN '' WHEN root % 2 = 0 THEN 'F' || root || ' int,G *' || root_path || '.T' ELSE root_path || '.T' END AS members,
          CASE WHEN root IS NULL THEN '' WHEN root % 2 = 0 THEN 'M' || k || '()' ELSE 'Do' || root || '(int)error' END AS methods
        FROM (SELECT c.*, r.pkg_path AS root_path FROM ended c LEFT JOIN chain r ON r.k = c.root) x
        WHERE root IS NULL OR k = root OR k % 7 <> {ALIAS}
        UNION ALL SELECT project, file_path, pkg_path || '.E' || k, '', 'interface', '', 'Error()string' FROM chain WHERE k % 4 = 1""",
}
_ENDED = f"SELECT *, min(CASE WHEN k % {BODY} = 0 THEN k END) OVER (PARTITION BY project ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS root FROM chain"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (defined_types,)}
ORACLES: dict[str, str] = {name: f"WITH {STAR_CTES}, chain AS ({CHAIN}), ended AS ({_ENDED}) {select}" for name, select in _SELECTS.items()}
