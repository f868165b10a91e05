"""One query per operator, on the star facts or on the source text written from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import render as R
from codeloom.operators import compose as C
from codeloom.operators import extract as X
from codeloom.operators import resolve as S
from codeloom.operators import uses as U
from codeloom.operators.file_info import assemble_file_info
from codeloom.operators.graph import package_edges, package_nodes
from codeloom.operators.requests import lookup_file, serve_requests, wanted_files
from codeloom.operators.structs import dedupe_types, struct_methods
from codeloom.plans import prompts as P
from codeloom.plans.index import Index, extract
from codeloom.plans.star import star_facts, star_methods, star_source, star_sql, star_structs, stored_facts
from codeloom.schemas import FILE_KEY, func_struct, global_struct, iface_struct, normalise, struct_struct
from codeloom.sources import corpus, export, index_store

Query = Callable[[SparkSession, str], DataFrame]


def joined(items, sep: str = ",") -> Column:
    return F.coalesce(F.array_join(items, sep), F.lit(""))


def methods_text(methods) -> Column:
    return R.lines(F.col(methods) if isinstance(methods, str) else methods, lambda m: F.concat(
        m["Name"], F.lit("("), joined(m["Parameters"]), F.lit(")"), joined(m["ReturnTypes"]), m["Comment"], F.lit(";")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.parse_files(corpus.with_package_path(star_source(spark, sf_dir)))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: names are settled across files, so the rows are read several times.
    return X.with_aliases(index_store.written(parsed(spark, sf_dir)))


def symbol_map(spark, sf):
    return S.symbol_map(star_facts(spark, sf))


def foreign_refs(spark, sf):
    every = normalise(star_sql(spark, sf, "SELECT project, pkg_path, file_path, pos, target_pkg, target_name FROM all_uses"), "use_ref")
    return U.foreign_refs(every).select(*FILE_KEY, "pos", "target_pkg", "target_name")


def used_types(spark, sf):
    return U.used_types(stored_facts(spark, sf))


def used_functions(spark, sf):
    rows = U.used_functions(star_facts(spark, sf))
    return rows.select(*FILE_KEY, "pos", "fq_name", "comment", joined("params").alias("params"), joined("returns").alias("returns"))


def used_globals(spark, sf):
    return U.used_globals(star_facts(spark, sf)).select(*FILE_KEY, "fq_name", "comment", "type", "value", "is_const")


def resolve_used_types(spark, sf):
    facts = star_facts(spark, sf)
    return S.resolve_used_types(U.used_types(facts), S.type_symbols(S.symbol_rows(facts)))


def dedupe_used_items(spark, sf):
    return S.dedupe_used_items(S.resolve_uses(star_facts(spark, sf)))


def used_items_text(spark, sf):
    return C.used_text(S.resolve_uses(star_facts(spark, sf)))


def dedupe_types_(spark, sf):
    rows = star_sql(spark, sf, "SELECT project, file_path, pkg_path || '.' || p_brand AS name, pos, comment_txt AS comment FROM decls WHERE kind_id < 2")
    return dedupe_types(rows)


def struct_methods_(spark, sf):
    rows = struct_methods(star_structs(spark, sf), star_methods(spark, sf))
    return rows.select(*FILE_KEY, "name", methods_text("methods").alias("methods"))


def format_function(spark, sf):
    return star_facts(spark, sf).decl_func.select("project", "fq_name", R.format_function(func_struct("fq_name")).alias("text"))


def format_global(spark, sf):
    return star_facts(spark, sf).decl_global.select("project", "fq_name", R.format_global(global_struct("fq_name")).alias("text"))


def format_struct(spark, sf):
    return star_facts(spark, sf).decl_struct.select("project", F.col("name").alias("fq_name"), R.format_struct(struct_struct()).alias("text"))


def format_interface(spark, sf):
    return star_facts(spark, sf).decl_iface.select("project", F.col("name").alias("fq_name"), R.format_interface(iface_struct()).alias("text"))


def compose_context(spark, sf):
    return C.compose(stored_facts(spark, sf))


def star_requests(spark, sf):
    return star_sql(spark, sf, "SELECT request_id, project_path, file_path FROM requests")


def lookup_file_(spark, sf):
    facts = star_facts(spark, sf)
    paths = star_requests(spark, sf).dropna().select("request_id", F.concat_ws("/", "project_path", "file_path").alias("file_path"))
    headers = facts.go_file.select("file_path", R.format_header(F.col("file_path"), F.col("package_name"), F.col("imports")).alias("text"))
    return lookup_file(paths, headers).select("request_id", "file_path", "found", R.text_or_empty(F.col("text")).alias("text"), R.text_or_empty(F.col("error")).alias("error"))


def serve_requests_(spark, sf):
    facts, requests = stored_facts(spark, sf), star_requests(spark, sf)
    return serve_requests(requests, C.compose(facts, wanted_files(requests, facts.go_file)), facts.go_file)


def file_info(spark, sf):
    rows = assemble_file_info(stored_facts(spark, sf))

    def names(field: str) -> Column:
        return joined(F.col(f"info.{field}.Name"))

    return rows.select(
        *FILE_KEY, F.col("info.PackageName").alias("package_name"), joined(F.col("info.Imports")).alias("imports"),
        *[names(f).alias(a) for f, a in (
            ("Functions", "functions"), ("Structs", "structs"), ("Interfaces", "interfaces"), ("GlobalVars", "globals"),
            ("UsedImportedStructs", "used_types"), ("UsedImportedFunctions", "used_functions"), ("UsedImportedGlobalVars", "used_globals"))],
    )


def stored_file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as a document per project looks at it several times."""
    return index_store.written(assemble_file_info(stored_facts(spark, sf_dir)))


def export_json(spark, sf):
    return export.export_file_info_json(assemble_file_info(stored_facts(spark, sf)))


def project_json(spark, sf):
    return export.project_json_parts(stored_file_info(spark, sf))


def project_context_json(spark, sf):
    return export.project_context_parts(stored_file_info(spark, sf))


def project_report(spark, sf):
    return export.render_project_report(assemble_file_info(stored_facts(spark, sf)))


def package_nodes_(spark, sf):
    rows = package_nodes(star_facts(spark, sf))
    return rows.select("project", F.col("PkgPath").alias("pkg_path"), joined("Functions").alias("functions"), joined("DependsOn").alias("depends_on"), joined("Files").alias("files"))


def package_edges_(spark, sf):
    return package_edges(star_facts(spark, sf))


def prompt_messages(spark, sf):
    rows = P.prompt_messages(stored_file_info(spark, sf), focus="P7", minify="true")
    return rows.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def has_content(spark, sf):
    return P.has_content(assemble_file_info(stored_facts(spark, sf)))


def validate_args(spark, sf):
    asked = star_sql(spark, sf, """
      SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN ''
             ELSE 'r' || CAST(s_suppkey % 7 AS varchar(20)) END AS project FROM supplier""")
    out = P.validate_args(asked, star_facts(spark, sf).go_file.select("project").distinct())
    return out.withColumn("project", R.text_or_empty(F.col("project")))


def changed_files(spark, sf):
    source = star_source(spark, sf)
    # The older state: every tenth customer's file had another text, every eleventh did not exist.
    key = F.regexp_extract("file_path", r"/c([0-9]+)\.go$", 1).try_cast("bigint")
    old = source.filter(F.coalesce(key % 11 != 0, F.lit(True))).withColumn("content", F.when(key % 10 == 0, F.concat("content", F.lit("//"))).otherwise(F.col("content")))
    return index_store.changed_files(index_store.fingerprints(source), index_store.fingerprints(old)).select(*FILE_KEY)


# A stored index gets older text in three of the projects: constants of every tenth part were negative, some consumers were
# not there yet, and some were there that are gone now.
_OLD = "project in ('r0', 'r1', 'r2')"


def refresh_stale(spark, sf):
    """An index of the older text is stored and brought up to date: files whose contexts are to be composed again, and why."""
    key = F.coalesce(F.regexp_extract("file_path", r"/c([0-9]+)\.go$", 1).try_cast("bigint"), F.lit(1))
    source, mine = index_store.written(star_source(spark, sf)), F.expr(_OLD)
    negative = F.regexp_replace("content", r"(?m)^(const P[0-9]*0 = )", "$1-")
    old = source.filter(~mine | (key % 11 != 0)).withColumn("content", F.when(mine, negative).otherwise(F.col("content")))
    path = index_store.shared_folder(spark)
    extract(old).write(path)
    return Index.refresh(spark, path, source.filter(~mine | (key % 13 != 0)))[1]


def extract_package_imports(spark, sf):
    rows = X.go_files(parsed(spark, sf))
    return rows.select("project", "pkg_path", "file_path", "package_name", joined("imports").alias("imports"))


def extract_functions(spark, sf):
    rows = X.functions(named(spark, sf))
    return rows.select(*FILE_KEY, "name", "fq_name", "comment", joined("params").alias("params"), joined("returns").alias("returns"))


def extract_params(spark, sf):
    return X.functions(named(spark, sf)).select(*FILE_KEY, "name", F.posexplode("params").alias("n", "param")).withColumn("n", F.col("n").cast("bigint"))


def extract_returns(spark, sf):
    return X.functions(named(spark, sf)).select(*FILE_KEY, "name", F.posexplode("returns").alias("n", "type")).withColumn("n", F.col("n").cast("bigint"))


def extract_structs(spark, sf):
    rows = X.structs(named(spark, sf))
    fields = R.lines(F.col("fields"), lambda f: F.concat(f["Name"], F.lit(" "), f["Type"], F.lit(";")))
    return rows.select(*FILE_KEY, "name", "comment", fields.alias("fields"))


def extract_methods(spark, sf):
    files = named(spark, sf)
    rows = struct_methods(X.structs(files), X.methods(files))
    # The text of a method stands in source order, as its facts do.
    return rows.select(*FILE_KEY, "name", methods_text("methods").alias("methods"))


def extract_interfaces(spark, sf):
    rows = X.interfaces(named(spark, sf))
    return rows.select(*FILE_KEY, "name", "comment", methods_text("methods").alias("methods"), joined("embeddeds").alias("embeddeds"))


def extract_globals(spark, sf):
    return X.globals_(named(spark, sf)).select(*FILE_KEY, "name", "comment", "type", "value", "is_const")


def qualify_type(spark, sf):
    """Types written in the consumer files, in canonical form."""
    rows = X.globals_(named(spark, sf)).filter("name = '_'")
    return rows.groupBy(*FILE_KEY, "type").agg(F.count(F.lit(1)).alias("n"))


def extract_refs(spark, sf):
    files = named(spark, sf)
    refs = X.foreign_names(files)
    return refs.groupBy(*FILE_KEY, "kind", "target_pkg", "target_name").agg(F.count(F.lit(1)).alias("n"))


def extract_context(spark, sf):
    """Source text to context texts, through every step."""
    return extract(star_source(spark, sf)).context()


def package_path(spark, sf):
    source = star_source(spark, sf).drop("content")
    return corpus.with_package_path(source).select(*FILE_KEY, "pkg_path")


def module_path(spark, sf):
    """The same paths from module folders alone, with a module nested in every fifth package."""
    files = star_source(spark, sf).select("file_path")
    modules = star_sql(spark, sf, """
      SELECT DISTINCT '/corpus/' || project AS module_dir, 'example.com/' || project AS module_path FROM pkgs
      UNION ALL SELECT '/corpus/' || project || '/' || pkg_name, 'nested.com/' || pkg_name FROM pkgs WHERE nk % 5 = 0""")
    return corpus.with_package_path(files, modules).select(*FILE_KEY, "pkg_path")


def nonempty(spark, sf):
    asked = star_sql(spark, sf, "SELECT 'r' || CAST(s_suppkey % 7 AS varchar(20)) AS project FROM supplier")
    return corpus.require_nonempty(asked, star_facts(spark, sf).go_file)


def quarantine(spark, sf):
    """Every seventh customer's file lacks its package clause, every eighth its last brace, every ninth its text."""
    key = F.regexp_extract("file_path", r"/c([0-9]+)\.go$", 1).try_cast("bigint")
    broken = (
        F.when(key % 7 == 0, F.regexp_replace("content", r"^package \w+", ""))
        .when(key % 8 == 0, F.regexp_replace("content", r"\}\s*$", ""))
        .when(key % 9 == 0, F.lit("")).otherwise(F.col("content"))
    )
    good, bad = corpus.quarantine(star_source(spark, sf).withColumn("content", broken))
    return good.select(*FILE_KEY, F.lit("").alias("error")).unionByName(bad.select(*FILE_KEY, F.col("_error").alias("error")))


QUERIES: dict[str, Query] = {
    "symbol_map": symbol_map, "foreign_refs": foreign_refs, "used_types": used_types, "used_functions": used_functions,
    "used_globals": used_globals, "resolve_used_types": resolve_used_types, "dedupe_used_items": dedupe_used_items,
    "used_items_text": used_items_text, "dedupe_types": dedupe_types_, "struct_methods": struct_methods_,
    "format_function": format_function, "format_global": format_global, "format_struct": format_struct,
    "format_interface": format_interface, "compose_context": compose_context, "lookup_file": lookup_file_,
    "serve_requests": serve_requests_, "file_info": file_info, "export_json": export_json, "project_json": project_json,
    "project_context_json": project_context_json, "project_report": project_report, "package_nodes": package_nodes_, "package_edges": package_edges_,
    "prompt_messages": prompt_messages, "has_content": has_content, "validate_args": validate_args, "changed_files": changed_files, "refresh_stale": refresh_stale,
    "extract_package_imports": extract_package_imports, "extract_functions": extract_functions, "extract_params": extract_params,
    "extract_returns": extract_returns, "extract_structs": extract_structs, "extract_methods": extract_methods,
    "extract_interfaces": extract_interfaces, "extract_globals": extract_globals, "qualify_type": qualify_type,
    "extract_refs": extract_refs, "extract_context": extract_context, "package_path": package_path, "module_path": module_path,
    "nonempty": nonempty, "quarantine": quarantine,
}
