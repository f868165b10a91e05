"""Source text → fact tables, with native expressions only.

``parse_files`` reads the text once, row by row, and drops it; everything after it
works on small extracted arrays, so no shuffle ever carries file contents.

Limits, as there is no type checker: formatted source is assumed (declarations at
column 0, members one tab in); types of initialised variables are known for plain
literals, composite literals, ``new`` and ``make``; computed constants other than plain
forms of ``iota``, fields selected on values and dot imports
need fact input or an ``external_symbols`` table.  Unknown stays '' or null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import constants as K
from codeloom.functions import gotext as G
from codeloom.functions.brackets import bound, flat, running, unflat
from codeloom.operators.structs import struct_methods
from codeloom.operators.type_defs import defined_interfaces, defined_structs, settle_definitions
from codeloom.operators.uses import SYMBOL_KEY
from codeloom.operators.values import settle_globals
from codeloom.sources.corpus import error_of
from codeloom.sources.index_store import written
from codeloom.schemas import FIELDS, FILE_KEY, METHODS, Facts, normalise

HEAD = ["project", "pkg_path", "file_path"]
_NAMES = r"^(\w++(?:\s*+,\s*+\w++)*+)"


def parse_files(source_files: DataFrame) -> DataFrame:
    """``(project, pkg_path, file_path, error, package_name, imports, decls, refs)``; a narrow step without the text.

    ``error`` is '' for a good file; one shielding of the text serves both.
    """
    kept = [c for c in source_files.columns if c != "content"]
    coded = source_files.select(*kept, G.shield(F.coalesce("content", F.lit(""))).alias("_code"))
    code = F.col("_code")
    return coded.select(
        *kept, error_of(code, code, F.lit(True)).alias("error"), G.package_name(code).alias("package_name"), G.imports(code).alias("imports"),
        G.declarations(code).alias("decls"), G.qualified_refs(code).alias("refs"),
    )


def with_aliases(parsed: DataFrame) -> DataFrame:
    """Replace ``imports`` aliases by the name each import really has, and add the map ``aliases`` name → path.

    An import without a written alias is called by the package clause of its files if
    they are in the project, else by its last path part.  Only packages whose clause
    differs from the path take part in the join.
    """
    odd = (
        parsed.select("project", F.col("pkg_path").alias("path"), "package_name")
        .filter((F.col("package_name") != "") & (F.col("package_name") != "main") & (F.col("package_name") != G.default_alias(F.col("path"))))
        .groupBy("project", "path").agg(F.min("package_name").alias("_real"))
    )
    # Narrow rows, without repeats inside the file already; the heavy rows meet only the few files with an odd name.
    unnamed = F.array_distinct(F.transform(F.filter("imports", lambda i: i["alias"] == ""), lambda i: i["path"]))
    asked = parsed.select(*FILE_KEY, F.explode(unnamed).alias("path"))
    named = asked.join(odd, ["project", "path"])
    # Written, so that its size is known before the join: the heavy rows lie still unless very many files have such a name.
    real = written(named.groupBy(*FILE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("path", "_real"))).alias("_names")))
    joined = parsed.join(real, FILE_KEY, "left")

    def settle(i: Column) -> Column:
        written = F.when(i["alias"] != "", i["alias"])
        return F.struct(F.coalesce(written, F.try_element_at("_names", i["path"]), F.lit("")).alias("alias"), i["path"].alias("path"))

    settled = joined.withColumn("imports", F.transform("imports", settle)).drop("_names")
    # Pairs are a column of their own, so that the lambda below does not compute them again for each name.
    return settled.withColumn("_pairs", G.import_pairs(F.col("imports"))).withColumn("aliases", G.import_map("_pairs")).drop("_pairs")


def go_files(parsed: DataFrame) -> DataFrame:
    return normalise(parsed.select(*HEAD, "package_name", F.col("imports.path").alias("imports")), "go_file")


def _declared(parsed: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    rows = parsed.select(*HEAD, "aliases", F.inline(F.filter("decls", of)))
    return rows.withColumn("comment", G.doc_text(F.col("doc")))


# Over flat text: the brackets inside others are hidden, so one level is all there is.
_ROUND, _SQUARE = r"\([^()]*+\)", r"\[[^\[\]]*+\]"
_FUNC = rf"^func\s*+({_ROUND})?+\s*+(\w++)({_SQUARE})?+\s*+({_ROUND})[ \t]*+((?s:.*))$"


def _inside(parens: Column) -> Column:
    return F.substring(parens, F.lit(2), F.length(parens) - 2)


def _signatures(parsed: DataFrame, received: bool) -> DataFrame:
    """Rows of methods, which are ``received``, or of functions, with receiver, name and split parameter and result lists."""
    # Told by the first bracket, so that the long fold over a signature runs once for each declaration.
    def of(d: Column) -> Column:
        method = d["text"].rlike(r"^func\s*\(")
        return (d["word"] == "func") & (method if received else ~method)

    # Written out here, once per declaration, so that no type has to look inside its own lists.
    def cut(text: Column) -> Column:
        return F.struct(*[unflat(F.regexp_extract(text, _FUNC, n)).alias(c) for n, c in enumerate(("recv", "name", "brackets", "args", "results"), 1)])

    # The filter runs inside the row; outside, the optimizer would compute the text again for it.
    cuts = F.filter(F.array(bound(flat(G.expand_func_types(F.col("text"))), cut)), lambda c: c["name"] != "")
    rows = _declared(parsed, of).select(*HEAD, "aliases", "pos", "comment", F.inline(cuts))
    result_list = F.when(F.col("results").startswith("("), _inside(F.col("results"))).otherwise(F.col("results"))
    rows = rows.withColumn("recv_type", F.regexp_extract("recv", r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\)$", 1))
    receiver_params = F.regexp_extract("recv", r"(\[[^\]]*\])\s*\)$", 1)
    return rows.select(
        *HEAD, "aliases", "pos", "comment", "recv", "recv_type", "name",
        G.type_param_names(F.when(F.col("recv") == "", F.col("brackets")).otherwise(receiver_params)).alias("tparams"),
        G.split_list(_inside(F.col("args"))).alias("args"), G.split_list(result_list).alias("results"),
    )


def _qualified(type_text: Column) -> Column:
    return G.unshield(G.qualify_type(type_text, F.col("aliases"), F.col("pkg_path"), F.col("tparams")))


def _types(parts: str) -> Column:
    return F.transform(G.expand_params(F.col(parts)), lambda p: _qualified(p["type"]))


def functions(parsed: DataFrame) -> DataFrame:
    """Top-level functions without receiver."""
    rows = _signatures(parsed, received=False)

    def param(p: Column) -> Column:
        return F.concat(F.when(p["name"] != "", F.concat(p["name"], F.lit(" "))).otherwise(F.lit("")), _qualified(p["type"]))

    out = rows.select(
        *HEAD, "pos", "name", F.concat_ws(".", "pkg_path", "name").alias("fq_name"), "comment",
        F.transform(G.expand_params(F.col("args")), param).alias("params"), _types("results").alias("returns"),
    )
    return normalise(out, "decl_func")


def methods(parsed: DataFrame) -> DataFrame:
    """Methods with their receiver's type name; parameters and results as types only."""
    rows = _signatures(parsed, received=True)
    return rows.select(*HEAD, "pos", "recv_type", "name", "comment", _types("args").alias("parameters"), _types("results").alias("returns"))


def _specs(parsed: DataFrame, *words: str) -> DataFrame:
    """One row per entry of type, var or const declarations, with group and entry comment apart.

    ``pos`` counts the entries of a file.  ``n`` is the entry's number in its declaration, and ``carried`` the type and
    value of the last entry before it that has a value: an entry of a constant group without one repeats them.
    """

    def of(d: Column) -> Column:
        def entries(found: Column) -> Column:
            valued = F.transform(found, lambda s, n: F.when(G.without_comments(s["text"]).contains("="), n))
            last = running(valued, F.lit(-1), lambda before, n: F.coalesce(n, before))

            def entry(s: Column, n: Column, at: Column) -> Column:
                tail = F.regexp_extract(G.without_comments(F.get(found, at)["text"]), _NAMES + r"((?s:.*))$", 2)
                carried = F.when((at >= 0) & (at < n), tail).otherwise(F.lit(""))
                return F.struct(d["word"].alias("word"), d["doc"].alias("group_doc"), s["doc"].alias("spec_doc"), s["text"].alias("text"), n.alias("n"), carried.alias("carried"))

            # A single entry has none before it.
            return F.when(F.size(found) == 1, F.transform(found, lambda s, n: entry(s, n, n))).otherwise(
                bound(last, lambda at: F.transform(found, lambda s, n: entry(s, n, F.get(at, n)))))

        return bound(G.specs(d["text"]), entries)

    entries = F.flatten(F.transform(F.filter("decls", lambda d: d["word"].isin(*words)), of))
    rows = parsed.select(*HEAD, "aliases", F.posexplode(entries).alias("pos", "s"))
    return rows.select(
        *HEAD, "aliases", F.col("pos").cast("bigint").alias("pos"), "s.word", G.doc_text(F.col("s.group_doc")).alias("group_doc"),
        G.doc_text(F.col("s.spec_doc")).alias("spec_doc"), "s.text", "s.n", "s.carried",
    )


_TYPE = rf"^(\w++)({_SQUARE})?+\s++(struct|interface)\s*+(\{{(?s:.*)\}})[^}}]*$"


def _type_bodies(parsed: DataFrame, kind: str) -> DataFrame:
    text = G.expand_func_types(F.col("text"))
    # Only type parameters stand before the body; a body may be long, and its brackets need no look.
    rows = _specs(parsed, "type").withColumn("text", F.when(F.col("text").rlike(r"^\w+\["), flat(text)).otherwise(text)).select(
        *HEAD, "aliases", "pos", F.when(F.col("group_doc") != "", F.col("group_doc")).otherwise(F.col("spec_doc")).alias("comment"),
        *[unflat(F.regexp_extract("text", _TYPE, n)).alias(c) for n, c in enumerate(("bare", "brackets", "kind", "body"), 1)],
    ).filter(F.col("kind") == kind)
    return rows.select(
        *HEAD, "aliases", "pos", "comment", F.concat(F.concat_ws(".", "pkg_path", "bare"), "brackets").alias("name"),
        G.type_param_names(F.col("brackets")).alias("tparams"), G.members(_inside(F.col("body"))).alias("members"),
    )


# A whole entry that is a name and the name of another type.
_DEFINED = r"^(\w++)\s*+(=?+)\s*+([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)?+)\s*+$"


def type_names(parsed: DataFrame) -> DataFrame:
    """Types that are defined by another type's name: its full name in ``target``, and whether they are aliases of it.

    Of predeclared types only the interfaces ``error`` and ``any`` are kept; a generic type with arguments is not followed.
    """
    bare = G.without_comments(F.col("text"))
    rows = _specs(parsed, "type").withColumn("bare", F.when(bare.rlike(_DEFINED), bare)).filter("bare is not null").withColumn("tparams", F.array().cast("array<string>"))
    name, equals, target = (F.regexp_extract("bare", _DEFINED, n) for n in (1, 2, 3))
    out = rows.select(
        *HEAD, "pos", F.concat_ws(".", "pkg_path", name).alias("name"), F.when(F.col("group_doc") != "", F.col("group_doc")).otherwise(F.col("spec_doc")).alias("comment"),
        _qualified(target).alias("target"), (equals != "").alias("is_alias"),
    )
    return out.filter(F.col("target").contains(".") | F.col("target").isin("error", "any"))


def structs(parsed: DataFrame) -> DataFrame:
    """Struct types with their fields; ``methods`` is filled by ``struct_methods``."""
    pattern = r"(?s)^(\w++(?:\s*+,\s*+\w++)*+)\s++(\S.*)$"

    def fields(m: Column) -> Column:
        names = F.split(F.regexp_extract(m, pattern, 1), r"\s*,\s*")
        named = F.transform(names, lambda n: F.struct(n.alias("Name"), _qualified(F.regexp_extract(m, pattern, 2)).alias("Type")))
        embedded = F.struct(F.regexp_extract(m, r"^\*?(?:\w+\.)?(\w+)", 1).alias("Name"), _qualified(m).alias("Type"))
        return F.when(m.rlike(pattern), named).otherwise(F.array(embedded))

    out = _type_bodies(parsed, "struct").select(*HEAD, "pos", "name", "comment", F.flatten(F.transform("members", fields)).cast(FIELDS).alias("fields"))
    return normalise(out, "decl_struct")


def interfaces(parsed: DataFrame) -> DataFrame:
    """Interface types: listed methods in name order, without comments, and embedded types in source order."""
    rows = _type_bodies(parsed, "interface")
    pattern = rf"(?s)^(\w++)\s*+({_ROUND})\s*+(.*)$"
    listed = F.filter("members", lambda m: m.rlike(r"^\w+\s*\("))

    def types(text: Column) -> Column:
        return F.transform(G.expand_params(G.split_list(text)), lambda p: _qualified(p["type"]))

    def method(m: Column) -> Column:
        result = unflat(F.regexp_extract(m, pattern, 3))
        return F.struct(
            F.regexp_extract(m, pattern, 1).alias("Name"), F.lit("").alias("Comment"), types(_inside(unflat(F.regexp_extract(m, pattern, 2)))).alias("Parameters"),
            types(F.when(result.startswith("("), _inside(result)).otherwise(result)).alias("ReturnTypes"),
        )

    out = rows.select(
        *HEAD, "pos", "name", "comment", F.array_sort(F.transform(listed, lambda m: bound(flat(m), method))).cast(METHODS).alias("methods"),
        F.transform(F.filter("members", lambda m: ~m.rlike(r"^\w+\s*\(")), _qualified).alias("embeddeds"),
    )
    return normalise(out, "decl_iface")


# Type of a composite literal, in flat text: '[]T', 'map[K]V', 'pkg.T', '[]struct{...}'.
_COMPOSITE = rf"^(?:(?:map)?+{_SQUARE}|\*|chan )*+(?!(?:struct|interface)\b|\w++\()(?:[A-Za-z_][\w.]*+(?:{_SQUARE})?+)$|^(?:(?:map)?+{_SQUARE}|\*)*+(?:struct|interface) ?\{{[^{{}}]*+\}}$"


def _expression(raw: Column, iota: Column) -> Column:
    """Postfix nodes with full names: of the package's own names, of imported names, of the types of conversions."""

    def full(node: Column) -> Column:
        path = F.try_element_at("aliases", F.substring_index(node["v"], ".", 1))
        name = (
            F.when(node["v"].isin("true", "false", "iota"), node["v"])
            .when(node["v"].contains(".") & path.isNotNull(), F.concat(path, F.lit("."), F.substring_index(node["v"], ".", -1)))
            .otherwise(F.concat(F.col("pkg_path"), F.lit("."), node["v"]))
        )
        shown = F.when(node["k"] == "x", name).when(node["k"] == "c", _qualified(node["v"])).otherwise(node["v"])
        return F.struct(node["k"].alias("k"), shown.alias("v"))

    # In a constant only a type stands before a bracket; in a variable it may be a function of the project.
    told = lambda nodes: F.col("is_const") | ~F.exists(nodes, lambda n: (n["k"] == "c") & ~n["v"].isin(*G.PREDECLARED))
    whole = lambda found: bound(K.postfix_of(found), lambda nodes: F.when(told(nodes), F.transform(nodes, full)))
    # A variable's call of a function is told by its tokens already.
    return bound(K.tokens(raw), lambda found: F.when(F.col("is_const") | ~K.calls(found, G.PREDECLARED), whole(found)))


def globals_(parsed: DataFrame) -> DataFrame:
    """Variables and constants, one row per name, as far as their own text says what they are."""
    return normalise(open_globals(parsed), "decl_global")


def open_globals(parsed: DataFrame) -> DataFrame:
    """``decl_global`` rows with what an unsettled type or value depends on: ``nodes`` and the ``names`` in them, the
    entry's number ``iota``, and of a single call ``callee`` and which ``result`` it gives."""
    rows = _specs(parsed, "var", "const").withColumn("bare", G.without_comments(F.col("text")))
    bare, is_const = F.col("bare"), F.col("word") == "const"
    rows = rows.withColumn("own", F.regexp_extract(bare, _NAMES + r"((?s:.*))$", 2))
    own = F.col("own")
    # A constant without a value takes type and value of the entry above it.
    rest = F.when(is_const & ~own.contains("="), F.col("carried")).otherwise(own)
    rows = rows.select(
        *HEAD, "aliases", "pos", "n", is_const.alias("is_const"),
        F.when(F.col("spec_doc") != "", F.col("spec_doc")).otherwise(F.col("group_doc")).alias("comment"),
        F.split(F.regexp_extract(bare, _NAMES, 1), r"\s*,\s*").alias("names"), rest.alias("rest"), F.array().cast("array<string>").alias("tparams"),
    ).filter(F.element_at("names", 1) != "")
    value_text = F.regexp_replace(F.regexp_extract("rest", r"(?s)^[^=]*+=(.*)$", 1), r"^\s++|\s++\z", "")
    rows = rows.select(
        "*", G.expand_func_types(F.regexp_replace(F.regexp_extract("rest", r"^([^=]*+)", 1), r"^\s++|\s++\z", "")).alias("written_type"),
        # A single name has the whole text; only a list of names is cut.
        F.when(F.size("names") == 1, F.array(value_text)).otherwise(G.split_list(value_text)).alias("values"),
    )
    # Name and value go together before they are taken apart, so no row carries the whole list.
    rows = rows.withColumn("whole", F.when((F.size("values") == 1) & (F.size("names") > 1), F.get("values", F.lit(0))))
    pairs = F.zip_with("names", F.slice("values", F.lit(1), F.size("names")), lambda name, value: F.struct(name.alias("name"), F.coalesce(value, F.lit("")).alias("raw")))
    each = rows.select(*[c for c in rows.columns if c not in ("n", "names", "values")], F.col("n").alias("entry"), F.posexplode(pairs).alias("n", "pair")).select("*", "pair.*")
    shown = each.withColumn("plain", G.unshield(F.col("raw")))
    made = F.regexp_extract("raw", r"^make\(([^,()]++)[,)]", 1)
    new = F.regexp_extract("raw", r"^new\(([^()]++)\)$", 1)
    before = F.regexp_extract("raw", rf"^&?({G.BEFORE_BODY})\{{", 1)
    composite = F.when(flat(before).rlike(_COMPOSITE), before).otherwise(F.lit(""))
    converted = F.regexp_extract(flat(F.col("raw")), rf"^({'|'.join(n for n in G.PREDECLARED if n not in ('chan', 'func', 'interface', 'map', 'struct'))})\([^()]*+\)$", 1)
    guess = (
        F.when(F.col("is_const") | (F.col("raw") == ""), G.literal_type(F.col("plain"), F.col("is_const")))
        .when(composite != "", F.concat(F.when(F.col("raw").startswith("&"), F.lit("*")).otherwise(F.lit("")), _qualified(composite)))
        .when(F.col("raw").rlike(r"(?s)^func\(.*\}$"), _qualified(G.expand_func_types(before)))
        .when(converted != "", converted).when(made != "", _qualified(made)).when(new != "", F.concat(F.lit("*"), _qualified(new)))
        .otherwise(G.literal_type(F.col("plain"), F.lit(False)))
    )
    shown = shown.withColumn("type", F.when(F.col("written_type") != "", _qualified(F.col("written_type"))).otherwise(guess))
    shown = shown.withColumn("value", F.when(F.col("is_const"), G.constant_value(F.col("plain"))).otherwise(F.col("plain")))
    # Only what neither its own text nor its type tells is looked at as an expression.
    open_ = (F.col("raw") != "") & ((F.col("type") == "") | (F.col("is_const") & (F.col("value") == "") & (F.col("type") != "untyped float")))
    nothing = F.array().cast(f"array<{K.NODE}>")
    shown = shown.withColumn("nodes", F.when(open_, F.coalesce(_expression(F.col("raw"), F.col("entry")), nothing)).otherwise(nothing))
    shown = shown.withColumn("names", F.filter(K.names_in(F.col("nodes")), lambda n: ~n.isin("true", "false", "iota")))
    shown = shown.withColumn("own", F.when((F.size("nodes") > 0) & (F.size("names") == 0), K.evaluate(F.col("nodes"), K.predeclared(F.col("entry")))))
    shown = shown.withColumn("type", F.when(F.col("type") != "", F.col("type")).otherwise(K.declared_type(F.col("own"), F.col("is_const"))))
    shown = shown.withColumn("value", F.when(F.col("is_const") & (F.col("value") == ""), F.coalesce("own.v", F.lit(""))).otherwise(F.col("value")))
    call = F.coalesce("whole", F.col("raw"))
    callee = F.when(~F.col("is_const") & (F.col("type") == ""), F.regexp_extract(flat(call), r"^([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)?)\([^()]*+\)$", 1)).otherwise(F.lit(""))
    return shown.select(
        # Both numbers have 32 bits, so they never run into each other.
        *HEAD, (F.shiftleft("pos", 32) + F.col("n")).alias("pos"), "name", F.concat_ws(".", "pkg_path", "name").alias("fq_name"), "comment",
        "type", "value", "is_const", "nodes", "names", F.col("entry").alias("iota"),
        F.when(callee != "", _qualified(callee)).otherwise(F.lit("")).alias("callee"), F.when(F.col("whole").isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("result"),
    )


def foreign_names(parsed: DataFrame) -> DataFrame:
    """References through an import name, as ``use_ref`` rows with the kind their place in the text suggests."""
    # The filter runs inside the row, before anything is exploded.
    imported = F.filter("refs", lambda r: F.map_contains_key("aliases", r["qualifier"]))
    rows = parsed.select(*HEAD, "aliases", F.inline(imported)).withColumn("target_pkg", F.try_element_at("aliases", F.col("qualifier")))
    # The coalesce keeps the optimizer from deriving, and pushing down, a null check that would compute the map twice.
    out = rows.filter(F.coalesce("target_pkg", F.lit("")) != F.col("pkg_path")).withColumn("target_name", F.col("name"))
    return normalise(out.withColumn("fq_name", F.concat_ws(".", "target_pkg", "target_name")), "use_ref")


def settle_kinds(refs: DataFrame, facts: Facts, external_symbols: DataFrame | None = None) -> DataFrame:
    """Overrule the suggested kind by what the project declares under the name.

    A type stays a type even in 'T(x)'; a function that is not called is dropped; a
    called variable is a value.  ``external_symbols(fq_name, kind, ext_type, ext_value,
    ext_is_const)`` may describe names from outside the project.
    """

    def kinds(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.select("project", F.col(name).alias("fq_name"), F.lit(kind).alias("is"))

    rows = (
        kinds(facts.decl_struct, "name", "type").unionByName(kinds(facts.decl_iface, "name", "type"))
        .unionByName(kinds(facts.decl_func, "fq_name", "call")).unionByName(kinds(facts.decl_global, "fq_name", "value"))
    )
    # A function-local type or variable may share a name; the package-level meaning sorts first.
    known = rows.groupBy(*SYMBOL_KEY).agg(F.min("is").alias("_is"))
    settled = refs.join(known, SYMBOL_KEY, "left")
    if external_symbols is not None:
        outside = external_symbols.select("fq_name", F.col("kind").alias("_outside"), *[F.col(c).alias(f"_{c}") for c in ("ext_type", "ext_value", "ext_is_const")])
        settled = settled.join(outside, ["fq_name"], "left")
        for c in ("ext_type", "ext_value", "ext_is_const"):
            settled = settled.withColumn(c, F.coalesce(c, f"_{c}"))
        settled = settled.withColumn("_is", F.coalesce("_is", "_outside"))
    uncalled = (F.col("_is") == "call") & (F.col("kind") != "call")
    return normalise(settled.filter(~F.coalesce(uncalled, F.lit(False))).withColumn("kind", F.coalesce("_is", "kind")), "use_ref")


def facts_from_parsed(
    parsed: DataFrame,
    external_symbols: DataFrame | None = None,
    strict: bool = False,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> Facts:
    """Fact tables of parsed rows.  ``keep`` may write each table as it is made, so that
    later steps start from stored rows instead of repeating the extraction."""
    named = keep("named", with_aliases(parsed))
    tables = {
        "go_file": go_files(named), "decl_func": functions(named), "decl_struct": struct_methods(structs(named), methods(named), strict),
        "decl_iface": interfaces(named),
    }
    kept = {name: keep(name, df) for name, df in tables.items()}
    defs = keep("type_names", type_names(named))
    if defs.limit(1).count():
        told = (kept["decl_struct"], kept["decl_iface"], defs)
        settled = settle_definitions(defs, *told[:2], keep)
        more = struct_methods(normalise(defined_structs(settled, *told), "decl_struct"), methods(named), strict)
        kept["decl_struct"] = kept["decl_struct"].unionByName(keep("defined_structs", normalise(more, "decl_struct")))
        kept["decl_iface"] = kept["decl_iface"].unionByName(keep("defined_interfaces", normalise(defined_interfaces(settled, *told), "decl_iface")))
    types = kept["decl_struct"].select("project", "name").unionByName(kept["decl_iface"].select("project", "name"))
    settled = settle_globals(keep("open_globals", open_globals(named)), kept["decl_func"], types, keep)
    kept["decl_global"] = keep("decl_global", normalise(settled, "decl_global"))
    refs = foreign_names(named)
    return Facts(**kept, use_ref=keep("use_ref", settle_kinds(refs, Facts(**kept, use_ref=refs), external_symbols)))
