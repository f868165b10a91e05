"""Text rendering of declarations as pure column expressions.

Each ``format_*`` takes one struct column (the field names of ``schemas.py``) and
returns the indented text block for it.  Everything stays native, so the blocks
are produced once per declaration, next to the scan, and never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDENT = "  "

# The words of the output text.
FUNCTIONS_HEAD = "Functions:\n"
GLOBALS_HEAD = "Global Variables/Constants:\n"
STRUCTS_HEAD = "Local Structs:\n"
INTERFACES_HEAD = "Local Interfaces:\n"
USED_HEAD = "Used Items From Other Packages:\n"
IMPORTS_HEAD = "Imports:\n"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def csv(items: Column) -> Column:
    return text_or_empty(F.array_join(items, ", "))


def lines(items: Column, fn) -> Column:
    """Concatenate ``fn(item)`` over an array; null and empty arrays give ''."""
    return text_or_empty(F.array_join(F.transform(items, fn), ""))


def when_any(items: Column, text: Column) -> Column:
    return F.when(F.size(F.coalesce(items, F.array())) > 0, text).otherwise(F.lit(""))


def _comment(comment: Column, indent: str) -> Column:
    return F.when(comment != "", F.concat(F.lit(f"{indent}Comment: "), comment, F.lit("\n"))).otherwise(F.lit(""))


def _methods(methods: Column, indent: str) -> Column:
    def one(m: Column) -> Column:
        return F.concat(
            F.lit(f"{indent}    - "), m["Name"], F.lit("("), csv(m["Parameters"]), F.lit(") ("),
            csv(m["ReturnTypes"]), F.lit(")\n"), _comment(text_or_empty(m["Comment"]), indent + "      "),
        )

    return when_any(methods, F.concat(F.lit(f"{indent}  Methods:\n"), lines(methods, one)))


def format_function(fn: Column, indent: str = INDENT) -> Column:
    returns = when_any(fn["Returns"], F.concat(F.lit(" -> ("), csv(fn["Returns"]), F.lit(")")))
    return F.concat(
        F.lit(f"{indent}Function: "), fn["Name"], F.lit("\n"),
        _comment(text_or_empty(fn["Comment"]), indent + "  "),
        F.lit(f"{indent}  Signature: ("), csv(fn["Params"]), F.lit(")"), returns, F.lit("\n"),
    )


def format_global(gv: Column, indent: str = INDENT) -> Column:
    kind = F.when(F.coalesce(gv["IsConst"], F.lit(False)), F.lit("Const: ")).otherwise(F.lit("Var: "))
    value = text_or_empty(gv["Value"])
    return F.concat(
        F.lit(indent), kind, gv["Name"], F.lit(" "), text_or_empty(gv["Type"]),
        F.when(value != "", F.concat(F.lit(" = "), value)).otherwise(F.lit("")), F.lit("\n"),
        _comment(text_or_empty(gv["Comment"]), indent + "  "),
    )


def format_struct(st: Column, indent: str = INDENT) -> Column:
    fields = lines(st["Fields"], lambda f: F.concat(F.lit(f"{indent}    - "), f["Name"], F.lit(" "), f["Type"], F.lit("\n")))
    return F.concat(
        F.lit(f"{indent}Struct: "), st["Name"], F.lit("\n"),
        _comment(text_or_empty(st["Comment"]), indent + "  "),
        when_any(st["Fields"], F.concat(F.lit(f"{indent}  Fields:\n"), fields)),
        _methods(st["Methods"], indent),
    )


def format_interface(it: Column, indent: str = INDENT) -> Column:
    embeds = lines(it["Embeddeds"], lambda e: F.concat(F.lit(f"{indent}    - "), e, F.lit("\n")))
    return F.concat(
        F.lit(f"{indent}Interface: "), it["Name"], F.lit("\n"),
        _comment(text_or_empty(it["Comment"]), indent + "  "),
        when_any(it["Embeddeds"], F.concat(F.lit(f"{indent}  Embeds:\n"), embeds)),
        _methods(it["Methods"], indent),
    )


def format_unresolved(name: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit("\n"))


def format_header(file_path: Column, package_name: Column, imports: Column) -> Column:
    """File line, package line, blank line, then the imports section if there is any."""
    listed = lines(imports, lambda i: F.concat(F.lit("- "), i, F.lit("\n")))
    return F.concat(
        F.lit("--- File: "), file_path, F.lit(" ---\nPackage: "), package_name, F.lit("\n\n"),
        when_any(imports, F.concat(F.lit(IMPORTS_HEAD), listed, F.lit("\n"))),
    )
