"""Native column expressions over Go source text.

There is no parser here.  ``shield`` first moves every structural character that
sits inside a literal or a comment to a private code point, so that plain regular
expressions can cut declarations, lists and references out of the text.  All
repeats are possessive: they run as loops in the regex engine, however long the
body is, and never backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.brackets import balanced, bound, flat, unflat

# Characters hidden inside literals and comments, and the private code points they move to.
_HIDDEN = "{}()[],;=.:/*\"'`\n"
_PRIVATE = "".join(chr(0xE000 + i) for i in range(len(_HIDDEN)))

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_RUNE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_SEGMENT = rf"//[^\n]*+|/\*(?s:.*?)\*/|`[^`]*+`|{_STRING}|{_RUNE}|[^\"'`/]++|(?s:.)"
# After shielding a literal or comment holds no delimiter of its own.
LITERAL = r"\"[^\"]*+\"|`[^`]*+`|'[^']*+'"
COMMENT = r"/(?:/[^\n]*+|\*[^*]*+\*/)"
# Both, with the one look at most characters that tells them apart from the rest.
LITERAL_OR_COMMENT = rf"(?=[\"`'/])(?:{LITERAL}|{COMMENT})"


def nested(opening: str, closing: str, depth: int = 12) -> str:
    """Pattern of a balanced pair nested up to ``depth`` levels, for finding places where only types stand.

    What lies deeper is found as places of their own; declarations are cut without nested patterns (``brackets.flat``).
    """
    pattern = rf"\{opening}[^\{opening}\{closing}]*+\{closing}"
    for _ in range(depth):
        pattern = rf"\{opening}(?:[^\{opening}\{closing}]++|{pattern})*+\{closing}"
    return pattern


PARENS, BRACES, BRACKETS = nested("(", ")"), nested("{", "}"), nested("[", "]")


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def shield(content: Column) -> Column:
    """The text with unix line ends and with literals and comments hidden; ``unshield`` restores it."""
    segments = find_all(F.replace(content, F.lit("\r\n"), F.lit("\n")), _SEGMENT)

    def hide(s: Column) -> Column:
        def within(lead: int, trail: int) -> Column:
            inner = F.substring(s, F.lit(lead + 1), F.length(s) - (lead + trail))
            hidden = F.translate(inner, _HIDDEN, _PRIVATE)
            tail = F.substring(s, F.length(s) - (trail - 1), F.lit(trail)) if trail else F.lit("")
            return F.concat(F.substring(s, F.lit(1), F.lit(lead)), hidden, tail)

        quoted = (F.length(s) > 1) & (s.startswith('"') | s.startswith("`") | s.startswith("'"))
        return F.when(s.startswith("//"), within(2, 0)).when(s.startswith("/*"), within(2, 2)).when(quoted, within(1, 1)).otherwise(s)

    return F.array_join(F.transform(segments, hide), "")


def unshield(text: Column) -> Column:
    return F.translate(text, _PRIVATE, _HIDDEN)


def without_comments(code: Column) -> Column:
    return F.regexp_replace(code, COMMENT, "")


def doc_text(doc: Column) -> Column:
    """Comment text without markers, directives, edge blanks and repeated blank lines."""
    shown = unshield(doc)
    steps = (
        (r"(?m)^[ \t]++(?=//|/\*)", ""),
        (r"(?m)^//(?:line |extern |export |[a-z0-9]++:[a-z0-9])[^\n]*+\n?", ""),
        (r"(?m)^// ?", ""),
        (r"(?m)^/\*|\*/$", ""),
        (r"(?m)[ \t]++$", ""),
        (r"\n{3,}+", "\n\n"),
        (r"^\s++|\s++$", ""),
    )
    for pattern, new in steps:
        shown = F.regexp_replace(shown, pattern, new)
    return shown


def package_name(code: Column) -> Column:
    return F.regexp_extract(code, r"(?m)^package[ \t]++(\w++)", 1)


_IMPORT_BLOCK = r"(?m)^import\b[ \t]*+(?:\([^()]*+\)|[^\n]*+)"


def imports(code: Column) -> Column:
    """``array<struct<alias, path>>`` in source order; alias '' when none is written."""
    blocks = F.transform(find_all(code, _IMPORT_BLOCK), lambda b: F.regexp_replace(b, r"^import\b", ""))
    specs = find_all(without_comments(F.array_join(blocks, "\n")), r"(?:[\w.]++[ \t]++)?+(?:\"[^\"]*+\"|`[^`]*+`)")

    def one(s: Column) -> Column:
        path = F.regexp_extract(s, r"[\"`]([^\"`]*+)[\"`]$", 1)
        return F.struct(F.regexp_extract(s, r"^([\w.]++)[ \t]", 1).alias("alias"), unshield(path).alias("path"))

    return F.transform(specs, one)


def default_alias(path: Column) -> Column:
    """Last path part, version parts left out."""
    last = F.regexp_extract(path, r"([^/]+?)(?:/v[0-9]+)?$", 1)
    return F.regexp_replace(last, r"\.v[0-9]+$", "")


def import_pairs(found: Column) -> Column:
    """``array<struct<k, v>>`` of the name used in the file and the import path; blank and dot imports name nothing."""
    named = F.filter(found, lambda i: ~i["alias"].isin("_", "."))
    return F.transform(named, lambda i: F.struct(F.when(i["alias"] != "", i["alias"]).otherwise(default_alias(i["path"])).alias("k"), i["path"].alias("v")))


def import_map(pairs: str) -> Column:
    """Map of a pair column; a later import of the same name replaces an earlier one."""
    names = F.array_distinct(F.col(f"{pairs}.k"))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


_DOC = r"(?:^[ \t]*+//[^\n]*+\n|^[ \t]*+/\*[^\n]*+\n)++"
# A declaration runs on until a line that starts another one or a comment at column 0.
_TOP = r"^(?:func|type|var|const)\b[^\n]*+(?:\n(?!(?:func|type|var|const|import)\b|/[/*])[^\n]*+)*+"
_SPEC = r"^\w[^\n]*+(?:\n(?![\w/])[^\n]*+)*+"
_INNER = r"^(\t++)(?:type|var|const)\b[^\n]*+(?:\n++\1[\t)}][^\n]*+)*+"


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s++\z", "")


def _cut(text: Column, body: str) -> Column:
    """``array<struct<doc, text>>`` of the pieces matching ``body``, each with the comment right above it.

    A comment block is always consumed whole, with or without a piece below, so the scan is linear.
    ``body`` stands twice in the pattern, so its own group is 1 in one place and 2 in the other.
    """
    again = body.replace(r"\1", r"\2")
    pieces = find_all(text, rf"(?m){_DOC}(?:{body})?+|{again}")

    def one(p: Column) -> Column:
        doc = F.regexp_extract(p, rf"(?m)\A({_DOC})", 1)
        return F.struct(doc.alias("doc"), _rstrip(F.substring(p, F.length(doc) + 1, F.length(p))).alias("text"))

    return F.filter(F.transform(pieces, one), lambda d: d["text"] != "")


def _dedent(text: Column) -> Column:
    tabs = F.regexp_extract(text, r"^(\t++)", 1)
    return F.substring(F.replace(F.concat(F.lit("\n"), text), F.concat(F.lit("\n"), tabs), F.lit("\n")), F.lit(2), F.length(text))


def declarations(code: Column) -> Column:
    """``array<struct<pos, word, doc, text>>``: every declaration, function-local ones after their function.

    Function bodies are dropped; positions follow the source.
    """
    def own_and_inner(d: Column) -> Column:
        word = F.regexp_extract(d["text"], r"^(\w++)", 1)
        own = F.struct(word.alias("word"), d["doc"].alias("doc"), d["text"].alias("text"))
        inner = F.transform(_cut(d["text"], _INNER), lambda i: F.struct(_dedent(i["text"]).alias("text"), i["doc"].alias("doc")))
        kept = F.transform(
            inner,
            lambda i: F.struct(F.regexp_extract(i["text"], r"^(\w++)", 1).alias("word"), i["doc"].alias("doc"), i["text"].alias("text")),
        )
        return F.concat(F.array(own), kept)

    flat = F.flatten(F.transform(_cut(code, _TOP), own_and_inner))

    def place(d: Column, n: Column) -> Column:
        head = F.when(d["word"] == "func", func_head(d["text"])).otherwise(d["text"])
        return F.struct(n.cast("bigint").alias("pos"), d["word"].alias("word"), d["doc"].alias("doc"), head.alias("text"))

    return F.transform(flat, place)


# A result type: everything up to the body's brace.
_RESULT = rf"(?:interface ?{BRACES}|struct ?{BRACES}|func ?{PARENS} ?|{BRACKETS}|<-|chan(?:<-)? |[\w.*])++"
# Before the body, or before the values of a composite literal, a brace only opens a struct or interface type.
BEFORE_BODY = r"(?:[^{]++|(?<=\b(?:struct|interface) ?)\{)*+"


def func_head(text: Column) -> Column:
    """Function declaration without its body and comments."""
    return _rstrip(F.regexp_extract(without_comments(text), rf"\A({BEFORE_BODY})", 1))


def specs(text: Column) -> Column:
    """``array<struct<doc, text>>`` of a type, var or const declaration, grouped or single."""
    rest = F.regexp_replace(text, r"^(?:type|var|const)\s++", "")
    group = F.regexp_extract(text, r"(?s)^(?:type|var|const)\s*+\(\n?(.*)\)[^)]*$", 1)
    lines = F.replace(F.concat(F.lit("\n"), group), F.lit("\n\t"), F.lit("\n"))
    return F.when(text.rlike(r"^(?:type|var|const)\s*+\("), _cut(lines, _SPEC)).otherwise(F.array(F.struct(F.lit("").alias("doc"), rest.alias("text"))))


_MEMBER = r"^[\w*(~\[][^\n]*+(?:\n(?![\w*(~\[])[^\n]*+)*+"


def members(body: Column) -> Column:
    """Fields or methods of a type body, one text each."""
    bare = without_comments(body)
    lines = find_all(F.replace(F.concat(F.lit("\n"), bare), F.lit("\n\t"), F.lit("\n")), rf"(?m){_MEMBER}")
    pieces = F.when(F.instr(F.trim(bare), "\n") > 0, lines).otherwise(F.transform(F.split(flat(bare), ";|\n"), unflat))
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, rf"^\s++|\s*+(?:{LITERAL})?\s*+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def split_list(text: Column) -> Column:
    """Parts of a list, cut at top-level commas only, however deep its brackets nest."""
    parts = F.transform(F.split(flat(without_comments(text)), ","), lambda p: unflat(F.regexp_replace(p, r"^\s++|\s++$", "")))
    return F.filter(parts, lambda p: p != "")


# A part that reads 'name type'; a type of two words does not.
_NAMED = r"(?s)^(?!(?:chan|func|map|struct|interface)\b)\w++\s++\S"


def expand_params(parts: Column) -> Column:
    """``array<struct<name, type>>`` of a split parameter list, one entry per name; name '' when unnamed.

    In a list with names, a part without a type takes the next one's: 'a, b int'.
    """
    some_named = F.exists(parts, lambda p: p.rlike(_NAMED))

    def typed(p: Column) -> Column:
        return F.regexp_extract(p, r"(?s)^\w++\s++(.*)$", 1)

    def named(p: Column, n: Column) -> Column:
        rest = F.filter(F.slice(parts, n + 1, F.size(parts)), lambda q: q.rlike(_NAMED))
        return F.struct(F.regexp_extract(p, r"^(\w++)", 1).alias("name"), F.coalesce(typed(F.get(rest, F.lit(0))), F.lit("")).alias("type"))

    return F.when(some_named, F.transform(parts, named)).otherwise(F.transform(parts, lambda p: F.struct(F.lit("").alias("name"), p.alias("type"))))


# Predeclared type names, and the words a type may contain.
PREDECLARED = (
    "any", "bool", "byte", "comparable", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32",
    "int64", "rune", "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr",
    "chan", "func", "interface", "map", "struct",
)
# A name right before a type (a parameter of a nested function type, a field of an inline struct) keeps its blank and
# stays as it is; so does a name right before a list (a method of an inline interface).
_TYPE_TOKEN = r"\w++\.\w++|\w++\s++(?=[\w*\[.<(])|\w++\(|\w++|\W++"
# The third but last of them, where it is no predeclared name, in text whose blanks are single and whose names hold no dot.
_OWN_NAME = rf"(?<!\w)(?!(?:{'|'.join(PREDECLARED)})(?!\w))([A-Za-z_]\w*+)(?!\(|\s++[\w*\[.<(])"


# An inline struct or interface is shown on one line: 'struct{A int; B string}'.
_TYPE_LAYOUT = (
    (r"^\.\.\.\s*+", "[]"),
    (r"\b(struct|interface)\s*+\{\s*+", "$1{"),
    (r"\s++\}", "}"),
    (r"(?<![(,{])[ \t]*+\n\s*+", "; "),
    (r"\s++", " "),
)
# Text that the layout may change.
_LAID_OUT = r"[{}\t\n\x0B\f\r]|  |^\.\.\."


# Brackets and commas of lists that are kept as they are, while the lists around them are looked at, and the borders of a
# number that stands for a list of settled parameters.
_LIST, _SETTLED = "(),", "\uE020\uE021\uE022"
_OPEN, _SHUT_AT = "\uE025", "\uE026"
# How a bracket is read: parameters or results, anything else, and what stands behind a bracket that was never opened.
_PARAMS, _OTHER, _STUCK = range(3)


# Formatted lists of which a pattern alone can tell the parts: blanks only where the formatter puts them, no comment or
# literal, nothing to cut inside square and curly brackets, every round bracket with its partner, and parameters or results
# in all of them that hold a comma or a bracket.
_WORDS = r"(?:chan|func|map|struct|interface)\b"
_LONE = r"\((?<![\w)]\()(?<!\) \()(?![^(),]*+\))"
_UNEVEN = rf"[/\"'`\t\n\x0B\f\r\uE020-\uE026]|(?=[ (,\[{{])(?:  |\( | [),]|,(?! [^ ,)])|[\[{{][^\]}}]*+[,;()\[{{]|{_LONE})"
_EVEN = rf"^(?:[^(),]++|{balanced('(', ')')})*+$"
# A name that shares the type of a later one, as far as no bracket stands in that type.
_SHARED = rf"([(,] ?+\w++)(?=,(?: \w++,)*+ (?!{_WORDS})\w++ ([^,()]++)[,)])"
# A list of types without names, and a part without a name.
_UNNAMED = rf"\((?:(?!(?!{_WORDS})\w++ )[^,()]++(?:, (?!(?!{_WORDS})\w++ )[^,()]++)*+)?+\)"
_NAMELESS = rf"[(,] ?+(?!(?!{_WORDS})\w++ )"


def _shared_types(text: Column) -> Column:
    """``expand_func_types`` of formatted text by patterns, null where they don't tell all of its lists."""
    done = lambda t: F.when(~F.regexp_replace(t, _UNNAMED, "").rlike(_NAMELESS), t)
    return F.when(~text.rlike(_UNEVEN) & text.rlike(_EVEN), bound(F.regexp_replace(text, _SHARED, "$1 $2"), done))


def _put_back(text: Column, lists: Column) -> Column:
    """The text with numbers replaced by the lists that they stand for."""
    pieces = lambda t: find_all(t, rf"{_OPEN}[0-9]++{_SHUT_AT}|[^{_OPEN}]++")
    of = lambda p: F.get(lists, F.substring(p, F.lit(2), F.length(p) - 2).cast("int"))
    whole = lambda t: F.array_join(F.transform(pieces(t), lambda p: F.when(p.startswith(_OPEN), of(p)).otherwise(p)), "")
    return bound(text, lambda t: F.when(t.contains(_OPEN), whole(t)).otherwise(t))


def expand_func_types(type_text: Column) -> Column:
    """Each name of a nested list with its own type: 'func(a, b int)' as 'func(a int, b int)'.

    One fold over the round brackets.  A list is settled where it closes; in the list around it a number stands for it, so
    no text is looked at again at each level above it.  A list behind a word, or behind another list, holds parameters or
    results; any other bracket stays as it is, and so does one that is never closed or was never opened.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("texts"), F.array().cast("array<int>").alias("kinds"), none.alias("lists"), F.lit(_OTHER).alias("after"))

    def state(texts: Column, kinds: Column, lists: Column, after: Column) -> Column:
        return F.struct(texts.alias("texts"), kinds.alias("kinds"), lists.alias("lists"), after.alias("after"))

    def settled(body: Column) -> Column:
        entry = bound(split_list(body), lambda found: F.transform(expand_params(found), lambda p: F.when(p["name"] == "", p["type"]).otherwise(F.concat_ws(" ", p["name"], p["type"]))))
        return F.concat(F.lit("("), F.array_join(entry, ", "), F.lit(")"))

    def step(acc: Column, t: Column) -> Column:
        texts, kinds, lists, after = acc["texts"], acc["kinds"], acc["lists"], acc["after"]
        size = F.size(texts)
        last = F.element_at(texts, -1)
        below = F.slice(texts, F.lit(1), size - 1)
        # Behind a list only a blank may stand before its results.
        kind = F.when(t.rlike(r"\b\w++\($"), _PARAMS).when(t.isin("(", " ("), after).otherwise(_OTHER)
        opened = state(F.concat(below, F.array(F.concat(last, F.substring(t, F.lit(1), F.length(t) - 1)), F.lit(""))), F.concat(kinds, F.array(kind)), lists, F.lit(_OTHER))

        # No state passes through `bound`, which would copy all its texts.
        body = F.concat(last, F.substring(t, F.lit(1), F.length(t) - 1))
        whole = F.concat(F.lit("("), body, F.lit(")"))
        lower, rest = F.slice(texts, F.lit(1), size - 2), F.slice(kinds, F.lit(1), F.size(kinds) - 1)

        def into(shown: Column) -> Column:
            return F.concat(lower, F.array(F.concat(F.element_at(texts, -2), shown)))

        number = F.concat(F.lit(_OPEN), F.size(lists).cast("string"), F.lit(_SHUT_AT))
        closes = t.endswith(")") & (size > 1)
        return (
            F.when(t.endswith("("), opened)
            .when(closes & (F.element_at(kinds, -1) == _PARAMS), state(into(number), rest, F.concat(lists, F.array(_put_back(settled(body), lists))), F.lit(_PARAMS)))
            .when(closes & (F.element_at(kinds, -1) == _OTHER), state(into(F.translate(whole, _LIST, _SETTLED)), rest, lists, F.lit(_PARAMS)))
            .when(closes, state(into(whole), rest, lists, F.lit(_STUCK)))
            .otherwise(state(F.concat(below, F.array(F.concat(last, t))), kinds, lists, F.when(t.endswith(")"), _STUCK).otherwise(_OTHER)))
        )

    def finish(acc: Column) -> Column:
        whole = _put_back(F.array_join(acc["texts"], "("), acc["lists"])
        return F.translate(whole, _SETTLED, _LIST)

    def whole(text: Column) -> Column:
        tokens = find_all(text, r"[^()]*+[()]|[^()]++")
        return F.when(text.rlike(r"\bfunc\(|\binterface ?\{ *[^} ]"), F.coalesce(_shared_types(text), F.aggregate(tokens, start, step, finish))).otherwise(text)

    return bound(type_text, whole)


# An inline struct or interface without one in it, and the braces of one that is settled.
_FLAT_BODY = r"\b(?:struct|interface)\{[^{}]*+\}"
_BRACES, _SHUT = "{}", "\uE023\uE024"
_SHARED_TYPE = r"^(\w++(?:, ?\w++)++) (\S.*)$"


def expand_struct_types(type_text: Column) -> Column:
    """Each field of an inline struct with its own type: 'struct{A, B int}' as 'struct{A int; B int}', however deep."""

    def apart(field: Column) -> Column:
        names = F.split(F.regexp_extract(field, _SHARED_TYPE, 1), ", ?")
        shared = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(" "), F.regexp_extract(field, _SHARED_TYPE, 2))), "; ")
        return F.when(field.rlike(_SHARED_TYPE), shared).otherwise(field)

    def settle(piece: Column) -> Column:
        body = F.substring(piece, F.lit(8), F.length(piece) - 8)
        fields = F.concat(F.lit("struct{"), F.array_join(F.transform(F.split(body, "; ?"), apart), "; "), F.lit("}"))
        return F.translate(F.when(piece.startswith("struct"), fields).otherwise(piece), _BRACES, _SHUT)

    def one_pass(text: Column, _: Column) -> Column:
        pieces = find_all(text, rf"{_FLAT_BODY}|(?s:(?!{_FLAT_BODY}).)++")
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^{_FLAT_BODY}$"), settle(p)).otherwise(p)), "")

    levels = F.length(type_text) - F.length(F.replace(type_text, F.lit("{"), F.lit("")))
    settled = F.aggregate(F.sequence(F.lit(1), levels), type_text, one_pass)
    return F.when(type_text.contains("struct{") & type_text.contains(","), F.translate(settled, _SHUT, _BRACES)).otherwise(type_text)


def qualify_type(type_text: Column, aliases: Column, pkg_path: Column, type_params: Column | None = None) -> Column:
    """Canonical type text: imported names by import path, local names by package path, '...T' as '[]T'."""
    params = type_params if type_params is not None else F.array().cast("array<string>")

    def laid_out(text: Column) -> Column:
        tidy = text
        for pattern, new in _TYPE_LAYOUT:
            tidy = F.regexp_replace(tidy, pattern, new)
        return F.when(text.rlike(_LAID_OUT), bound(tidy, expand_struct_types)).otherwise(text)

    def token(t: Column) -> Column:
        path = F.try_element_at(aliases, F.substring_index(t, ".", 1))
        local = t.rlike(r"^[A-Za-z_]\w*+$") & ~t.isin(*PREDECLARED) & ~F.array_contains(params, t)
        return (
            F.when(t.rlike(r"^\w++\.\w++$") & path.isNotNull(), F.concat(path, F.lit("."), F.substring_index(t, ".", -1)))
            .when(local, F.concat(pkg_path, F.lit("."), t))
            .otherwise(t)
        )

    def whole(tidy: Column) -> Column:
        # Without names of other packages and of type parameters every name is the package's own.
        own = F.regexp_replace(tidy, _OWN_NAME, F.concat(F.regexp_replace(pkg_path, r"([\\$])", r"\\$1"), F.lit(".$1")))
        single = (F.size(params) == 0) & pkg_path.isNotNull() & ~tidy.rlike(r"\w\.\w")
        return F.when(single, own).otherwise(F.array_join(F.transform(find_all(tidy, _TYPE_TOKEN), token), ""))

    return bound(bound(F.regexp_replace(type_text, r"^\s++|\s++\z", ""), laid_out), whole)


def type_param_names(brackets: Column) -> Column:
    """Names in '[T any, K comparable]' or '[T, K]'."""
    inner = F.regexp_replace(F.coalesce(brackets, F.lit("")), r"^\[|\]$", "")
    return F.transform(split_list(inner), lambda p: F.regexp_extract(p, r"^(\w++)", 1))


# Places where only types stand: signatures, struct and interface bodies, map keys, type assertions.
# A first look at the next character spares most of them the dearer look for the border of a word.
_TYPES_ONLY = rf"(?=f)\bfunc\b[ \t]*+(?:{PARENS}[ \t]*+)?+\w*+(?:{BRACKETS})?+[ \t]*+(?:{PARENS}[ \t]*+(?:{PARENS}|{_RESULT})?+)?+|(?=[si])\b(?:struct|interface)[ \t]*+{BRACES}|(?=m)\bmap{BRACKETS}(?:{BRACKETS}|[*\w.])*+|\.{PARENS}"
_QUALIFIED = r"(?=[A-Za-z_])(?<![\w.])\w++\.[A-Za-z_]\w*+"
# Reference: what stands before it, qualifier, selector, and what follows.  A '*' right behind a value multiplies.
_REF = rf"(?=[\t \w*\]])(?:^[\t ]++|(?=\w)\b\w++[ \t]++|(?=\*)(?:(?<![\w)\]])|(?<=\[\]))\*|\])?+{_QUALIFIED}(?:\(|\{{|[ \t]*+$)?+"
_STATEMENT = "^(?:return|case|range|go|defer|if|else|switch|for|package|import|select)\\b"


def qualified_refs(code: Column) -> Column:
    """``array<struct<pos, qualifier, name, kind>>`` of everything that reads ``qualifier.Name``.

    ``kind`` is 'call' before '(', 'type' where only a type can stand, else 'value';
    declarations of the project overrule it later.
    """
    masked = F.regexp_replace(F.regexp_replace(code, _IMPORT_BLOCK, ""), rf"{LITERAL_OR_COMMENT}|\.\.\.", " ")

    def ref(name: Column, kind: Column) -> Column:
        return F.struct(F.substring_index(name, ".", 1).alias("qualifier"), F.substring_index(name, ".", -1).alias("name"), kind.alias("kind"))

    def alone(r: Column) -> Column:
        name = F.regexp_extract(r, r"([A-Za-z_]\w*\.[A-Za-z_]\w*)[^\w.]*$", 1)
        lead = F.regexp_extract(F.substring_index(r, ".", 1), r"^(.*?)\w+$", 1)
        by_itself = lead.rlike(r"^[\t ]+$") & ~r.rlike(r"[({]$")
        after_name = lead.rlike(r"^\w+[\t ]+$") & ~lead.rlike(_STATEMENT)
        kind = (
            F.when(r.endswith("("), F.lit("call"))
            .when(r.endswith("{") | by_itself | after_name | lead.rlike(r"^[*\]]"), F.lit("type"))
            .otherwise(F.lit("value"))
        )
        return ref(name, kind)

    def each(piece: Column) -> Column:
        only = piece.rlike(r"^(?:func\b|(?:struct|interface)[ \t]*\{|map\[|\.\()")
        return F.when(only, F.transform(find_all(piece, _QUALIFIED), lambda n: ref(n, F.lit("type")))).otherwise(F.array(alone(piece)))

    flat = F.flatten(F.transform(find_all(masked, rf"(?m){_TYPES_ONLY}|{_REF}"), each))
    # Most pieces of a signature name no package; they leave nothing.
    return F.transform(flat, lambda r, n: F.struct(n.cast("bigint").alias("pos"), r["qualifier"].alias("qualifier"), r["name"].alias("name"), r["kind"].alias("kind")))


# Literal shapes: (pattern, constant type, variable type).
_LITERAL_TYPES = (
    (r"^(?:true|false)$", "untyped bool", "bool"),
    (r"^(?s:\".*\"|`.*`)$", "untyped string", "string"),
    (r"^(?s:'.*')$", "untyped rune", "rune"),
    (r"^-?(?:[0-9][0-9_]*|0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+)$", "untyped int", "int"),
    (r"^-?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*|[0-9][0-9_]*(?:\.[0-9_]*)?[eE][+-]?[0-9]+)$", "untyped float", "float64"),
)


def literal_type(value: Column, is_const: Column) -> Column:
    """Type of a plain literal, '' for any other expression."""
    out = F.when(value == "", F.lit(""))
    for pattern, const_type, var_type in _LITERAL_TYPES:
        out = out.when(value.rlike(pattern), F.when(is_const, F.lit(const_type)).otherwise(F.lit(var_type)))
    return out.otherwise(F.lit(""))


# A constant string is shown with at most 72 characters, a longer one as 69 and dots.
SHOWN_CHARS, CUT_CHARS = 72, 69


def shown_constant(value: Column) -> Column:
    """A stored constant as it is shown: long strings cut."""
    return F.when(value.startswith('"') & (F.length(value) > SHOWN_CHARS), F.concat(F.substring(value, 1, CUT_CHARS), F.lit("..."))).otherwise(value)


# Whole numbers beyond 38 digits are arrays of limbs, the lowest first.
_LIMB_DIGITS = 9


def _from_base(digits: Column, bits: int) -> Column:
    """Decimal text of digits to a base of 2^bits, however many: schoolbook multiplication limb by limb."""
    width = 28 // bits
    limb = F.lit(10**_LIMB_DIGITS).cast("bigint")
    padded = F.lpad(digits, (F.ceil(F.length(digits) / width) * width).cast("int"), F.lit("0"))

    def step(limbs: Column, chunk: Column) -> Column:
        start = F.struct(F.conv(chunk, 1 << bits, 10).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, x: Column) -> Column:
            total = x * F.lit(1 << width * bits).cast("bigint") + acc["carry"]
            return F.struct(F.call_function("div", total, limb).alias("carry"), F.array_append(acc["out"], total % limb).alias("out"))

        return F.aggregate(limbs, start, one, lambda acc: F.array_append(acc["out"], acc["carry"]))

    limbs = F.aggregate(find_all(padded, f".{{{width}}}"), F.array(F.lit(0).cast("bigint")), step)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), _LIMB_DIGITS, "0")), "")
    return F.when(digits != "", F.regexp_replace(text, "^0+(?=.)", "")).otherwise(F.lit(""))


def _six_digits(number: Column) -> Column:
    """Six significant digits without zeros at the end."""
    text = F.format_string("%.6g", number.try_cast("double"))
    text = F.when(text.rlike("^-?[0-9]"), text).otherwise(F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


# One-character escapes in a rune literal, and their code points.
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34}


def constant_value(literal: Column) -> Column:
    """Value of a literal constant, '' where it would have to be computed; strings are whole."""
    digits = F.replace(literal, F.lit("_"), F.lit(""))
    sign = F.when(digits.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.regexp_replace(digits, "^-", "")
    based = F.regexp_extract(bare, r"^0[xXoObB]?([0-9a-fA-F]+)$", 1)

    def whole(pattern: str, bits: int) -> Column:
        signed = lambda number: F.when(number == "", F.lit("")).otherwise(F.concat(F.when(number != "0", sign).otherwise(F.lit("")), number))
        return F.when(bare.rlike(pattern), bound(_from_base(based, bits), signed))

    fraction = bare.rlike(r"^(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+)$")
    raw = literal.rlike(r"^`[^`\\\"\n\t\r]*`$")
    quoted = F.when(raw, F.concat(F.lit('"'), F.substring(literal, F.lit(2), F.length(literal) - 2), F.lit('"'))).otherwise(literal)
    plain = literal.rlike(r'^"(?:[^"\\]|\\["\\nt])*"$') | raw
    rune = F.regexp_extract(literal, r"^'(.+)'$", 1)
    escapes = F.create_map(*(F.lit(x) for pair in _ESCAPES.items() for x in (pair[0], str(pair[1]))))
    coded = F.regexp_extract(rune, r"^\\(?:x|u|U)([0-9a-fA-F]+)$", 1)
    utf32 = F.conv(F.hex(F.encode(rune, "UTF-32")), 16, 10)
    return (
        F.when(literal.isin("true", "false"), literal)
        .when(bare.rlike(r"^(?:0|[1-9][0-9]*)$"), F.when(bare == "0", bare).otherwise(digits))
        .when(bare.rlike(r"^0[xX]"), whole(r"^0[xX][0-9a-fA-F]+$", 4)).when(bare.rlike(r"^0[bB]"), whole(r"^0[bB][01]+$", 1)).when(bare.rlike(r"^0[oO]?[0-7]+$"), whole(r"^0[oO]?[0-7]+$", 3))
        .when(fraction, _six_digits(digits))
        .when(plain, quoted)
        .when(F.char_length(rune) == 1, utf32)
        .when(coded != "", F.conv(coded, 16, 10))
        .when(rune.rlike(r"^\\.$"), F.coalesce(F.try_element_at(escapes, F.substring(rune, 2, 1)), F.lit("")))
        .otherwise(F.lit(""))
    )
