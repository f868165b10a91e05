"""Brackets of any depth in a text: one pattern cuts those of usual depth, a fold over the tokens finds the level of the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks below the top level, and the private code points they move to.
_MARKS = "()[]{},;"
_NESTED = "".join(chr(0xE030 + i) for i in range(len(_MARKS)))
_TOKEN = r"[(\[{]|[)\]}]|[^()\[\]{}]++"
#: Brackets nested up to so deep are cut by one pattern; the fold is for what lies deeper and for brackets without a partner.
AT_ONCE = 64


def balanced(opening: str, closing: str, depth: int = AT_ONCE) -> str:
    """Pattern of a whole bracket with what is in it; ``opening`` and ``closing`` are characters of a class."""
    plain = rf"[^{opening}{closing}]++"
    pattern = rf"[{opening}](?:{plain})?+[{closing}]"
    for _ in range(depth - 1):
        pattern = rf"[{opening}](?:{plain}|{pattern})*+[{closing}]"
    return pattern


_PIECE = rf"\G(?:[^()\[\]{{}}]++|{balanced(r'(\[{', r')\]}')})"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; a plain expression would be computed again wherever a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each item: ``step(state, item)`` from ``start`` on.

    The items are folded in pieces of about the square root of their number, so no long array is copied per item.
    """

    def fold(rows: Column, size: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / size).cast("int") - 1), lambda n: F.slice(rows, n * size + 1, size))
        last = lambda states: F.element_at(states, -1)
        inner = lambda done, piece: F.aggregate(piece, F.array(last(last(done))), lambda states, x: F.array_append(states, step(last(states), x)))
        folded = F.aggregate(pieces, F.array(F.array(start)), lambda done, piece: F.array_append(done, inner(done, piece)))
        # Every piece begins with the state it was given.
        return F.flatten(F.transform(F.slice(folded, F.lit(2), F.size(folded)), lambda p: F.slice(p, F.lit(2), F.size(p))))

    def whole(rows: Column) -> Column:
        return bound(F.ceil(F.sqrt(F.size(rows))).cast("int"), lambda size: fold(rows, size))

    return bound(items, lambda rows: F.when(F.size(rows) > 0, whole(rows)).otherwise(F.slice(F.array(start), F.lit(1), F.lit(0))))


def flat(text: Column) -> Column:
    """The text with brackets, commas and semicolons inside other brackets hidden; ``unflat`` restores them.

    What is left can be cut by patterns that know one level only.
    """
    opens, closes = (lambda t: t.isin("(", "[", "{")), (lambda t: t.isin(")", "]", "}"))

    def hide(tokens: Column) -> Column:
        levels = running(tokens, F.lit(0), lambda level, t: level + F.when(opens(t), 1).when(closes(t), -1).otherwise(0))

        def shown(t: Column, level: Column) -> Column:
            return F.when((level > 1) | ((level == 1) & ~opens(t)), F.translate(t, _MARKS, _NESTED)).otherwise(t)

        return F.array_join(F.zip_with(tokens, levels, shown), "")

    def inner(piece: Column) -> Column:
        hidden = F.translate(F.substring(piece, F.lit(2), F.length(piece) - 2), _MARKS, _NESTED)
        return F.when(piece.rlike(r"^[(\[{]"), F.concat(F.substring(piece, F.lit(1), F.lit(1)), hidden, F.substring(piece, F.lit(-1), F.lit(1)))).otherwise(piece)

    def cut(t: Column) -> Column:
        # The pieces are the whole text if every bracket has its partner and none nests too deep.
        fold = bound(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), hide)
        return bound(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), lambda pieces: F.when(F.array_join(pieces, "") == t, F.array_join(F.transform(pieces, inner), "")).otherwise(fold))

    def whole(t: Column) -> Column:
        # Without a mark inside a bracket there is nothing to hide.
        return F.when(t.rlike(r"[(\[{][^)\]}]*[(\[{,;]"), cut(t)).otherwise(t)

    return bound(text, whole)


def unflat(text: Column) -> Column:
    return F.translate(text, _NESTED, _MARKS)
