"""Expressions as columns. Only functions of this list run inside the engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.terms import HOLE, DocumentError, Expr, Var


def _text(c: Column) -> Column:
    return c.cast("string")


#: Fixed list of functions by the names that documents use. Arguments come in the order written.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "=": lambda a, b: a == b,
    "not=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    ".contains": lambda a, b: F.contains(_text(a), _text(b)),
    ".startsWith": lambda a, b: F.startswith(_text(a), _text(b)),
    ".endsWith": lambda a, b: F.endswith(_text(a), _text(b)),
    ".matches": lambda a, b: F.rlike(_text(a), F.concat(F.lit("^(?:"), _text(b), F.lit(")$"))),
    ".equalsIgnoreCase": lambda a, b: F.lower(_text(a)) == F.lower(_text(b)),
    "?not": lambda a, b: a != b,
}


def register(name: str, function: Callable[..., Column]) -> None:
    """Make a function of columns known to expressions by ``name``."""
    FUNCTIONS[name] = function


def tokens(c: Column) -> Column:
    """Lower-cased words of a text, as the full-text predicate compares them."""
    return F.split(F.lower(c), "[^\\p{L}\\p{N}]+")


def predicate(e: Expr, value: Column, bound: dict[str, Column] | None = None) -> Column:
    """The expression with ``value`` in its placeholder and columns for its variables."""
    if e.head == "?fulltext":
        wanted = [a for a in e.args if a is not HOLE]
        if len(wanted) != 1 or not isinstance(wanted[0], str):
            raise DocumentError("wrong-input", "?fulltext takes one text", data=e)
        words = tokens(value)
        out = F.lit(True)
        for word in re.split(r"[\W_]+", wanted[0].lower()):  # letters and digits of any script, as in tokens()
            out = out & F.array_contains(words, word) if word else out
        return out
    if e.head not in FUNCTIONS:
        raise DocumentError("wrong-input", f"unknown function {e.head}", data=e)

    def column(a: object) -> Column:
        if a is HOLE or a == HOLE:
            return value
        if isinstance(a, Var):
            return (bound or {})[a.name]
        return F.lit(a)

    return FUNCTIONS[e.head](*map(column, e.args))
