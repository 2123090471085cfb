"""Terms that documents are made of, besides plain values: variables, expressions, temporary ids."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any


class DocumentError(Exception):
    """A document that cannot be processed. ``tags`` name the reason, ``data`` tells where."""

    def __init__(self, tag: str, message: str = "", **data: Any):
        super().__init__(f"{tag}: {message or data}")
        self.tags = frozenset({tag})
        self.data = data


@dataclass(frozen=True)
class Var:
    """A logic variable: equal names stand for equal values. The name "_" stands for any value."""

    name: str


ANY = Var("_")


@dataclass(frozen=True)
class TempId:
    """An id for an entity that has none yet. Equal seeds mean the same entity within one commit."""

    seed: Any


@dataclass(frozen=True)
class Expr:
    """A predicate on a value: ``args`` hold HOLE where the value stands."""

    head: str
    args: tuple


HOLE = Var("?")


def expression(value: tuple) -> Expr:
    """``(">", 10)``, ``(">", "?", 10)``, ``("<", 10, "?")``. Without a placeholder the value is the
    first argument."""
    head, *args = value
    args = [HOLE if isinstance(a, str) and a == "?" else a for a in args]
    if HOLE not in args:
        args = [HOLE, *args]
    return Expr(head, tuple(args))


_ATOM = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s()"]+')


def _atom(text: str) -> Any:
    if text.startswith('"'):
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text == "_":
        return ANY
    if text == "?":
        return "?"
    if text.startswith("?") and text not in ("?not", "?fulltext"):
        return Var(text[1:])
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.removeprefix(":")


def is_text_term(value: Any) -> bool:
    """Whether this is the JSON-safe spelling ``[["..."]]`` of a term."""
    return isinstance(value, list) and len(value) == 1 and isinstance(value[0], list) and len(value[0]) == 1 and isinstance(value[0][0], str)


def text_term(value: list) -> Any:
    """``[["(< ? 1)"]]`` is an expression, ``[["_"]]`` any value, ``[["?x"]]`` a variable, ``[["NAME"]]``
    or ``[[":NAME"]]`` a temporary id."""
    text = value[0][0].strip()
    if text.startswith("(") and text.endswith(")"):
        return expression(tuple(_atom(a) for a in _ATOM.findall(text[1:-1])))
    if text == "_":
        return ANY
    if text.startswith("?"):
        return Var(text[1:])
    if not text:
        raise DocumentError("wrong-input", "an empty text term", data=value)
    return TempId(text.removeprefix(":"))
