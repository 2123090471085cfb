"""Schemas: namespaces of typed attributes, references and their reverse names.

``index`` and ``noHistory`` are accepted and kept as they are: every attribute is stored sorted, which is
what an index would be for, and the log keeps the history of all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from typing import Any

from quern.terms import DocumentError

TYPES = ("string", "boolean", "long", "bigint", "float", "double", "bigdec", "instant", "keyword", "uuid", "uri", "bytes", "enum", "ref", "alias")
SPARK_TYPES = {"string": "string", "boolean": "boolean", "long": "bigint", "bigint": "decimal(38,0)", "float": "float", "double": "double",
               "bigdec": "decimal(38,18)", "instant": "timestamp", "keyword": "string", "uuid": "string", "uri": "string", "bytes": "binary",
               "enum": "string", "ref": "bigint"}


@dataclass(frozen=True)
class Link:
    """A reference. ``key`` is the stored (forward) attribute, ``reverse`` tells that this end is not
    stored, ``other`` is the attribute at the other end, ``back`` its name there."""

    ns: str | None
    key: str
    reverse: bool = False
    other: str | None = None
    back: str | None = None
    mutual: bool = False


@dataclass(frozen=True)
class Attribute:
    ident: str
    type: str = "string"
    many: bool = False
    required: bool = False
    representative: bool = False
    unique: str | None = None
    fulltext: bool = False
    component: bool = False
    default: Any = None
    restrict: Any = None
    values: frozenset | None = None
    enum_ns: str | None = None
    keyword_ns: str | None = None
    link: Link | None = None
    alias: dict | None = None
    doc: str | None = None
    index: bool = False

    @property
    def ns(self) -> str:
        return self.ident.split("/")[0]

    @property
    def name(self) -> str:
        return self.ident.split("/", 1)[1] if "/" in self.ident else self.ident


def plural(word: str) -> str:
    """English plural of a namespace."""
    odd = {"person": "people", "child": "children", "man": "men", "woman": "women", "foot": "feet", "tooth": "teeth", "mouse": "mice",
           "goose": "geese"}
    if word in odd:
        return odd[word]
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    if re.search(r"(s|x|z|ch|sh)$", word):
        return word + "es"
    return word + "s"


_PROPERTIES = {"type", "cardinality", "unique", "doc", "index", "fulltext", "isComponent", "noHistory", "required", "restrict", "default",
               "representative", "ref", "enum", "keyword", "alias"}


def _attribute(ident: str, given: dict) -> Attribute:
    unknown = set(given) - _PROPERTIES - {"ident"}
    if unknown:
        raise DocumentError("wrong-schema", f"unknown properties {sorted(unknown)} of {ident}", ident=ident)
    kind = given.get("type", "string")
    if kind not in TYPES:
        raise DocumentError("wrong-schema", f"unknown type {kind} of {ident}", ident=ident)
    if given.get("cardinality", "one") not in ("one", "many") or given.get("unique") not in (None, "value", "identity"):
        raise DocumentError("wrong-schema", f"bad cardinality or unique of {ident}", ident=ident)
    enum = given.get("enum") or {}
    ref = given.get("ref") or {}
    return Attribute(
        ident, kind, given.get("cardinality") == "many", bool(given.get("required")), bool(given.get("representative")), given.get("unique"),
        bool(given.get("fulltext")), bool(given.get("isComponent")), given.get("default"), given.get("restrict"),
        frozenset(enum["values"]) if enum.get("values") else None, enum.get("ns"), (given.get("keyword") or {}).get("ns"),
        Link(ref.get("ns"), ident, mutual=bool(ref.get("mutual"))) if kind == "ref" else None, given.get("alias"), given.get("doc"),
        bool(given.get("index")))


def _flatten(tree: dict, path: tuple[str, ...] = ()) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for key, value in tree.items():
        here = (*path, *key.split("/"))
        if isinstance(value, list):
            out["/".join(here)] = value[0]
        elif isinstance(value, dict):
            out |= _flatten(value, here)
        else:
            raise DocumentError("wrong-schema", f"{'/'.join(here)} is neither a branch nor [attribute]", ident="/".join(here))
    return out


class Schema:
    """``flat``: attributes by ident, reverse ones included. ``tree``: the same, nested by path.
    ``lookup``: every name of an attribute, raw reverse keys (``account/_books``) included."""

    def __init__(self, definition: dict):
        given = _flatten(definition)
        flat = {ident: _attribute(ident, properties) for ident, properties in given.items()}
        reversible: list[tuple[str, str]] = []
        for ident, a in flat.items():
            ref = given[ident].get("ref") or {}
            if a.link and a.link.ns and "/" in ident and not ref.get("mutual") and not ref.get("norev") and not a.name.startswith("_"):
                reversible.append((ident, ref.get("rval") or ""))
        pairs = Counter((flat[i].ns, flat[i].link.ns) for i, _ in reversible)
        self.lookup = {ident: ident for ident in flat}
        for ident, explicit in reversible:
            a = flat[ident]
            stem = "_".join(ident.split("/")[1:])
            if explicit:
                name = explicit
            elif a.ns == a.link.ns:
                name = f"{stem}_of"
            elif pairs[a.ns, a.link.ns] > 1:
                name = f"{stem}_{plural(a.ns)}"
            else:
                name = plural(a.ns)
            back = f"{a.link.ns}/{name}"
            if back in flat:
                raise DocumentError("wrong-schema", f"the reverse name {back} of {ident} is taken; give another one as rval", ident=ident, reverse=back)
            flat[ident] = replace(a, link=replace(a.link, other=back, back=name))
            flat[back] = Attribute(back, "ref", True, link=Link(a.ns, ident, True, ident, a.name))
            self.lookup[back] = back
            head, _, last = ident.rpartition("/")
            self.lookup[f"{head}/_{last}"] = back
        self.flat: dict[str, Attribute] = flat
        self.tree: dict[str, Any] = {}
        for ident, a in flat.items():
            *path, last = ident.split("/")
            node = self.tree
            for step in path:
                node = node.setdefault(step, {})
            node[last] = a

    def branch(self, ns: str | None) -> dict:
        node: Any = self.tree
        for step in (ns or "").split("/") if ns else ():
            node = node.get(step) if isinstance(node, dict) else None
        if not isinstance(node, dict):
            raise DocumentError("no-schema", f"no namespace {ns}", nsv=[ns])
        return node

    def of_namespace(self, ns: str) -> list[Attribute]:
        return [a for a in self.flat.values() if a.ns == ns]

    @property
    def namespaces(self) -> list[str]:
        return list(dict.fromkeys(a.ns for a in self.flat.values() if "/" in a.ident))

    def stored(self) -> list[Attribute]:
        """What a store keeps: neither aliases nor reverse ends."""
        return [a for a in self.flat.values() if a.type != "alias" and not (a.link and a.link.reverse)]

    def representative(self, ns: str) -> Attribute:
        """The attribute whose presence stands for the namespace's."""
        own = [a for a in self.of_namespace(ns) if a.type != "alias"]
        for pick in (lambda a: a.representative, lambda a: a.required):
            for a in own:
                if pick(a):
                    return a
        raise DocumentError("needs-require-key", f"no required or representative attribute in {ns}", nsv=[ns])

    def __repr__(self) -> str:
        def shown(a: Attribute) -> str:
            kind = f"&{a.link.ns or ''}" if a.link else a.type
            return f"{kind}<*>" if a.many else kind

        return f"Schema({ {ns: {a.name: shown(a) for a in self.of_namespace(ns)} for ns in self.namespaces} })"
