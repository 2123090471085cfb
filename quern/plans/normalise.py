"""From a nested document to entities: paths, aliases, pipeline stages, checks, coercions.

The result is an ``Entity``: attributes by ident, each with a list of values. A value is plain, a
variable, an expression, an id, or an entity.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from quern.functions.coerce import coerce, has_type
from quern.plans.schema import Attribute, Schema
from quern.terms import ANY, HOLE, DocumentError, Expr, TempId, Var, expression, is_text_term, text_term


@dataclass
class Entity:
    id: Any = None
    values: dict[str, list] = field(default_factory=dict)

    def namespaces(self) -> list[str]:
        return list(dict.fromkeys(i.split("/")[0] for i in self.values))


@dataclass
class Context:
    """One call: what the document is for and what governs it."""

    schema: Schema
    write: bool = False
    options: dict[str, Any] = field(default_factory=dict)
    pipeline: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)
    fresh: Iterable[int] = field(default_factory=itertools.count)

    def call(self, function: Callable, *args: Any) -> Any:
        """A pipeline function with as many of the arguments, the context last, as it takes."""
        args = (*args, self)
        try:
            parameters = inspect.signature(function).parameters.values()
        except ValueError:
            return function(args[0])
        if any(p.kind == p.VAR_POSITIONAL for p in parameters):
            return function(*args)
        return function(*args[: sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in parameters)])

    def __getitem__(self, key: str) -> Any:
        return self.extra[key]


def many(value: Any) -> list:
    """A set of values: lists and sets stand for sets, text terms and tuples are single."""
    if isinstance(value, (list, set, frozenset)) and not is_text_term(value):
        return list(value)
    return [value]


def merge(a: Any, b: Any) -> Any:
    """Two documents as one; what both have and is no branch is put together as a set."""
    if a is None:
        return b
    if b is None:
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a.get(k), b.get(k)) for k in dict.fromkeys([*a, *b])}
    if isinstance(a, dict) and isinstance(b, list) and not is_text_term(b):
        return [a, *b] if not any(a == x for x in b) else b
    out = many(a)
    return out + [x for x in many(b) if x not in out] if out != many(b) else a


def nested(doc: dict) -> dict:
    """Path keys as nesting, at every level."""
    out: dict = {}
    for key, value in doc.items():
        value = nested(value) if isinstance(value, dict) else value
        if isinstance(value, (list, set, frozenset)) and not is_text_term(value):
            value = [nested(v) if isinstance(v, dict) else v for v in value]
        *path, last = key.split("/")
        inner: Any = {last: value}
        for step in reversed(path):
            inner = {step: inner}
        out = merge(out, inner)
    return out


def nested_rules(rules: Any) -> Any:
    """Path keys of rules and models as nesting; other values as they are."""
    if not isinstance(rules, dict):
        return rules
    out: dict = {}
    for key, value in rules.items():
        inner = nested_rules(value)
        for step in reversed(key.split("/")):
            inner = {step: inner}
        out = _merge_rules(out, inner)
    return out


def _merge_rules(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merge_rules(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in dict.fromkeys([*a, *b])}
    return b


def _is_link(node: Any) -> bool:
    return isinstance(node, Attribute) and node.type == "ref"


# Stages. Each takes the rules, a level's data and schema, and leaves references to their own level.


def require(rules: dict, data: dict, node: dict, path: list[str], ctx: Context) -> None:
    for key, rule in rules.items():
        here = data.get(key)
        if isinstance(rule, dict):
            if _is_link(node.get(key)):
                continue
            if here is None:
                raise DocumentError("no-required", f"{path + [key]} is not present", nsv=path + [key], data=data)
            require(rule, here, node.get(key, {}), [*path, key], ctx)
        elif here is None and (rule == "checked" or callable(rule) and ctx.call(rule, here) in (True, "checked")):
            raise DocumentError("no-required", f"{path + [key]} is not present", nsv=path + [key], data=data)


def mask(rules: dict, data: dict, node: dict, ctx: Context) -> dict:
    out = dict(data)
    for key, rule in rules.items():
        if key not in out or rule == "unchecked" or isinstance(rule, dict) and _is_link(node.get(key)):
            continue
        if isinstance(rule, dict):
            out[key] = mask(rule, out[key], node.get(key, {}), ctx)
        elif not callable(rule) or ctx.call(rule, out[key]) not in ("unchecked", False, None):
            del out[key]
    return out


def transform(rules: dict, data: dict, node: dict, ctx: Context) -> dict:
    out = dict(data)
    for key, rule in rules.items():
        if key not in out or isinstance(rule, dict) and _is_link(node.get(key)):
            continue
        if isinstance(rule, dict) and isinstance(out[key], dict):
            out[key] = transform(rule, out[key], node.get(key, {}), ctx)
        elif callable(rule):
            values = [ctx.call(rule, v) for v in many(out[key])]
            out[key] = values if isinstance(out[key], (list, set, frozenset)) else values[0]
        else:
            out[key] = rule
    return out


def fill(rules: dict, data: dict | None, node: dict, ctx: Context, above: tuple, add: bool) -> dict:
    """Values for missing keys; with ``add`` also further values for keys that are there."""
    out = dict(data or {})
    for key, rule in rules.items():
        here = out.get(key)
        inner = node.get(key)
        if here is None:
            if callable(rule):
                out[key] = ctx.call(rule, above)
            else:
                branch = inner if isinstance(inner, dict) else ctx.schema.branch(inner.link.ns) if _is_link(inner) and inner.link.ns else {}
                out[key] = fill(rule, None, branch, ctx, above, add) if isinstance(rule, dict) else rule
        elif isinstance(rule, dict):
            if not _is_link(inner) and isinstance(here, dict):
                out[key] = fill(rule, here, inner or {}, ctx, above, add)
        elif add:
            more = ctx.call(rule, above) if callable(rule) else rule
            out[key] = many(here) + [m for m in many(more) if m not in many(here)]
    return out


def _check_expression(rule: Any, value: Any, ctx: Context) -> bool:
    """Whether an expression is allowed: "_" any, a name for its head, a tuple for head and
    arguments, a function of it, a list for all of several, a set for one of several."""
    if rule in ("_", ANY, "checked"):
        return True
    if callable(rule):
        return bool(ctx.call(rule, value))
    if isinstance(rule, list):
        return all(_check_expression(r, value, ctx) for r in rule)
    if isinstance(rule, (set, frozenset)):
        return any(_check_expression(r, value, ctx) for r in rule)
    if isinstance(rule, tuple):
        head, *args = rule
        given = [a for a in value.args]
        given = given if len(given) == len(args) else [a for a in given if a is not HOLE]
        return head in ("_", value.head) and len(given) == len(args) and all(
            a in ("_", g) or callable(a) and a(g) or a == "?" and g is HOLE for a, g in zip(args, given))
    return rule == value.head


class Normaliser:
    def __init__(self, ctx: Context):
        self.ctx, self.schema = ctx, ctx.schema

    def __call__(self, doc: dict) -> Entity:
        stages = self.ctx.pipeline
        if self.ctx.options.get("skip_normalise"):  # the document is normal already: nested, sets as lists
            return self.pack(doc, self.schema.tree, [], top=True)
        doc = nested(doc)
        if stages.get("pre_process"):
            doc = self.ctx.call(stages["pre_process"], doc)
        # The stages' rules may use path keys, too.
        rules = {k: nested_rules(v) for k, v in stages.items()}
        data = self.level(doc, self.schema.tree, [], [], rules, ())
        if stages.get("post_process"):
            data = self.ctx.call(stages["post_process"], data)
        return self.pack(data, self.schema.tree, [], top=True)

    # Walking

    def level(self, data: dict, node: dict, keys: list[str], nsv: list[str], rules: dict, above: tuple) -> dict:
        """One entity's data with its stages applied; references below are levels of their own."""
        data = self.aliases(data, node)
        require(rules.get("pre_require") or {}, data, node, nsv, self.ctx)
        data = mask(rules.get("pre_mask") or {}, data, node, self.ctx)
        data = transform(rules.get("pre_transform") or {}, data, node, self.ctx)
        data = fill(rules.get("fill_empty") or {}, data, node, self.ctx, above, add=False)
        data = fill(rules.get("fill_assoc") or {}, data, node, self.ctx, above, add=True)
        out = self.keys(self.aliases(data, node), node, keys, nsv, rules, (data, *above))
        require(rules.get("post_require") or {}, out, node, nsv, self.ctx)
        out = mask(rules.get("post_mask") or {}, out, node, self.ctx)
        return transform(rules.get("post_transform") or {}, out, node, self.ctx)

    def keys(self, data: dict, node: dict, keys: list[str], nsv: list[str], rules: dict, above: tuple) -> dict:
        out: dict = {}
        for key, value in data.items():
            if key == "db" and isinstance(value, dict):
                out["db"] = value
                continue
            if key == "+":
                out["+"] = self.keys(nested(value), self.schema.tree, [*keys, "+"], [], {k: (v.get("+", {}) if isinstance(v, dict) else v) if k != "allow" else v for k, v in rules.items()}, above)
                continue
            here = self.named(node, nsv, key)
            allow = rules.get("allow")
            if allow is not None and here is not None and key not in allow:
                raise DocumentError("not-allowed", f"{nsv + [key]} is not allowed", key_path=keys + [key], nsv=nsv + [key], data=value)
            inner = {k: v.get(key) if isinstance(v, dict) else None for k, v in rules.items()}
            if isinstance(here, dict):
                if value == ANY or value == "_" or is_text_term(value) and text_term(value) == ANY:
                    if self.ctx.write:
                        raise DocumentError("query-only", f"_ on {nsv + [key]}", nsv=nsv + [key], key_path=keys + [key])
                    value = {self.schema.representative("/".join([*nsv, key])).name: ANY}
                if not isinstance(value, dict):
                    raise DocumentError("wrong-input", f"{nsv + [key]} is a namespace", nsv=nsv + [key], key_path=keys + [key], data=value)
                out[key] = self.keys(self.aliases(nested(value), here), here, [*keys, key], [*nsv, key], inner, above)
            elif isinstance(here, Attribute):
                name = here.name.rsplit("/", 1)[-1] if "/" in here.ident else key
                out[name] = out.get(name, []) + self.attribute(here, value, [*keys, key], [*nsv, key], inner, above, allow is not None)
            elif (rules.get("ignore") or {}).get(key) is None:
                raise DocumentError("no-schema", f"{nsv + [key]} is not in the schema", nsv=nsv + [key], key_path=keys + [key], data=value)
        return out

    def named(self, node: dict, nsv: list[str], key: str) -> Any:
        found = node.get(key)
        if found is None and key.startswith("_"):
            ident = self.schema.lookup.get("/".join([*nsv, key]))
            found = self.schema.flat.get(ident) if ident else None
        return found

    def aliases(self, data: dict, node: dict) -> dict:
        """Virtual attributes replaced by their templates, the data given for them put in place."""
        out = dict(data)
        while found := [k for k in out if isinstance(node.get(k), Attribute) and node[k].alias]:
            for key in found:
                given = out.pop(key)
                template = nested(node[key].alias["template"])
                if self.ctx.write and _variables(template):
                    raise DocumentError("no-alias", f"alias {key} has variables", data=data)
                if not self.ctx.options.get("no_alias_gen"):
                    template = _renamed(template, f"_{next(self.ctx.fresh)}")
                for one in many(given) if isinstance(given, list) else [given]:
                    inner: Any = nested(one) if isinstance(one, dict) else {}
                    for step in reversed(node[key].alias["ns"].split("/")):
                        inner = {step: inner}
                    out = merge(out, merge(template, inner))
        return out

    def attribute(self, a: Attribute, value: Any, keys: list[str], nsv: list[str], rules: dict, above: tuple, limited: bool) -> list:
        where = {"key_path": keys, "nsv": a.ident.split("/"), "data": value}
        values = many(value)
        if a.many is False and self.ctx.write and len(values) > 1:
            raise DocumentError("wrong-input", f"{a.ident} takes one value", **where)
        out = []
        for v in values:
            if is_text_term(v):
                v = text_term(v)
            elif isinstance(v, tuple):
                v = expression(v)
            elif isinstance(v, str) and v == "_" and not self.ctx.write and a.type != "string":
                v = ANY
            allow = rules.get("allow")
            if limited and (allow not in ("id", "yield") and not isinstance(allow, dict) if a.type == "ref" else allow != "checked"):
                raise DocumentError("not-allowed", f"{a.ident} is not allowed", **where)
            if isinstance(v, Expr):
                if self.ctx.options.get("ban_expressions"):
                    raise DocumentError("not-allowed", "expressions are not allowed", **where)
                if self.ctx.pipeline.get("expression") is not None:
                    rule = rules.get("expression")
                    if rule is None or not _check_expression(rule, v, self.ctx):
                        raise DocumentError("failed-check", f"expression {v} of {a.ident}", expression=True, **where)
            elif isinstance(v, Var):
                if self.ctx.write and a.type != "ref":
                    raise DocumentError("ref-only", f"variable in {a.ident}", **where)
            elif a.type == "ref":
                if isinstance(v, dict):
                    branch = self.schema.branch(a.link.ns)
                    sub = {k: r if isinstance(r, dict) else {} if k == "allow" and limited else None for k, r in rules.items()}
                    v = self.level(v, branch, keys, (a.link.ns or "").split("/") if a.link.ns else [], sub, above)
                elif not (isinstance(v, TempId) or isinstance(v, int) and not isinstance(v, bool)):
                    raise DocumentError("wrong-input", f"{a.ident} is a reference", **where)
            else:
                v = self.single(a, v, rules, where)
            out.append(v)
        return out

    def single(self, a: Attribute, v: Any, rules: dict, where: dict) -> Any:
        check = rules.get("validate")
        if callable(check):
            verdict = self.ctx.call(check, v)
            if verdict is not True and verdict is not None:
                raise DocumentError("not-validated", f"{a.ident}: {verdict}", **where)
        if callable(rules.get("convert")):
            v = self.ctx.call(rules["convert"], v)
        if self.ctx.options.get("use_typecheck") and not has_type(v, a.type):
            if not self.ctx.options.get("use_coerce"):
                raise DocumentError("wrong-type", f"{v!r} in {a.ident}", **where)
            v = coerce(v, a.type)
        if a.type == "keyword" and isinstance(v, str):
            v = v.removeprefix(":")
            if a.keyword_ns and v.startswith(a.keyword_ns + "/"):
                v = v[len(a.keyword_ns) + 1 :]
        if a.type == "enum" and isinstance(v, str):
            v = v.removeprefix(":")
            if a.enum_ns and v.startswith(a.enum_ns + "/"):
                v = v[len(a.enum_ns) + 1 :]
            if a.values is not None and v not in a.values:
                raise DocumentError("wrong-input", f"{v} is no value of {a.ident}", **where)
        return v

    # Packing: flat idents, ids, coercion, restrictions, defaults, required attributes

    def pack(self, data: dict, node: dict, nsv: list[str], top: bool = False) -> Entity:
        entity = Entity()
        self.gather(data, node, nsv, entity, top)
        if self.ctx.write and not self.ctx.options.get("skip_pack"):
            self.review(entity)
        return entity

    def gather(self, data: dict, node: dict, nsv: list[str], entity: Entity, top: bool) -> None:
        options = self.ctx.options
        for key, value in data.items():
            if key == "db":
                given = value.get("id")
                given = text_term(given) if is_text_term(given) else given
                if isinstance(given, int):
                    tag = "id-banned" if options.get("ban_ids") else "top-id-banned" if top and options.get("ban_top_id") else "body-id-banned" if not top and options.get("ban_body_ids") else None
                    if tag:
                        raise DocumentError(tag, "ids are not allowed", id=given)
                entity.id = given
            elif key == "+":
                self.gather(value, self.schema.tree, [], entity, top)
            elif isinstance(node.get(key), dict):
                if isinstance(value, dict):
                    self.gather(value, node[key], [*nsv, key], entity, top)
            elif isinstance(node.get(key), Attribute):
                a = node[key]
                entity.values.setdefault(a.ident, []).extend(self.packed(a, v) for v in many(value))

    def packed(self, a: Attribute, v: Any) -> Any:
        if isinstance(v, (Var, TempId)):
            return v
        if isinstance(v, Expr):
            if self.ctx.options.get("ban_expressions"):
                raise DocumentError("expression-banned", f"expression in {a.ident}", data=v)
            return v
        if a.type == "ref":
            if isinstance(v, dict):
                return self.pack(v, self.schema.branch(a.link.ns), (a.link.ns or "").split("/") if a.link.ns else [])
            tag = "id-banned" if self.ctx.options.get("ban_ids") else "body-id-banned" if self.ctx.options.get("ban_body_ids") else None
            if tag:
                raise DocumentError(tag, f"id in {a.ident}", id=v)
            return v
        if not self.ctx.options.get("skip_typesafety"):
            v = coerce(v, a.type)
        if self.ctx.write and self.ctx.options.get("schema_restrict") and a.restrict is not None and not a.many:
            self.restricted(a, v)
        return v

    def restricted(self, a: Attribute, v: Any) -> None:
        message, test = a.restrict if isinstance(a.restrict, (list, tuple)) else ("", a.restrict)
        if not self.ctx.call(test, v):
            raise DocumentError("failed-restriction", f"{a.ident}: {message}", failed_restriction=True, nsv=a.ident.split("/"), data=v)

    def review(self, entity: Entity) -> None:
        """Defaults, then required attributes, of every namespace that the entity touches."""
        spaces = entity.namespaces()
        own = [a for a in self.schema.stored() if a.ns in spaces]
        if self.ctx.options.get("schema_defaults"):
            for a in own:
                if a.ident not in entity.values and a.default is not None:
                    value = a.default() if callable(a.default) else a.default
                    entity.values[a.ident] = [self.packed(a, v) for v in many(value)]
        if self.ctx.options.get("schema_restrict"):
            for a in own:
                if a.many and a.restrict is not None and a.ident in entity.values:
                    self.restricted(a, entity.values[a.ident])
        if self.ctx.options.get("schema_required"):
            missing = sorted(a.ident for a in own if a.required and not entity.values.get(a.ident))
            if missing:
                raise DocumentError("required", f"The following keys are required: {missing}", keys=missing)


def _variables(x: Any) -> bool:
    if isinstance(x, dict):
        return any(map(_variables, x.values()))
    if isinstance(x, (list, tuple, set, frozenset)):
        return any(map(_variables, x))
    return isinstance(x, Var) and x not in (ANY, HOLE)


def _renamed(x: Any, mark: str) -> Any:
    """Variables of a template under names of their own."""
    if isinstance(x, dict):
        return {k: _renamed(v, mark) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return type(x)(_renamed(v, mark) for v in x)
    if isinstance(x, Var) and x not in (ANY, HOLE):
        return Var(x.name + mark)
    return x
