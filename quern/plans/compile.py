"""From entities to DataFrames.

A query's root becomes a table of ids. A branch without logic variables only filters, so it is a
left semi join; a branch that binds variables is an inner join that carries their columns, and the
ids are made distinct at the end. Predicates on single-valued attributes of one entity are filters
on one scan of its namespace.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.predicates import predicate
from quern.plans.normalise import Entity
from quern.plans.schema import Attribute, Schema
from quern.sources.base import Source
from quern.terms import ANY, HOLE, DocumentError, Expr, TempId, Var


@dataclass
class Frame:
    """Rows of ``eid`` with the columns bound to variables, and conditions that still wait for some."""

    df: DataFrame
    bound: dict[str, str] = field(default_factory=dict)
    waiting: list[tuple[set[str], str, Expr]] = field(default_factory=list)  # variables, column of the value, expression


def uses_variables(value: object) -> bool:
    if isinstance(value, Entity):
        named = isinstance(value.id, Var) and value.id != ANY
        return named or any(uses_variables(v) for values in value.values.values() for v in values)
    if isinstance(value, Expr):
        return any(isinstance(a, Var) and a != HOLE for a in value.args)
    return isinstance(value, Var) and value != ANY


class Compiler:
    def __init__(self, source: Source):
        self.source, self.schema = source, source.schema
        self.names = itertools.count()

    def ids(self, root: Entity, carry: list[Attribute] | None = None) -> DataFrame:
        """The distinct ids (``eid``) of the entities that fit the query. With ``carry``, attributes of
        the root's only namespace, their columns come along, so that no second scan is needed."""
        frame = self.frame(root, carry or [])
        if frame.waiting:
            raise DocumentError("wrong-input", f"unbound variables {sorted(set().union(*(w[0] for w in frame.waiting)))}")
        columns = ["eid", *(f"`{a.ident}`" for a in carry or [])]
        return frame.df.select(*columns).dropDuplicates(["eid"]) if frame.bound else frame.df.select(*columns)

    def frame(self, entity: Entity, carry: list[Attribute] | None = None) -> Frame:
        """Rows for an entity. Nothing but ids, bound variables and what is carried is kept."""
        attributes = {ident: self.schema.flat[ident] for ident in entity.values}
        if not attributes:
            if entity.id is None:
                raise DocumentError("empty-query", "an entity without constraints")
            raise DocumentError("wrong-input", "an id needs a namespace: name one of its attributes", id=entity.id)
        frame: Frame | None = None
        for ns in dict.fromkeys(a.ns for a in attributes.values()):
            own = {i: entity.values[i] for i, a in attributes.items() if a.ns == ns}
            part = self.namespace(ns, own, carry or [])
            frame = part if frame is None else self.merge(frame, part, "eid")
        if isinstance(entity.id, int):
            frame.df = frame.df.where(F.col("eid") == entity.id)
        elif isinstance(entity.id, Var) and entity.id != ANY:
            frame = self.bind(frame, entity.id.name, F.col("eid"))
        elif isinstance(entity.id, TempId):
            raise DocumentError("wrong-input", "a temporary id in a query", id=entity.id)
        return frame

    def namespace(self, ns: str, own: dict[str, list], carry: list[Attribute]) -> Frame:
        single = list({a.ident: a for a in [*(self.schema.flat[i] for i in own if not self.schema.flat[i].many), *carry]}.values())
        # A constraint on a single-valued attribute can only hold for entities that have it.
        frame = Frame(self.source.wide(ns, single, implied=any(not self.schema.flat[i].many for i in own)))
        # Scalars first, so that their filters reach the scan; then references.
        for a in sorted((self.schema.flat[i] for i in own), key=lambda a: a.type == "ref"):
            for value in own[a.ident]:
                frame = self.link(frame, a, value) if a.type == "ref" else self.scalar(frame, a, value)
        columns = [*frame.bound.values(), *dict.fromkeys(c for _, c, _ in frame.waiting), *(f"`{a.ident}`" for a in carry)]
        return Frame(frame.df.select("eid", *columns), frame.bound, frame.waiting)

    def scalar(self, frame: Frame, a: Attribute, value: object) -> Frame:
        if not a.many:
            return self.test(frame, F.col(f"`{a.ident}`"), a, value)
        pairs = self.source.pairs(a).select(F.col("e").alias("eid"), "v")
        if not uses_variables(value):
            found = self.test(Frame(pairs), F.col("v"), a, value).df
            return Frame(frame.df.join(found.select("eid"), "eid", "left_semi"), frame.bound, frame.waiting)
        return self.merge(frame, self.test(Frame(pairs), F.col("v"), a, value, drop=True), "eid")

    def test(self, frame: Frame, column: Column, a: Attribute, value: object, drop: bool = False) -> Frame:
        if value == ANY:
            out = Frame(frame.df.where(column.isNotNull()), frame.bound, frame.waiting)
        elif isinstance(value, Var):
            out = self.bind(Frame(frame.df.where(column.isNotNull()), frame.bound, frame.waiting), value.name, column)
        elif isinstance(value, Expr):
            variables = {x.name for x in value.args if isinstance(x, Var) and x != HOLE}
            if variables:
                name = f"_x{next(self.names)}"
                df = frame.df.where(column.isNotNull()).withColumn(name, column)
                out = self.settle(Frame(df, frame.bound, [*frame.waiting, (variables, name, value)]))
            else:
                if value.head == "?fulltext" and not a.fulltext:
                    raise DocumentError("wrong-input", f"{a.ident} has no full text", nsv=a.ident.split("/"))
                out = Frame(frame.df.where(predicate(value, column)), frame.bound, frame.waiting)
        else:
            out = Frame(frame.df.where(column == F.lit(value)), frame.bound, frame.waiting)
        return Frame(out.df.drop("v"), out.bound, out.waiting) if drop else out

    def link(self, frame: Frame, a: Attribute, value: object) -> Frame:
        """A reference to an id, to any entity, to a variable, or to an entity with constraints."""
        reverse = a.link.reverse
        stored = self.schema.flat[a.link.key]
        if not reverse and not a.many and not a.link.mutual:
            column = F.col(f"`{a.ident}`")
            if not isinstance(value, Entity):
                return self.test(frame, column, a, value)
            if not value.values and value.id is not None:
                return self.test(frame, column, a, value.id)
            child = self.child(value, a)
            if child is None:
                return Frame(frame.df.where(column.isNotNull()), frame.bound, frame.waiting)
            if not uses_variables(value):
                inner = child.df.select(F.col("eid").alias("_child"))
                return Frame(frame.df.join(inner, column == F.col("_child"), "left_semi"), frame.bound, frame.waiting)
            kept = Frame(frame.df.withColumn("_via", column), frame.bound, frame.waiting)
            return self.merge(kept, Frame(child.df.withColumnRenamed("eid", "_via"), child.bound, child.waiting), "_via", drop=True)
        pairs = self.source.pairs(stored)
        if a.link.mutual:
            pairs = pairs.union(pairs.select("v", "e")).toDF("e", "v").distinct()
        near, far = ("v", "e") if reverse else ("e", "v")
        edges = pairs.select(F.col(near).alias("eid"), F.col(far).alias("_via"))
        if isinstance(value, Entity) and not value.values and value.id is not None:
            value = value.id
        if isinstance(value, Entity):
            child = self.child(value, a)
            if child is None:
                found = Frame(edges)
            elif not uses_variables(value):
                found = Frame(edges.join(child.df.select(F.col("eid").alias("_via")), "_via", "left_semi"))
            else:
                found = self.merge(Frame(edges), Frame(child.df.withColumnRenamed("eid", "_via"), child.bound, child.waiting), "_via")
        else:
            found = self.test(Frame(edges), F.col("_via"), a, value)
        found = Frame(found.df.drop("_via"), found.bound, found.waiting)
        if not found.bound and not found.waiting:
            return Frame(frame.df.join(found.df.select("eid"), "eid", "left_semi"), frame.bound, frame.waiting)
        return self.merge(frame, found, "eid")

    def child(self, value: Entity, a: Attribute) -> Frame | None:
        return self.frame(value) if value.values else None

    def bind(self, frame: Frame, name: str, column: Column) -> Frame:
        """Give the variable this column, or demand that it equals the one it has."""
        if name in frame.bound:
            return Frame(frame.df.where(F.col(frame.bound[name]) == column), frame.bound, frame.waiting)
        own = f"_v{next(self.names)}"
        return self.settle(Frame(frame.df.withColumn(own, column), frame.bound | {name: own}, frame.waiting))

    def merge(self, left: Frame, right: Frame, key: str, drop: bool = False) -> Frame:
        """Join on the key; variables that both sides bind are part of the join's condition."""
        shared = left.bound.keys() & right.bound.keys()
        other = right.df.withColumnRenamed(key, "_key")
        conditions = [left.df[key] == other["_key"], *(F.col(left.bound[v]) == F.col(right.bound[v]) for v in shared)]
        df = left.df.join(other, reduce(and_, conditions), "inner").drop("_key", *(right.bound[v] for v in shared))
        out = self.settle(Frame(df, right.bound | left.bound, left.waiting + right.waiting))
        return Frame(out.df.drop(key), out.bound, out.waiting) if drop else out

    def settle(self, frame: Frame) -> Frame:
        """Apply the waiting conditions whose variables are all bound."""
        df, left = frame.df, []
        for variables, value, expr in frame.waiting:
            if variables <= frame.bound.keys():
                df = df.where(predicate(expr, F.col(value), {v: F.col(frame.bound[v]) for v in variables})).drop(value)
            else:
                left.append((variables, value, expr))
        return Frame(df, frame.bound, left)


def datalog(entity: Entity, schema: Schema, root: str = "self", generate: Callable[[], str] | bool | None = None) -> list:
    """The query as find-where patterns, for inspection: ``["find", "?self", "where", pattern ...]``.
    ``generate`` gives the names of variables; False: there are none, they are all "_"."""
    patterns: list = []
    names = itertools.count()

    def fresh(stem: str) -> str:
        return "_" if generate is False else f"?{generate()}" if callable(generate) else f"?{stem}{next(names)}"

    def walk(e: Entity, name: str) -> None:
        for ident, values in e.values.items():
            a = schema.flat[ident]
            for v in values:
                if isinstance(v, Entity):
                    inner = f"?{v.id.name}" if isinstance(v.id, Var) else v.id if isinstance(v.id, int) else fresh("e")
                    patterns.append([inner, a.link.key, name] if a.link.reverse else [name, ident, inner])
                    walk(v, inner)
                elif isinstance(v, Expr):
                    own = fresh("e_")
                    patterns.append([name, ident, own])
                    patterns.append([[v.head, *(own if x == HOLE else f"?{x.name}" if isinstance(x, Var) else x for x in v.args)]])
                elif a.link and a.link.reverse:
                    patterns.append([f"?{v.name}" if isinstance(v, Var) else v, a.link.key, name])
                else:
                    patterns.append([name, ident, f"?{v.name}" if isinstance(v, Var) else v])

    walk(entity, f"?{root}")
    return ["find", f"?{root}", "where", *patterns]


def run_datalog(source: Source, query: list, inputs: list | None = None) -> DataFrame:
    """Raw patterns: ``["find", "?x", "in", "$", "?name", "where", [e, attr, v], [["<", "?a", 3]], ...]``.

    The first variable of the find clause is the entity (``eid``). A pattern is a table of pairs;
    patterns are joined on the variables that they share. ``[["fulltext", "$", attr, text], [["?e",
    "?v"]]]`` binds the entities and values of a full-text search.
    """
    parts: dict[str, list] = {}
    current: list = []
    for item in query:
        if isinstance(item, str) and item.removeprefix(":") in ("find", "in", "where"):
            current = parts.setdefault(item.removeprefix(":"), [])
        else:
            current.append(item)
    names = [x for x in parts.get("in", []) if x != "$"]
    given = dict(zip(names, inputs or []))
    frame: DataFrame | None = None
    seen: set[str] = set()
    later: list[Callable[[DataFrame], DataFrame]] = []

    def add(df: DataFrame) -> None:
        nonlocal frame
        columns = set(df.columns)
        if frame is None:
            frame = df
        elif columns & seen:
            frame = frame.join(df, sorted(columns & seen), "inner")
        else:
            raise DocumentError("wrong-input", "patterns without a common variable", columns=sorted(columns))
        seen.update(columns)

    def pattern(e: object, ident: str, v: object) -> DataFrame:
        a = source.schema.flat[source.schema.lookup[ident.removeprefix(":")]]
        if a.many or a.type == "ref":
            pairs = source.pairs(source.schema.flat[a.link.key] if a.link else a)
        else:
            pairs = source.wide(a.ns, [a]).toDF("e", "v").where("v is not null")
        df = pairs.toDF("e", "v")
        for column, term in (("e", e), ("v", v)):
            term = given.get(term, term) if isinstance(term, str) else term
            if isinstance(term, str) and term.startswith("?"):
                df = df.withColumnRenamed(column, term)
            elif term == "_" or term == ANY:
                df = df.drop(column)
            else:
                df = df.where(F.col(column) == F.lit(term.removeprefix(":") if isinstance(term, str) and column == "v" and a.type in ("keyword", "enum") else term)).drop(column)
        return df.distinct()

    waiting = []
    for clause in parts["where"]:
        if isinstance(clause[0], list) and clause[0][0] == "fulltext":
            _, _, ident, text = clause[0]
            a = source.schema.flat[ident.removeprefix(":")]
            (e, v), *_ = clause[1]
            found = Compiler(source).test(Frame(source.wide(a.ns, [a]).toDF("e", "v")), F.col("v"), a, Expr("?fulltext", (HOLE, given.get(text, text)))).df
            waiting.append(found.toDF(e, v))
        elif isinstance(clause[0], list):
            head, *args = clause[0]
            later.append(lambda df, head=head, args=args: df.where(predicate(
                Expr(head, tuple(Var(a) if isinstance(a, str) and a.startswith("?") and a not in given else given.get(a, a) if isinstance(a, str) else a for a in args)),
                F.lit(None), {a: F.col(f"`{a}`") for a in args if isinstance(a, str) and a.startswith("?")})))
        else:
            waiting.append(pattern(*clause[:3]))
    while waiting:  # patterns may come in any order
        at = next((i for i, df in enumerate(waiting) if frame is None or seen & set(df.columns)), 0)
        add(waiting.pop(at))
    for condition in later:
        frame = condition(frame)
    return frame.select(F.col(f"`{parts['find'][0]}`").alias("eid")).distinct()
