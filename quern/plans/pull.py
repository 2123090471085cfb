"""Models of what is returned, and the nested projection that they compile to."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.normalise import nested_rules
from quern.plans.schema import Attribute, Schema
from quern.sources.base import Source
from quern.terms import DocumentError

#: Levels to which a "yield" is followed, unless a call says otherwise. What lies beyond is shown by its ids.
YIELD_DEPTH = 6


def complete(model: dict, schema: Schema, blank: bool = False) -> dict:
    """A model with the schema's defaults filled in: plain attributes "checked" ("unchecked" under
    ``blank``), references "unchecked"; what the model says wins."""
    default = "unchecked" if blank else "checked"
    return {ns: _branch(rule, schema.branch(ns), default, schema) for ns, rule in nested_rules(model).items()}


def _defaults(node: dict, directive: str) -> dict:
    return {k: _defaults(v, directive) if isinstance(v, dict) else "unchecked" if v.type in ("ref", "alias") else directive for k, v in node.items()}


def _branch(rule: Any, node: dict, default: str, schema: Schema) -> dict:
    if rule in ("checked", "unchecked"):
        return _defaults(node, rule)
    if not isinstance(rule, dict):
        raise DocumentError("wrong-model", f"{rule!r}: branches take a model, checked or unchecked")
    out = _defaults(node, default)
    for key, inner in rule.items():
        if key == "+":
            out["+"] = complete(inner, schema, default == "unchecked")
            continue
        found = node.get(key)
        if found is None:
            raise DocumentError("wrong-model", f"{key} is not in the schema", key=key)
        out[key] = _branch(inner, found, default, schema) if isinstance(found, dict) else _leaf(inner, found, default, schema)
    return out


def _leaf(rule: Any, a: Attribute, default: str, schema: Schema) -> Any:
    if a.type != "ref":
        if rule not in ("checked", "unchecked"):
            raise DocumentError("wrong-model", f"{rule!r} for {a.ident}: attributes take checked or unchecked")
        return rule
    if rule in ("unchecked", "id", "yield"):
        return rule
    if rule == "checked":
        return _defaults(schema.branch(a.link.ns), "checked")
    if isinstance(rule, dict):
        return _branch(rule, schema.branch(a.link.ns), default, schema)
    raise DocumentError("wrong-model", f"{rule!r} for {a.ident}: references take a model, checked, unchecked, id or yield")


class Puller:
    """``narrow``: the ids are a selection, so that references are cut down to those that it reaches, at
    every level, before they are grouped."""

    def __init__(self, source: Source, with_ids: bool = False, yield_depth: int = YIELD_DEPTH, narrow: bool = False):
        self.source, self.schema, self.with_ids, self.yield_depth, self.narrow = source, source.schema, with_ids, yield_depth, narrow

    def carried(self, ns: str, branch: dict) -> list[Attribute]:
        """The single-valued stored attributes that the model takes from the namespace's own rows."""
        out: list[Attribute] = []

        def walk(node: dict, path: str) -> None:
            for key, rule in node.items():
                a = self.schema.flat.get(f"{path}/{key}")
                if key == "+" or rule == "unchecked":
                    continue
                if a is None:
                    walk(rule, f"{path}/{key}")
                elif not a.many and not (a.link and (a.link.reverse or a.link.mutual)):
                    out.append(a)

        walk(branch, ns)
        return out

    def documents(self, ids: DataFrame, model: dict, carrying: str | None = None) -> DataFrame:
        """``eid`` and a struct for each namespace of the model, for the ids. If the ids carry the
        columns of a namespace, its struct is made from them."""
        out = ids.select("eid")
        if carrying in model:
            inner = self.namespace(carrying, model[carrying], model, 0, base=ids)
            out = inner.withColumnRenamed("doc", carrying) if inner is not None else out
        for ns, branch in model.items():
            if ns == carrying:
                continue
            inner = self.namespace(ns, branch, model, 0, within=out)
            if inner is not None:
                out = out.join(inner.select(F.col("eid").alias("_e"), F.col("doc").alias(ns)), F.col("eid") == F.col("_e"), "left").drop("_e")
        return out

    def namespace(self, ns: str, branch: dict, top: dict, depth: int, path: str = "", base: DataFrame | None = None,
                  within: DataFrame | None = None) -> DataFrame | None:
        """(eid, doc) for every entity of the namespace - or those of ``base``, which has the columns
        it needs, or those that are ``within`` some ids - or None if the model keeps nothing of it."""
        fields: list[tuple[str, Any]] = []  # name, and its attribute and rule, or an inner branch
        for key, rule in branch.items():
            if rule == "unchecked" or key == "+":
                continue
            ident = "/".join(x for x in (ns, path, key) if x)
            a = self.schema.flat.get(ident)
            fields.append((key, (a, rule)))
        single = [a for _, (a, rule) in fields if a is not None and not a.many and not a.link]
        stored_refs = [a for _, (a, rule) in fields if a is not None and a.link and not a.link.reverse and not a.many]
        df = self.source.wide(ns, single + stored_refs) if base is None else base
        if base is None and within is not None and self.narrow:
            df = df.join(within.select(F.col("eid").alias("_within")), F.col("eid") == F.col("_within"), "left_semi")
        own = df  # the entities, before anything is joined to them
        columns: list[Column] = []
        for i, (key, (a, rule)) in enumerate(fields):
            name = f"_f{i}"
            if a is None:
                inner = self.namespace(ns, rule, top, depth, "/".join(x for x in (path, key) if x), base, within)
                if inner is None:
                    continue
                df = self.joined(df, inner, F.col("eid"), name)
            elif not a.link and not a.many:
                df = df.withColumn(name, F.col(f"`{a.ident}`"))
            elif not a.link:
                pairs = self.source.pairs(a)
                pairs = pairs.join(own.select(F.col("eid").alias("e")), "e", "left_semi") if self.narrow else pairs
                sets = pairs.groupBy("e").agg(F.array_sort(F.collect_set("v")).alias("doc")).withColumnRenamed("e", "eid")
                df = self.joined(df, sets, F.col("eid"), name)
            else:
                got = self.link(df, own, a, rule, top, depth, name)
                if got is None:
                    continue
                df = got
            columns.append(F.col(name).alias(key))
        if self.with_ids and not path:
            columns.append(F.struct(F.struct(F.col("eid").alias("id")).alias("db")).alias("+"))
        for extra_ns, extra in (branch.get("+") or {}).items():
            inner = self.namespace(extra_ns, extra, top, depth, within=own)
            if inner is not None:
                df = self.joined(df, inner, F.col("eid"), f"_p{extra_ns}")
                columns.append(F.struct(F.col(f"_p{extra_ns}").alias(extra_ns)).alias(f"+{extra_ns}"))
        if not columns:
            return None
        return df.select("eid", F.struct(*columns).alias("doc"))

    @staticmethod
    def joined(df: DataFrame, inner: DataFrame, key: Column, name: str) -> DataFrame:
        return df.join(inner.select(F.col("eid").alias("_k"), F.col("doc").alias(name)), key == F.col("_k"), "left").drop("_k")

    def link(self, df: DataFrame, own: DataFrame, a: Attribute, rule: Any, top: dict, depth: int, name: str) -> DataFrame | None:
        forward_one = not a.link.reverse and not a.many and not a.link.mutual
        if rule == "id" and forward_one:
            return df.withColumn(name, F.col(f"`{a.ident}`"))
        beyond = False
        if rule == "yield":
            beyond = depth >= self.yield_depth
            rule, depth = "id" if beyond else top.get(a.link.ns, {}), depth + 1

        def marked(ids: Column) -> Column:
            """The id of an entity that is not followed."""
            return F.struct(F.struct(F.struct(ids.alias("id")).alias("db")).alias("+"))

        if rule == "id" and forward_one:  # only beyond a yield
            target = F.col(f"`{a.ident}`")
            return df.withColumn(name, F.when(target.isNotNull(), marked(target)))
        if forward_one:
            target = own.select(F.col(f"`{a.ident}`").alias("eid")).where("eid is not null")
            child = self.namespace(a.link.ns, rule, top, depth, within=target)
            return None if child is None else self.joined(df, child, F.col(f"`{a.ident}`"), name)
        pairs = self.source.pairs(self.schema.flat[a.link.key])
        if a.link.mutual:
            pairs = pairs.union(pairs.select("v", "e")).toDF("e", "v").distinct()
        near, far = ("v", "e") if a.link.reverse else ("e", "v")
        edges = pairs.select(F.col(near).alias("eid"), F.col(far).alias("_far"))
        if self.narrow:
            edges = edges.join(own.select(F.col("eid").alias("_near")), F.col("eid") == F.col("_near"), "left_semi")
        if rule == "id":
            shown = marked(F.col("_far")) if beyond else F.col("_far")
            sets = edges.groupBy("eid").agg(F.array_sort(F.collect_set(shown)).alias("doc"))
        else:
            child = self.namespace(a.link.ns, rule, top, depth, within=edges.select(F.col("_far").alias("eid")))
            if child is None:
                return None
            linked = edges.join(child.withColumnRenamed("eid", "_k"), F.col("_far") == F.col("_k"))
            sets = linked.groupBy("eid").agg(F.array_sort(F.collect_set("doc")).alias("doc"))
        return self.joined(df, sets, F.col("eid"), name)


def plain(value: Any) -> Any:
    """A row as nested dicts without what is missing. Sets come as lists."""
    from pyspark.sql import Row

    if isinstance(value, Row):
        out: dict = {}
        for key, v in value.asDict().items():
            v = plain(v)
            if v is not None and v != {}:
                if key.startswith("+") and len(key) > 1:
                    key = "+"
                out[key] = {**out[key], **v} if key in out and isinstance(v, dict) else v
        return out
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value
