"""Stores: documents in, facts on the log, and every change as one atomic transaction."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.predicates import predicate
from quern.operators.query import Record, View
from quern.plans.compile import Compiler
from quern.plans.normalise import Entity, Normaliser, many, nested
from quern.plans.pull import complete, plain
from quern.plans.schema import SPARK_TYPES, Attribute, Schema
from quern.sources import log as logs
from quern.sources.log import COLUMN, FACTS, FIRST_TX, VALUES, Facts, Log, cut, fact_row
from quern.terms import ANY, HOLE, DocumentError, Expr, TempId, Var, expression

#: Asynchronous commits of a store wait in one line, by path.
_LINES: dict[str, ThreadPoolExecutor] = {}
#: How often a commit is tried on top of what others have committed meanwhile.
ATTEMPTS = 20

#: Functions of a write: name -> function of the column of current values (null where there is none) and the arguments.
WRITE_FUNCTIONS: dict[str, Any] = {"inc": lambda v, by=1: F.coalesce(v, F.lit(0)) + by, "dec": lambda v, by=1: F.coalesce(v, F.lit(0)) - by}


@dataclass
class Commit:
    """What a change did: the transaction (None if simulated), the ids given to temporary ids, and the
    store before and after."""

    tx: int | None
    ids: dict[Any, int]
    before: Store
    after: Store
    changed: DataFrame
    deleted: bool = False

    def select(self, **keys: Any) -> DataFrame:
        """The documents that the change touched, as they are after it; deleted ones as they were."""
        store = self.before if self.deleted else self.after
        ctx, rest, model = store._call("select", False, {"ids": True} | keys)
        return store._shaped(store._known_frame(self.changed), store.schema.namespaces, ctx, rest, model)

    def documents(self, **keys: Any) -> list[dict]:
        return [plain(row) for row in self.select(**keys).collect()]


@dataclass
class Draft:
    """Facts that are not written yet. New ids are counted from ``base``, the first one that was free
    when the draft began; if others have taken some since, the draft is moved."""

    frames: list[DataFrame] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    ids: dict[Any, int] = field(default_factory=dict)
    base: int | None = None
    used: int = 0
    unique: list[tuple[Attribute, Any, int]] = field(default_factory=list)
    unique_frames: list[tuple[Attribute, DataFrame]] = field(default_factory=list)  # each of (e, v)
    known: dict[tuple[str, Any], int] = field(default_factory=dict)  # entities by the values of identities

    def facts(self, spark: SparkSession) -> DataFrame:
        return reduce(DataFrame.unionByName, self.frames + ([spark.createDataFrame(self.rows, FACTS)] if self.rows or not self.frames else []))

    def moved(self, base: int, refs: list[str]) -> Draft:
        """The same draft with its new ids counted from another base."""
        if not self.used or base == self.base:
            return self
        own = range(self.base, self.base + self.used)
        at, l = FACTS.names.index("a"), FACTS.names.index("l")
        new = lambda x: x - self.base + base if isinstance(x, int) and x in own else x
        rows = [tuple(new(x) if i == 0 or i == l and row[at] in refs else x for i, x in enumerate(row)) for row in self.rows]
        shift = lambda c: self.shifted(c, base)
        frames = [f.withColumns({"e": shift(F.col("e")), "l": F.when(F.col("a").isin(refs), shift(F.col("l"))).otherwise(F.col("l"))}) for f in self.frames]
        value = lambda a, v: new(v) if a.type == "ref" else v
        column = lambda a: shift(F.col("v")) if a.type == "ref" else F.col("v")
        return Draft(frames, rows, {k: new(v) for k, v in self.ids.items()}, base, self.used, [(a, value(a, v), new(e)) for a, v, e in self.unique],
                     [(a, f.withColumns({"e": shift(F.col("e")), "v": column(a)})) for a, f in self.unique_frames], {k: new(v) for k, v in self.known.items()})

    def shifted(self, ids: Column, base: int) -> Column:
        return F.when(ids.between(self.base, self.base + self.used - 1), ids + (base - self.base)).otherwise(ids) if self.used else ids


class Store(View):
    """A store on a folder. Use ``Store.open``. A snapshot of it is a store, too, with ``tx`` fixed."""

    def __init__(self, spark: SparkSession, log: Log, schema: Schema, defaults: dict | None = None, tx: int | None = None, extra: DataFrame | None = None, steps: int = 0):
        # ``extra`` are the facts of so many simulated changes.
        self.spark, self.log, self._schema, self.fixed, self.extra, self.steps = spark, log, schema, tx, extra, steps
        self.defaults = defaults or {}
        self._draft: Draft | None = None
        self._extra_sizes: dict[str, int] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: dict | Schema, reset: bool = False, **defaults: Any) -> Store:
        """Open the store at ``path``, make it if it is not there, or anew with ``reset``. Further keys
        hold for every call."""
        log = Log(spark, path)
        if reset and log.exists():
            log.drop()
        if not log.exists():
            log.create()
        return cls(spark, log, schema if isinstance(schema, Schema) else Schema(schema), defaults)

    def close(self) -> None:
        """Nothing is held open."""

    def __repr__(self) -> str:
        return f"Store({self.log.path!r}, tx={self.tx}, {self.schema})"

    @property
    def schema(self) -> Schema:
        return self._schema

    @property
    def tx(self) -> int:
        return self.fixed if self.fixed is not None else self.log.manifest()[1]["tx"]

    @property
    def source(self) -> Facts:
        return self._facts()

    def _facts(self, history: bool = False) -> Facts:
        tx = self.tx
        facts = self.log.facts(tx, history)
        return Facts(self._schema, facts.unionByName(self.extra) if self.extra is not None else facts, self._sizes(tx, history))

    def _sizes(self, tx: int, history: bool) -> Callable[[], dict[str, int]]:
        found: dict[str, int] = {}

        def sizes() -> dict[str, int]:
            if not found:
                if self.extra is not None and self._extra_sizes is None:
                    self._extra_sizes = {r["a"]: r["count"] for r in self.extra.groupBy("a").count().collect()}
                found.update(Counter(self.log.sizes(tx, history)) + Counter(self._extra_sizes or {}))
            return found

        return sizes

    def snapshot(self, at: int | datetime | None = None) -> Store:
        """The store as of a transaction or an instant, or as it is now."""
        if isinstance(at, datetime):
            at = at if at.tzinfo else at.replace(tzinfo=UTC)
            at = max((t for t, when in self.log.times().items() if when <= at), default=FIRST_TX)
        tx = self.tx if at is None else at
        return Store(self.spark, self.log, self._schema, self.defaults, tx, self.extra, self.steps)

    def _at(self, keys: dict[str, Any]) -> Store:
        store = keys.get("db") or keys.get("connection") or self
        return store.snapshot(keys["at"]) if keys.get("at") is not None else store

    def _as_seen(self, schema: Schema) -> Facts:
        source = self.source
        return Facts(schema, source.facts, source.sizes)

    def _known(self, ids: list[int]) -> DataFrame:
        return self.source.current().where(F.col("e").isin(ids)).select(F.col("e").alias("eid")).distinct()

    def _known_frame(self, ids: DataFrame) -> DataFrame:
        return self.source.current().join(ids.select(F.col("eid").alias("e")), "e", "left_semi").select(F.col("e").alias("eid")).distinct()

    # History

    def transactions(self, ident: str, value: Any = None) -> list[int]:
        """Numbers of the transactions that touched an attribute (with a value), in order."""
        a = self.schema.flat[self.schema.lookup[ident]]
        facts = self._facts(history=True).facts.where(F.col("a") == a.ident)
        if value is not None:
            facts = facts.where(F.col(COLUMN[a.type]) == F.lit(value))
        return [r["tx"] for r in facts.select("tx").distinct().orderBy("tx").collect()]

    def history(self) -> DataFrame:
        """All facts, retractions included."""
        return self._facts(history=True).facts

    def compact(self) -> None:
        """Put the log's folders together and keep the state, so that reads start from it."""
        self.log.compact(self._schema)

    def transaction_time(self, tx: int) -> datetime:
        return self.log.times()[tx]

    def schema_properties(self) -> DataFrame:
        """ident, type, cardinality of the stored attributes."""
        rows = [(a.ident, a.type, "many" if a.many else "one") for a in self.schema.stored()]
        return self.spark.createDataFrame(rows, "ident string, type string, cardinality string")

    # Writing

    def insert(self, docs: dict | list[dict], **given: Any) -> Any:
        """One or several documents as one transaction; equal temporary ids are one entity."""
        given = {"schema_required": True, "schema_restrict": True, "schema_defaults": True} | self._set_flags(given) | given
        ctx, keys, _ = self._call("insert", True, given)
        entities = [Normaliser(ctx)(d) for d in (docs if isinstance(docs, list) else [docs])]
        if keys.get("raw"):
            return entities
        draft = self._draft or Draft()
        self._look_up(entities, draft)
        roots = [self._emit(e, draft, generate=ctx.options.get("generate_ids")) for e in entities]
        if keys.get("record"):
            return Record("insert", docs, ctx, entities, None, None, draft.facts(self.spark), draft.ids)
        return self._finish(draft, keys, self.spark.createDataFrame([(r,) for r in roots], "eid bigint"))

    def _set_flags(self, given: dict) -> dict:
        return {k: v for k, v in (self.defaults.get("options") or {}).items() if k.startswith("schema_")}

    def _base(self) -> int:
        """The first free id."""
        return self.log.manifest()[1]["next"]

    def _new_id(self, draft: Draft, key: Any = None, generate: Any = None) -> int:
        if key is not None and key in draft.ids:
            return draft.ids[key]
        if generate is False:
            raise DocumentError("wrong-input", "an entity without an id, and generate_ids is off")
        if callable(generate):  # ids of the caller's own
            out = generate()
        else:
            draft.base = self._base() if draft.base is None else draft.base
            out = draft.base + draft.used
            draft.used += 1
        if key is not None:
            draft.ids[key] = out
        return out

    def _look_up(self, entities: list[Entity], draft: Draft) -> None:
        """The known entities among those that identities name, with one query for each identity."""
        wanted: dict[str, set] = {}

        def walk(entity: Entity) -> None:
            for ident, values in entity.values.items():
                plain_values = [v for v in values if not isinstance(v, (Entity, Expr, Var, TempId))]
                if self.schema.flat[ident].unique == "identity":
                    wanted.setdefault(ident, set()).update(plain_values)
                for v in values:
                    if isinstance(v, Entity):
                        walk(v)

        for entity in entities:
            walk(entity)
        for ident, values in wanted.items():
            values = [v for v in values if (ident, v) not in draft.known]
            if values:
                found = self.source.pairs(self.schema.flat[ident]).where(F.col("v").isin(values)).collect()
                draft.known.update({(ident, r["v"]): r["e"] for r in found})

    def _emit(self, entity: Entity, draft: Draft, fixed: Any = None, generate: Any = None) -> Any:
        """Facts for an entity and those below it; returns its id. ``fixed`` stands in for the root."""
        e = fixed if fixed is not None else self._entity_id(entity, draft, generate)
        if not entity.values and (entity.id is None or fixed is not None):
            raise DocumentError("empty-entity", "an entity without values")
        for ident, values in entity.values.items():
            a = self.schema.flat[ident]
            for v in values:
                if isinstance(v, Expr):
                    v = self._applied(e, a, v)
                if isinstance(v, Entity):
                    v = self._emit(v, draft, generate=generate)
                elif isinstance(v, (TempId, Var)):
                    v = self._new_id(draft, v.seed if isinstance(v, TempId) else v.name, generate)
                if a.link and a.link.reverse:
                    draft.rows.append(fact_row(v, self.schema.flat[a.link.key], e))
                else:
                    draft.rows.append(fact_row(e, a, v))
                    if a.unique:
                        draft.unique.append((a, v, e))
        return e

    def _entity_id(self, entity: Entity, draft: Draft, generate: Any = None) -> int:
        if isinstance(entity.id, int):
            return entity.id
        if entity.id is not None:
            return self._new_id(draft, entity.id.seed if isinstance(entity.id, TempId) else entity.id.name, generate)
        # An identity that is known, from the store or from this change, names the entity.
        keys = [(i, values[0]) for i, values in entity.values.items() if self.schema.flat[i].unique == "identity" and not isinstance(values[0], Expr)]
        found = next((draft.known[k] for k in keys if k in draft.known), None)
        e = self._new_id(draft, generate=generate) if found is None else found
        draft.known.update(dict.fromkeys(keys, e))
        return e

    def _written(self, a: Attribute, v: Expr, ids: DataFrame) -> DataFrame:
        """(e, v): a write function's value for every one of the ids."""
        if v.head not in WRITE_FUNCTIONS:
            raise DocumentError("wrong-input", f"unknown write function {v.head}", data=v)
        if a.many or a.type == "ref":
            raise DocumentError("wrong-input", f"a write function for {a.ident}, which has no single plain value", data=v)
        value = WRITE_FUNCTIONS[v.head](F.col("v"), *(x for x in v.args if x != HOLE)).cast(SPARK_TYPES[a.type])
        now = self.source.pairs(a).withColumnRenamed("e", "eid")
        return ids.join(now, "eid", "left").select(F.col("eid").alias("e"), value.alias("v")).where("v is not null")

    def _applied(self, e: Any, a: Attribute, v: Expr) -> Any:
        found = self._written(a, v, self.spark.createDataFrame([(e,)], "eid bigint")).collect()
        if not found:
            raise DocumentError("wrong-input", f"{v.head} gives no value", data=v)
        return found[0]["v"]

    def transact(self, facts: list[tuple], **given: Any) -> Any:
        """Raw facts: (e, attribute, value) to add, (e, attribute, value, False) to retract."""
        draft = self._draft or Draft()
        for e, ident, value, *rest in facts:
            e = self._new_id(draft, e.seed) if isinstance(e, TempId) else e
            value = self._new_id(draft, value.seed) if isinstance(value, TempId) else value
            draft.rows.append(fact_row(e, self.schema.flat[ident], value, *rest))
            if self.schema.flat[ident].unique and (not rest or rest[0]):
                draft.unique.append((self.schema.flat[ident], value, e))
        return self._finish(draft, given, self.spark.createDataFrame([(r[0],) for r in draft.rows], "eid bigint").distinct())

    def insert_frame(self, ns: str, frame: DataFrame, **given: Any) -> Any:
        """Rows as entities: each column whose name is an attribute of ``ns``; array columns are sets.
        Types, enumerations, restrictions, defaults, required and unique attributes are those of
        ``insert``, by whole columns; an identity that is known names its entity. Other columns are ignored."""
        own = {a.name: a for a in self.schema.stored() if a.ns == ns}
        columns: dict[str, Column] = {}
        wrong: dict[str, tuple[str, Column]] = {}  # what must not be, and its tag
        for name, a in own.items():
            kind = f"array<{SPARK_TYPES[a.type]}>" if a.many else SPARK_TYPES[a.type]
            raw = F.col(f"`{name}`") if name in frame.columns else F.lit(None).cast(kind)
            if a.type in ("enum", "keyword"):
                prefix = "^:?" + (f"(?:{re.escape(ns_)}/)?" if (ns_ := a.enum_ns or a.keyword_ns) else "")
                raw = F.transform(raw, _without(prefix)) if a.many else _without(prefix)(raw)
            column = raw.cast(kind) if a.many else raw.try_cast(kind)
            if not a.many and name in frame.columns:
                wrong[f"t_{name}"] = ("wrong-type", raw.isNotNull() & column.isNull())
            if a.default is not None:
                column = F.coalesce(column, _per_row(a.default, kind) if callable(a.default) else F.lit(a.default).cast(kind))
            if a.values is not None:
                wrong[f"e_{name}"] = ("wrong-input", F.exists(column, _outside(a.values)) if a.many else _outside(a.values)(column))
            if a.restrict is not None:
                wrong[f"r_{name}"] = ("failed-restriction", ~_passes(a.restrict, column))
            if a.required:
                wrong[f"m_{name}"] = ("required", column.isNull())
            columns[name] = column
        rows = cut(frame.select(*(c.alias(n) for n, c in columns.items()), *(c.alias(f"_{n}") for n, (_, c) in wrong.items())))
        sets = [n for n, a in own.items() if a.many]
        identity = next((a for a in own.values() if a.unique == "identity"), None)
        each, total = 1, 0
        if wrong or sets or identity is not None:
            found = rows.agg(F.count("*").alias("rows"), *(F.sum(F.size(n)).alias(f"s_{n}") for n in sets), *(F.max(f"_{n}").alias(n) for n in wrong)).first()
            total = found["rows"]
            each = max([1, *(-(-(found[f"s_{n}"] or 0) // max(total, 1)) for n in sets)])
            bad = [n for n in wrong if found[n]]
            if bad:
                tag = wrong[bad[0]][0]
                keys = [f"{ns}/{n[2:]}" for n in bad if wrong[n][0] == tag]
                raise DocumentError(tag, f"rows that are not allowed, by {keys}", keys=keys, nsv=keys[0].split("/"))
        rows = rows.select(*columns, F.monotonically_increasing_id().alias("_id"))
        draft = self._draft or Draft()
        draft.base = self._base() if draft.base is None else draft.base
        entities = None
        if identity is not None:  # rows whose identity is known are that entity
            known = self.source.pairs(identity).select(F.col("e"), F.col("v").alias("_v"))
            rows = rows.join(known, rows[identity.name] == known["_v"], "left").drop("_v")
            if tasks := logs.parts(self.spark, total * each):
                rows = rows.repartition(tasks, "_id")
            rows = cut(rows)
            entities, rows = rows.where("e is not null"), rows.where("e is null").drop("e")
        numbered, count = _numbered(rows.drop("_id"), each)
        numbered = numbered.withColumn("e", F.lit(draft.base + draft.used) + F.col("_rank")).drop("_rank")
        numbered = numbered if entities is None else numbered.unionByName(entities.drop("_id"))
        draft.used += count
        for name, a in own.items():
            value = F.explode(name) if a.many else F.col(name)
            pairs = numbered.select("e", value.alias("v")).where("v is not null")
            draft.frames.append(pairs.select("e", F.lit(a.ident).alias("a"), *_value_columns(a, F.col("v")), F.lit(True).alias("added")))
            if a.unique:
                draft.unique_frames.append((a, pairs))
        return self._finish(draft, given, numbered.select(F.col("e").alias("eid")))

    def _matching(self, query: Any, op: str, given: dict) -> tuple[DataFrame, list[str], dict]:
        ctx, keys, _ = self._call(op, False, {k: v for k, v in given.items() if k not in ("transact", "simulate")})
        ctx.options.pop("ban_ids", None) if op == "update" and isinstance(query, dict) else None
        ids, spaces = self._ids(query, ctx)
        return cut(ids), spaces, keys

    def update(self, query: Any, changes: dict, **given: Any) -> Any:
        """Add the changes to every entity that fits: single values are replaced, sets grow."""
        ids, _, _ = self._matching(query, "update", given)
        return self._update(ids, changes, given)

    def _update(self, ids: DataFrame, changes: dict, given: dict) -> Any:
        given = {"schema_restrict": True, "schema_required": False, "schema_defaults": False} | given
        ctx, keys, _ = self._call("update", True, given)
        entity = Normaliser(ctx)(changes)
        draft = self._draft or Draft()
        for ident, values in list(entity.values.items()):
            a = self.schema.flat[ident]
            for v in [v for v in values if isinstance(v, Expr)]:  # one join for all entities
                pairs = cut(self._written(a, v, ids))
                draft.frames.append(pairs.select("e", F.lit(ident).alias("a"), *_value_columns(a, F.col("v")), F.lit(True).alias("added")))
                if a.unique:
                    draft.unique_frames.append((a, pairs))
            entity.values[ident] = [v for v in values if not isinstance(v, Expr)]
            if values and not entity.values[ident]:
                del entity.values[ident]
        if draft.frames and not entity.values:
            return self._finish(draft, keys, ids)
        # The change is written once with stand-ins, then put on every id by a join.
        template = Draft(base=_STAND_INS)
        self._look_up([entity], template)
        self._emit(entity, template, fixed=-1)
        known = {v: k for k, v in template.ids.items()}
        fresh = [i for i in range(_STAND_INS, _STAND_INS + template.used) if i not in known]
        shared = {i: self._new_id(draft, known[i]) for i in known}
        draft.base = self._base() if draft.base is None else draft.base
        place = {i: k for k, i in enumerate(fresh)}
        numbered, count = _numbered(ids, len(template.rows))
        start = draft.base + draft.used
        draft.used += count * len(fresh)
        rows = [(place.get(r[0], -1), place.get(r[2 + VALUES.index("l")], -1) if COLUMN[self.schema.flat[r[1]].type] == "l" and self.schema.flat[r[1]].type == "ref" else -1,
                 shared.get(r[0], r[0]), *r[1:]) for r in template.rows]
        rows = [(pe, pv, e, a, *(shared.get(x, x) if VALUES[k] == "l" and self.schema.flat[a].type == "ref" else x for k, x in enumerate(vals)), added)
                for pe, pv, e, a, *vals, added in rows]
        facts = self.spark.createDataFrame(rows, T.StructType([T.StructField("pe", T.IntegerType()), T.StructField("pv", T.IntegerType()), *FACTS.fields]))
        # As many rows as the change has facts: broadcast.
        put = numbered.crossJoin(F.broadcast(facts))
        own = F.lit(start) + F.col("_rank") * len(fresh)
        e = F.when(F.col("pe") >= 0, own + F.col("pe")).when(F.col("e") == -1, F.col("eid")).otherwise(F.col("e"))
        target = F.when(F.col("pv") >= 0, own + F.col("pv")).when(F.col("a").isin([a.ident for a in self.schema.stored() if a.type == "ref"]) & (F.col("l") == -1), F.col("eid")).otherwise(F.col("l"))
        draft.frames.append(put.select(e.alias("e"), "a", *((target if c == "l" else F.col(c)).alias(c) for c in VALUES), "added"))
        draft.unique += [(a, v, e) for a, v, e in template.unique if e != -1 and e not in place]
        for a, v, e in template.unique:
            if e == -1:
                holders = self.source.pairs(a).where(F.col("v") == F.lit(v)).select(F.col("e").alias("eid"))
                if count > 1 or holders.join(ids, "eid", "left_anti").limit(1).count():
                    raise DocumentError("unique", f"{a.ident} has the value {v!r} already", nsv=a.ident.split("/"))
        return self._finish(draft, keys, ids)

    def delete(self, query: Any, **given: Any) -> Any:
        """Retract every fact of the entities that fit, of their components, and all references to
        them. The documents of the result are those from before."""
        ids, spaces, keys = self._matching(query, "delete", given)
        return self._delete(ids, spaces, given)

    def _delete(self, ids: DataFrame, spaces: list[str], given: dict) -> Any:
        source = self.source
        for a in self.schema.stored():
            if a.component:
                edges = source.pairs(a).select(F.col("e").alias("eid"), F.col("v").alias("next"))
                ids = self._closure(ids, edges)
        gone = source.current()
        if count := source.parts(self.schema.stored()):  # each task then writes its share
            gone = gone.repartition(count, "e")
        # The ids are hashed, so that no facts are sorted to meet them.
        named = lambda name: ids.select(F.col("eid").alias(name)).hint("shuffle_hash")
        out = gone.join(named("e"), "e", "left_semi")
        refs = [a.ident for a in self.schema.stored() if a.type == "ref"]
        into = gone.where(F.col("a").isin(refs)).join(named("l"), "l", "left_semi").join(named("e"), "e", "left_anti").select(gone.columns)
        draft = self._draft or Draft()
        draft.frames.append(out.union(into).select("*", F.lit(False).alias("added")).select(FACTS.names))
        return self._finish(draft, given, ids, old=True)

    def delete_all(self, query: Any, **given: Any) -> Any:
        """Delete also what is reachable by the references that the ``access`` model allows."""
        access = given.get("access") or self.defaults.get("access")
        if access is None:
            raise DocumentError("missing-allow-model", "delete_all needs an access model")
        ids, spaces, _ = self._matching(query, "delete", given)
        return self._delete(self._reach(ids, complete(access, self.schema)), spaces, given)

    def retract(self, query: Any, entries: Any, **given: Any) -> Any:
        """Remove values: an entry is a path of attributes, or a path and what to remove - a value, a
        set of values, or an expression on the value."""
        ids, spaces, _ = self._matching(query, "retract", given)
        return self._retract(ids, many(entries) if not isinstance(entries, tuple) else [entries], spaces, given)

    def _retract(self, ids: DataFrame, entries: list, spaces: list[str], given: dict) -> Any:
        ctx, keys, _ = self._call("retract", True, given)
        draft = self._draft or Draft()
        for entry in entries:
            path, what = (entry, ANY) if isinstance(entry, str) else entry if isinstance(entry, (tuple, list)) and len(entry) == 2 else (None, None)
            if not isinstance(path, str):
                raise DocumentError("invalid-retraction-entry", f"{entry!r}", value=entry)
            steps = path.split("/")
            allow = ctx.pipeline.get("allow")
            if allow is not None:
                at: Any = allow
                for step in steps:
                    at = at.get(step) if isinstance(at, dict) else None
                if at in (None, "unchecked"):
                    raise DocumentError("pipeline-path-access-not-allowed", path, path=steps)
            at_ids, a = self._walked(ids, steps)
            reverse = bool(a.link and a.link.reverse)
            stored = self.schema.flat[a.link.key] if a.link else a
            column = F.col("e") if reverse else F.col("v")
            pairs = self.source.pairs(stored)
            if what is not ANY:
                if isinstance(what, tuple):
                    pairs = pairs.where(predicate(expression(what), column))
                else:
                    pairs = pairs.where(column.isin(many(what)))
            own = "v" if reverse else "e"
            pairs = pairs.join(at_ids.select(F.col("eid").alias(own)), own, "left_semi")
            draft.frames.append(pairs.select("e", F.lit(stored.ident).alias("a"), *_value_columns(stored, F.col("v")), F.lit(False).alias("added")))
        return self._finish(draft, keys, ids)

    def _walked(self, ids: DataFrame, steps: list[str]) -> tuple[DataFrame, Attribute]:
        """Follow a path through references to its last attribute."""
        path: list[str] = []
        for i, step in enumerate(steps):
            if step == "+":
                path = []
                continue
            if step == "db":
                raise DocumentError("walk-path-db-id-not-allowed", "/".join(steps))
            path.append(step)
            a = self.schema.flat.get(self.schema.lookup.get("/".join(path), ""))
            if a is None:
                if not any(x.startswith("/".join(path) + "/") for x in self.schema.flat):
                    raise DocumentError("walk-path-key-not-in-schema", step, k=step)
                continue
            if i == len(steps) - 1:
                return ids, a
            if a.type != "ref":
                raise DocumentError("walk-path-cannot-walk-past-non-ref", a.ident)
            ids, path = self._far(ids, a), [a.link.ns] if a.link.ns else []
        raise DocumentError("walk-path-invalid-key", "/".join(steps))

    def _far(self, ids: DataFrame, a: Attribute) -> DataFrame:
        pairs = self.source.pairs(self.schema.flat[a.link.key])
        near, far = ("v", "e") if a.link.reverse else ("e", "v")
        return pairs.join(ids.select(F.col("eid").alias(near)), near, "left_semi").select(F.col(far).alias("eid")).distinct()

    def _in(self, query: Any, path: list, op: str, given: dict) -> tuple[DataFrame, str]:
        """From the entities that fit along reference, term, reference, term ..."""
        if len(path) % 2:
            raise DocumentError("wrong-input", "the path takes a reference and a term in turn", path=path)
        ids, spaces, _ = self._matching(query, op, given)
        ns = spaces[0] if len(spaces) == 1 else ""
        for key, term in zip(path[::2], path[1::2]):
            ident = key if key in self.schema.lookup or not ns else f"{ns}/{key}"
            a = self.schema.flat.get(self.schema.lookup.get(ident, ""))
            if a is None or a.type != "ref" or not a.link.ns:
                raise DocumentError("cannot-perform-reverse-lookup", ident, value=ident)
            ids, ns = self._far(ids, a), a.link.ns
            if isinstance(term, int):
                ids = ids.where(F.col("eid") == term)
            elif term not in ("_", ANY):
                ctx, _, _ = self._call("select", False, {})
                inner = term if all(k.split("/")[0] == "+" for k in term) else {ns: nested(term)}
                ids = ids.join(Compiler(self.source).ids(Normaliser(ctx)(inner)), "eid", "left_semi")
        return cut(ids), ns

    def update_in(self, query: Any, path: list, changes: dict, **given: Any) -> Any:
        ids, ns = self._in(query, path, "update", given)
        return self._update(ids, {ns: changes}, given)

    def delete_in(self, query: Any, path: list, **given: Any) -> Any:
        ids, ns = self._in(query, path, "delete", given)
        return self._delete(ids, [ns], given)

    def retract_in(self, query: Any, path: list, entries: Any, **given: Any) -> Any:
        ids, ns = self._in(query, path, "retract", given)
        full = [f"{ns}/{e}" if isinstance(e, str) else (f"{ns}/{e[0]}", *e[1:]) for e in (many(entries) if not isinstance(entries, tuple) else [entries])]
        return self._retract(ids, full, [ns], given)

    @contextmanager
    def sync(self, **given: Any) -> Iterator[Store]:
        """Several changes against one snapshot, committed as one transaction at the end."""
        held = Store(self.spark, self.log, self._schema, self.defaults, self.tx, self.extra, self.steps)
        held._draft = Draft()
        yield held
        draft, held._draft = held._draft, None
        self._finish(draft, given, self.spark.createDataFrame([], "eid bigint"))

    # Committing

    def _finish(self, draft: Draft, keys: dict, changed: DataFrame, old: bool = False) -> Any:
        if self._draft is not None:  # inside sync(): the facts wait
            return draft
        how = keys.get("transact", "resolve")
        if how in ("async", "promise"):
            line = _LINES.setdefault(self.log.path, ThreadPoolExecutor(1, thread_name_prefix="commit"))
            return line.submit(self._commit, draft, keys, changed, old)
        if how not in ("resolve", "report"):
            raise DocumentError("wrong-input", f"transact {how!r}: resolve, report, promise or async")
        return self._commit(draft, keys, changed, old)

    def _commit(self, draft: Draft, keys: dict, changed: DataFrame, old_only: bool = False) -> Commit:
        """Commit on top of the latest transaction. If another writer was faster, the new ids are
        counted on from theirs, unique values are checked against what they wrote, and it is tried again."""
        target = keys.get("connection") or self
        refs = [a.ident for a in self.schema.stored() if a.type == "ref"]
        for _ in range(ATTEMPTS):
            version, before = target.log.manifest()
            if self.fixed is not None and self.fixed != before["tx"] and not keys.get("simulate"):
                raise DocumentError("conflict", "a snapshot is not the latest state")
            changed = changed.select(draft.shifted(F.col("eid"), before["next"]).alias("eid"))
            draft = draft.moved(before["next"], refs)
            facts = draft.facts(self.spark)
            old = self.snapshot() if target is self and self.fixed is not None else target.snapshot(before["tx"])
            self._check_unique(draft, old.source)
            if keys.get("simulate"):
                extra = facts.withColumn("tx", F.lit(old.tx + old.steps + 1).cast("long")).select(*FACTS.names, "tx")
                extra = extra if old.extra is None else old.extra.unionByName(extra)
                after = Store(self.spark, target.log, target._schema, target.defaults, old.tx, extra, old.steps + 1)
                return Commit(None, draft.ids, old, after, changed, old_only)
            try:
                tx = target.log.commit(version, before, facts.select(FACTS.names), draft.used)
            except DocumentError as error:
                if "conflict" not in error.tags:
                    raise
                continue
            return Commit(tx, draft.ids, old, target.snapshot(tx), changed, old_only)
        raise DocumentError("conflict", f"other writers were faster {ATTEMPTS} times")

    def _check_unique(self, draft: Draft, source: Facts) -> None:
        """No two entities may have a value of a unique attribute."""
        by: dict[str, dict[Any, int]] = {}
        for a, v, e in draft.unique:
            if by.setdefault(a.ident, {}).setdefault(v, e) != e:
                raise DocumentError("unique", f"{a.ident} has the value {v!r} twice", nsv=a.ident.split("/"))
        for ident, values in by.items():
            for row in source.pairs(self.schema.flat[ident]).where(F.col("v").isin(list(values))).collect():
                if values[row["v"]] != row["e"]:
                    raise DocumentError("unique", f"{ident} has the value {row['v']!r} already", nsv=ident.split("/"))
        for a, pairs in draft.unique_frames:
            both = pairs.select("e", "v").union(source.pairs(a).select("e", "v"))
            twice = both.groupBy("v").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count("*").alias("n")).where("a < b").limit(1)
            again = pairs.groupBy("v").count().where("count > 1").limit(1)  # two rows of one entity
            if twice.select("v").union(again.select("v")).limit(1).count():
                raise DocumentError("unique", f"{a.ident} has a value twice", nsv=a.ident.split("/"))


#: Ids of a change that is put on many entities, before it is.
_STAND_INS = -(1 << 40)


def _without(prefix: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c.cast("string"), prefix, "")


def _outside(values: frozenset) -> Callable[[Column], Column]:
    return lambda c: ~c.isin(sorted(values))


def _passes(restrict: Any, column: Column) -> Column:
    """Whether the values pass a restriction, which is a Python function; nulls do."""
    test = restrict[1] if isinstance(restrict, (list, tuple)) else restrict

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is None or bool(test(list(v) if isinstance(v, np.ndarray) else v))).astype(bool)

    return F.when(column.isNull(), True).otherwise(F.pandas_udf(run, "boolean")(column))


def _per_row(default: Any, kind: str) -> Column:
    """A default that is made by a function, once for each row."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([default() for _ in rows])

    return F.pandas_udf(run, kind)(F.monotonically_increasing_id())


def _value_columns(a: Attribute, value: Column) -> list[Column]:
    kinds = dict(zip(VALUES, (f.dataType for f in FACTS.fields[2:])))
    return [(value if c == COLUMN[a.type] else F.lit(None)).cast(kinds[c]).alias(c) for c in VALUES]


def _numbered(df: DataFrame, each: int = 1) -> tuple[DataFrame, int]:
    """``df`` with ``_rank`` 0, 1, ... and the number of rows, without gathering rows: one count for
    each partition comes to the driver. ``each``: facts that a row becomes. Partitions of more
    facts than a task should sort are dealt anew."""
    marked = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counted = lambda: sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    counts = counted()
    if max((n for _, n in counts), default=0) * each > logs.TASK_FACTS:
        tasks = logs.parts(df.sparkSession, sum(n for _, n in counts) * each)
        marked = cut(marked.repartition(tasks, "_id").withColumn("_id", F.monotonically_increasing_id()))
        counts = counted()
    starts = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0)))
    if not starts:
        return marked.withColumn("_rank", F.lit(0).cast("long")).drop("_id"), 0
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for item in starts.items() for x in item)), part)
    return marked.withColumn("_rank", offset + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), sum(n for _, n in counts)


__all__ = ["Commit", "Future", "Store"]
