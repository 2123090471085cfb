"""Reading: select documents by documents, raw patterns, and everything that shapes the result."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.compile import Compiler, datalog, run_datalog
from quern.plans.normalise import Context, Entity, Normaliser
from quern.plans.pull import YIELD_DEPTH, Puller, complete, plain
from quern.plans.schema import Schema
from quern.sources.base import Source
from quern.sources.log import cut
from quern.terms import ANY, DocumentError

#: Keys of a call that are no parameters of pipeline functions.
FLAGS = ("ids", "blank", "ban_expressions", "ban_ids", "ban_top_id", "ban_body_ids", "ban_underscores", "schema_required", "schema_restrict",
         "schema_defaults", "use_typecheck", "use_coerce", "skip_normalise", "skip_pack", "skip_typesafety", "no_alias_gen", "generate_ids", "generate_syms",
         "pipeline_typecheck", "pipeline_coerce")


@dataclass
class Record:
    """All that a call made of its document, for inspection: nothing is run but the DataFrames, when they are read."""

    op: str
    given: Any
    context: Context
    entities: list[Entity]
    patterns: list | None
    model: dict | None
    result: DataFrame
    ids: dict[Any, int] = field(default_factory=dict)


@dataclass
class View:
    """A source that can be asked. ``defaults`` are call keys that hold unless a call says otherwise."""

    source: Source
    defaults: dict[str, Any] = field(default_factory=dict)

    @property
    def schema(self) -> Schema:
        return self.source.schema

    def _call(self, op: str, write: bool, given: dict[str, Any]) -> tuple[Context, dict[str, Any], dict | None]:
        """A context, the remaining keys, and the completed pull model."""
        keys = {k: nested_merge(self.defaults.get(k), v) for k, v in (self.defaults | given).items()}
        keys |= (keys.pop("profiles", None) or {}).get(op, {})
        options = dict(keys.pop("options", None) or {})
        options |= {k: keys.pop(k) for k in FLAGS if k in keys}
        schema = keys.pop("schema", None) or self.schema
        schema = schema if isinstance(schema, Schema) else Schema(schema)
        pipeline = dict(keys.pop("pipeline", None) or {})
        access, pull = keys.pop("access", None), keys.pop("pull", None)
        if access is not None:
            pipeline["allow"] = complete(access, schema, bool(options.get("blank")))
            pull = pull if pull is not None else access
        model = complete(pull, schema, bool(options.get("blank"))) if pull is not None else None
        return Context(schema, write, options, pipeline, keys), keys, model

    def _queries(self, query: Any, ctx: Context) -> tuple[list[Entity], list[int]]:
        """The entities of a query or a union of queries, and the ids given as such."""
        entities: list[Entity] = []
        ids: list[int] = []
        for one in query if isinstance(query, (list, set, frozenset, tuple)) else [query]:
            if isinstance(one, str):
                if ctx.options.get("ban_underscores"):
                    raise DocumentError("keyword-banned", "a name as a query", data=one)
                one = {one: ANY}
            if isinstance(one, int) and not isinstance(one, bool):
                if ctx.options.get("ban_ids") or ctx.options.get("ban_top_id"):
                    raise DocumentError("id-banned" if ctx.options.get("ban_ids") else "top-id-banned", "an id as a query", id=one)
                ids.append(one)
            elif isinstance(one, dict):
                entity = Normaliser(ctx)(one)
                if not entity.values and entity.id is None:
                    raise DocumentError("empty-query", "a query without constraints")
                if not entity.values:
                    ids.append(entity.id)
                else:
                    entities.append(entity)
            else:
                raise DocumentError("wrong-input", f"{one!r} is no query", data=one)
        return entities, ids

    def _known(self, ids: list[int]) -> DataFrame:
        """The given ids of which the source has an entity."""
        raise DocumentError("wrong-input", "an id alone does not name a table; give a namespace with it", ids=ids)

    def _ids(self, query: Any, ctx: Context) -> tuple[DataFrame, list[str]]:
        """Distinct ids (``eid``) for the query, and the namespaces that it speaks of."""
        return self._found(*self._queries(query, ctx), ctx)

    def _found(self, entities: list[Entity], ids: list[int], ctx: Context) -> tuple[DataFrame, list[str]]:
        compiler = Compiler(self.source)
        frames = [compiler.ids(e) for e in entities] + ([self._known(ids)] if ids else [])
        spaces = list(dict.fromkeys(ns for e in entities for ns in e.namespaces()))
        out = reduce(DataFrame.union, frames)
        return (out.distinct() if len(frames) > 1 else out), (ctx.schema.namespaces if ids else spaces)

    def _shaped(self, ids: DataFrame, spaces: list[str], ctx: Context, keys: dict[str, Any], model: dict | None, root: Entity | None = None) -> DataFrame:
        """``root``: the only query, if there is one; its scan can then serve the projection, too."""
        first = lambda df: df.orderBy("eid").limit(1) if keys.get("first") else df  # noqa: E731  before the joins of the projection
        what = keys.get("returns", "data")
        if what == "ids":
            return first(ids)
        if what not in ("data", "entities"):
            raise DocumentError("wrong-input", f"returns {what!r}: data, ids or entities")
        blank, with_ids = bool(ctx.options.get("blank")), bool(ctx.options.get("ids"))
        if what == "entities" or model is None:
            model = {} if blank and what == "data" else complete(dict.fromkeys(spaces, "checked"), ctx.schema)
        puller = Puller(self._as_seen(ctx.schema), with_ids, keys.get("yield_depth", YIELD_DEPTH), narrow=bool(keys.get("first")) or root is None or _selects(root))
        carrying = spaces[0] if root is not None and len(spaces) == 1 and spaces[0] in model else None
        if carrying:
            ids = Compiler(self.source).ids(root, puller.carried(carrying, model[carrying]))
        documents = puller.documents(first(ids), model, carrying)
        if what == "entities":
            return documents
        columns = [c for c in documents.columns if c != "eid"]
        if with_ids:
            return documents.select(F.struct(F.col("eid").alias("id")).alias("db"), *columns)
        if not columns:
            return documents.select(F.lit(None).cast("string").alias("_")).distinct()
        return documents.select(*columns).distinct()

    def _as_seen(self, schema: Schema) -> Source:
        return self.source

    def select(self, query: Any, **given: Any) -> Any:
        """A document query as a DataFrame: a struct column for each namespace, one row for each
        distinct document. ``returns``: "data", "ids" or "entities". ``first``: only the entity of the
        smallest id. ``raw``: the compiled patterns instead. ``record``: a Record of all steps; it wins
        over ``raw``. ``yield_depth``: levels to which "yield" is followed."""
        ctx, keys, model = self._call("select", False, given)
        patterns = lambda entities: [datalog(e, ctx.schema, generate=ctx.options.get("generate_syms")) for e in entities]
        if keys.get("raw") and not keys.get("record"):
            return patterns(self._queries(query, ctx)[0])
        view = self._at(keys)
        entities, known = view._queries(query, ctx)
        ids, spaces = view._found(entities, known, ctx)
        out = view._shaped(ids, spaces, ctx, keys, model, entities[0] if len(entities) == 1 and not known else None)
        return Record("select", query, ctx, entities, patterns(entities), model, out) if keys.get("record") else out

    def query(self, patterns: list, inputs: list | None = None, **given: Any) -> DataFrame:
        """Raw find-where patterns; the first find variable is the entity."""
        ctx, keys, model = self._call("select", False, given)
        view = self._at(keys)
        spaces = list(dict.fromkeys(p[1].removeprefix(":").split("/")[0] for p in patterns if isinstance(p, list) and p and isinstance(p[0], str) and p[0] == patterns[1]))
        return view._shaped(run_datalog(view.source, patterns, inputs), spaces or ctx.schema.namespaces, ctx, keys, model)

    def _at(self, keys: dict[str, Any]) -> View:
        return self

    def documents(self, query: Any, **given: Any) -> Any:
        """The result of ``select`` on the driver: nested dicts, or the first one."""
        rows = [{k: v for k, v in plain(row).items() if k != "_"} for row in self.select(query, **given).collect()]
        return (rows[0] if rows else None) if given.get("first") else rows

    def ids(self, query: Any, **given: Any) -> list[int]:
        """The ids of the entities that fit, in order."""
        return sorted(row["eid"] for row in self.select(query, returns="ids", **given).collect())

    def linked(self, query: Any, model: dict, **given: Any) -> DataFrame:
        """Ids that are reachable from the query's entities by the references of a model, those
        included."""
        ctx, _, _ = self._call("select", False, given)
        ids, _ = self._ids(query, ctx)
        return self._reach(ids, complete(model, self.schema))

    def children(self, query: Any, ident: str, **given: Any) -> DataFrame:
        """(eid, child) for every value of a many-valued attribute or reference, either way, of the
        query's entities: the flat form of a pull, for entities that have too many for one row."""
        ctx, keys, _ = self._call("select", False, given)
        view = self._at(keys)
        ids, _ = view._ids(query, ctx)
        a = ctx.schema.flat[ctx.schema.lookup[ident]]
        pairs = view.source.pairs(ctx.schema.flat[a.link.key] if a.link else a)
        near, far = ("v", "e") if a.link and a.link.reverse else ("e", "v")
        return pairs.select(F.col(near).alias("eid"), F.col(far).alias("child")).join(ids, "eid", "left_semi")

    def _reach(self, ids: DataFrame, model: dict) -> DataFrame:
        found = [ids]

        def follow(at: DataFrame, branch: dict, ns: str) -> None:
            for key, rule in branch.items():
                a = self.schema.flat.get(f"{ns}/{key}")
                if a is None or a.type != "ref" or rule == "unchecked":
                    continue
                pairs = self.source.pairs(self.schema.flat[a.link.key])
                near, far = ("v", "e") if a.link.reverse else ("e", "v")
                edges = pairs.select(F.col(near).alias("eid"), F.col(far).alias("next"))
                if rule == "yield":
                    found.append(self._closure(at, edges))
                    continue
                step = edges.join(at, "eid", "left_semi").select(F.col("next").alias("eid")).distinct()
                found.append(step)
                if isinstance(rule, dict):
                    follow(step, rule, a.link.ns)

        for ns, branch in model.items():
            follow(ids, branch, ns)
        return reduce(DataFrame.union, found).distinct()

    @staticmethod
    def _closure(at: DataFrame, edges: DataFrame) -> DataFrame:
        """Everything reachable over one kind of edge. Each round's ids are cut from their lineage."""
        seen = new = at.select("eid").distinct()
        while True:
            new = cut(edges.join(new, "eid", "left_semi").select(F.col("next").alias("eid")).distinct().join(seen, "eid", "left_anti"))
            if not new.limit(1).count():
                return seen
            seen = seen.union(new)


def _selects(root: Entity) -> bool:
    """Whether a query asks for more than that something is there."""
    return root.id is not None or any(v != ANY and not (isinstance(v, Entity) and not _selects(v)) for values in root.values.values() for v in values)


def nested_merge(a: Any, b: Any) -> Any:
    """Call keys over defaults: dicts are merged, anything else is replaced."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: nested_merge(a.get(k), b[k]) if k in b else a[k] for k in dict.fromkeys([*a, *b])}
    return b
