"""Changes of bound tables and whole-table stages: each returns new frames, nothing is written.

The tables of a ``Tables`` source belong to somebody else, so a change of them is always a
simulated one: the result is a source with changed frames, to be asked further or written anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.coerce import coerce_column
from quern.operators.query import View
from quern.plans.normalise import Normaliser, nested
from quern.plans.schema import SPARK_TYPES, Schema
from quern.sources.tables import Tables
from quern.terms import DocumentError


class TableView(View):
    """A view of bound tables that can be changed in simulation."""

    source: Tables

    def _matched(self, ns: str, query: Any) -> DataFrame:
        """The namespace's rows with ``_hit``, true where the query fits."""
        table = self.source.tables[ns]
        ids = self.select(query, returns="ids").select(F.col("eid").alias("_hit_id"))
        keyed = table.frame.withColumn("_eid", table.column(table.eid))
        return keyed.join(ids, F.col("_eid") == F.col("_hit_id"), "left").withColumn("_hit", F.col("_hit_id").isNotNull())

    def _with(self, ns: str, frame: DataFrame) -> TableView:
        return TableView(self.source.replaced(ns, frame.select(self.source.tables[ns].frame.columns)), self.defaults)

    def update(self, ns: str, query: Any, changes: dict) -> TableView:
        """The attributes of ``changes`` set in every row that fits."""
        ctx, _, _ = self._call("update", True, {"schema_restrict": True})
        entity = Normaliser(ctx)({ns: changes})
        out = self._matched(ns, query)
        for ident, values in entity.values.items():
            a = self.schema.flat[ident]
            name = self.source.tables[ns].columns[a.name]
            out = out.withColumn(name, F.when(F.col("_hit"), F.lit(values[0]).cast(out.schema[name].dataType)).otherwise(F.col(name)))
        return self._with(ns, out)

    def delete(self, ns: str, query: Any) -> TableView:
        """The namespace without the rows that fit."""
        table = self.source.tables[ns]
        ids = self.select(query, returns="ids").select(F.col("eid").alias("_hit_id"))
        return self._with(ns, table.frame.join(ids, table.column(table.eid) == F.col("_hit_id"), "left_anti"))

    def retract(self, ns: str, query: Any, names: list[str], test: Callable[[Column], Column] | None = None) -> TableView:
        """The named attributes emptied in every row that fits (and whose value passes the test)."""
        out = self._matched(ns, query)
        for n in names:
            column = self.source.tables[ns].columns[n]
            hit = F.col("_hit") & (test(F.col(column)) if test else F.lit(True))
            out = out.withColumn(column, F.when(~F.coalesce(hit, F.lit(False)), F.col(column)))
        return self._with(ns, out)

    def insert(self, ns: str, rows: DataFrame) -> TableView:
        """Further rows, by the attributes' names; columns that are not given are null."""
        table = self.source.tables[ns]
        names = {column: name for name, column in table.columns.items()}
        given = [F.col(names[c]).cast(t).alias(c) if names.get(c) in rows.columns else (F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c))
                 for c, t in ((f.name, f.dataType) for f in table.frame.schema.fields)]
        return self._with(ns, table.frame.unionByName(rows.select(*given)))

    def _far(self, query: Any, path: list) -> tuple[list, str]:
        """The query for the far end of reference, term, reference, term ..."""
        if len(path) % 2:
            raise DocumentError("wrong-input", "the path takes a reference and a term in turn", path=path)
        doc: Any = nested(query)
        ns = next(iter(doc))
        inner = doc[ns]
        for key, term in zip(path[::2], path[1::2]):
            ident = key if "/" in key else f"{ns}/{key}"
            a = self.schema.flat.get(self.schema.lookup.get(ident, ""))
            if a is None or a.type != "ref" or not a.link.back:
                raise DocumentError("cannot-perform-reverse-lookup", ident, value=ident)
            back = self.schema.flat[a.link.other].name
            inner = {back: inner} | (nested(term) if isinstance(term, dict) else {})
            ns = a.link.ns
        return {ns: inner}, ns

    def update_in(self, query: Any, path: list, changes: dict) -> TableView:
        far, ns = self._far(query, path)
        return self.update(ns, far, changes)

    def delete_in(self, query: Any, path: list) -> TableView:
        far, ns = self._far(query, path)
        return self.delete(ns, far)

    def retract_in(self, query: Any, path: list, names: list[str]) -> TableView:
        far, ns = self._far(query, path)
        return self.retract(ns, far, names)


class Rows:
    """Pipeline stages on the columns of a namespace's rows."""

    def __init__(self, schema: Schema, ns: str, frame: DataFrame):
        self.schema, self.ns, self.frame = schema, ns, frame

    def _new(self, frame: DataFrame) -> Rows:
        return Rows(self.schema, self.ns, frame)

    def require(self, names: list[str]) -> Rows:
        """Rows in which a named column is null raise when they are read."""
        out = self.frame
        for n in names:
            checked = F.when(F.col(n).isNotNull(), F.col(n)).otherwise(F.raise_error(F.lit(f"no-required: {self.ns}/{n}")).cast(out.schema[n].dataType))
            out = out.withColumn(n, checked)
        return self._new(out)

    def mask(self, rules: dict[str, Any]) -> Rows:
        """Columns dropped ("checked") or emptied where a function of the column is true."""
        out = self.frame
        for n, rule in rules.items():
            out = out.drop(n) if rule == "checked" else out.withColumn(n, F.when(~F.coalesce(rule(F.col(n)), F.lit(False)), F.col(n)))
        return self._new(out)

    def transform(self, rules: dict[str, Any]) -> Rows:
        """Values replaced where there are any, by a constant or a function of the column."""
        out = self.frame
        for n, rule in rules.items():
            out = out.withColumn(n, F.when(F.col(n).isNotNull(), rule(F.col(n)) if callable(rule) else F.lit(rule)))
        return self._new(out)

    convert = transform

    def fill_empty(self, rules: dict[str, Any]) -> Rows:
        """Values where there are none."""
        out = self.frame
        for n, rule in rules.items():
            out = out.withColumn(n, F.coalesce(F.col(n), rule() if callable(rule) else F.lit(rule)))
        return self._new(out)

    def fill_assoc(self, rules: dict[str, list]) -> Rows:
        """Further values of set columns."""
        out = self.frame
        for n, values in rules.items():
            more = F.array(*map(F.lit, values))
            out = out.withColumn(n, F.array_sort(F.array_union(F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)), more)))
        return self._new(out)

    def defaults(self) -> Rows:
        """The schema's defaults where there is no value."""
        own = {a.name: a.default for a in self.schema.stored() if a.ns == self.ns and a.default is not None and not callable(a.default)}
        return self.fill_empty({n: v for n, v in own.items() if n in self.frame.columns})

    def allow(self, names: list[str]) -> Rows:
        """Other columns than the named ones raise."""
        over = [c for c in self.frame.columns if c not in names]
        if over:
            raise DocumentError("not-allowed", f"{over} are not allowed", nsv=[self.ns, over[0]])
        return self

    def ignore(self) -> Rows:
        """Columns that the schema does not know are dropped."""
        return self._new(self.frame.select([c for c in self.frame.columns if f"{self.ns}/{c}" in self.schema.flat]))

    def coerced(self) -> Rows:
        """Every known column as its attribute's type; what cannot be is null."""
        kinds = {a.name: a for a in self.schema.stored() if a.ns == self.ns}
        columns = []
        for f in self.frame.schema.fields:
            a = kinds.get(f.name)
            columns.append(F.col(f.name) if a is None or a.many else coerce_column(F.col(f.name), f.dataType.simpleString(), a.type).cast(SPARK_TYPES[a.type]).alias(f.name))
        return self._new(self.frame.select(*columns))

    def validate(self, rules: dict[str, Callable[[Column], Column]]) -> Rows:
        """Rows that fail a test raise when they are read; a test that gives null passes."""
        out = self.frame
        for n, rule in rules.items():
            fails = ~F.coalesce(rule(F.col(n)), F.lit(True))
            out = out.withColumn(n, F.when(fails, F.raise_error(F.lit(f"not-validated: {self.ns}/{n}")).cast(out.schema[n].dataType)).otherwise(F.col(n)))
        return self._new(out)
