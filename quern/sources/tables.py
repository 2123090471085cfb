"""Existing tables as namespaces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.schema import Attribute, Schema


@dataclass
class Table:
    """A DataFrame for a namespace, or a function that reads it when it is first needed: its id column
    (or an expression, or a function of the frame that gives one) and each attribute's column. An
    attribute of many values is an array column."""

    given: DataFrame | Callable[[], DataFrame]
    key: str | Column | Callable[[DataFrame], Column]
    columns: dict[str, str | Column] = field(default_factory=dict)

    @property
    def frame(self) -> DataFrame:
        if not isinstance(self.given, DataFrame):
            self.given = self.given()
        return self.given

    @property
    def eid(self) -> str | Column:
        return self.key if isinstance(self.key, (str, Column)) else self.key(self.frame)

    def column(self, name: str | Column) -> Column:
        return F.col(name) if isinstance(name, str) else name


class Tables:
    """Namespaces bound to tables. Ids are those of the namespace's own table."""

    def __init__(self, schema: Schema, tables: dict[str, Table]):
        self.schema, self.tables = schema, tables

    def wide(self, ns: str, attributes: list[Attribute], implied: bool = False) -> DataFrame:
        table = self.tables[ns]
        return table.frame.select(table.column(table.eid).alias("eid"), *(table.column(table.columns[a.name]).alias(a.ident) for a in attributes))

    def pairs(self, attribute: Attribute) -> DataFrame:
        table = self.tables[attribute.ns]
        value = table.column(table.columns[attribute.name])
        value = F.explode(value) if attribute.many else value
        return table.frame.select(table.column(table.eid).alias("e"), value.alias("v")).where("v is not null")

    def replaced(self, ns: str, frame: DataFrame) -> Tables:
        """The same with another frame for a namespace."""
        old = self.tables[ns]
        return Tables(self.schema, self.tables | {ns: Table(frame, old.eid, old.columns)})
