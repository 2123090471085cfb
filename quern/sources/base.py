"""What the compiler reads: namespaces as wide tables, many-valued attributes and references as
tables of pairs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from quern.plans.schema import Attribute, Schema


class Source(Protocol):
    schema: Schema

    def wide(self, ns: str, attributes: list[Attribute], implied: bool = False) -> DataFrame:
        """``eid`` and a column by ident for each single-valued attribute, a row for every entity of
        the namespace. With ``implied``, entities that have none of the attributes may be missing."""

    def pairs(self, attribute: Attribute) -> DataFrame:
        """(e, v) for every value of a stored attribute."""
