"""Coercions of plain values to attribute types, and the same as columns for whole tables."""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable
from datetime import UTC, date, datetime
from decimal import Decimal
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.schema import SPARK_TYPES
from quern.terms import DocumentError

_EPOCH = datetime(1970, 1, 1)


def _instant(text: str) -> datetime:
    out = datetime.fromisoformat(text)
    return out.astimezone(UTC).replace(tzinfo=None) if out.tzinfo else out


def _millis(value: datetime) -> int:
    delta = value - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1000 + delta.microseconds // 1000


def _uri(text: str) -> str:
    urlparse(text)
    return text


def _flag(value: Any) -> bool:
    raise TypeError


#: target -> kind of source -> function. Kinds: string, number, instant, boolean, bytes.
CHART: dict[str, dict[str, Callable[[Any], Any]]] = {
    "string": {"number": str, "instant": lambda v: v.isoformat(timespec="milliseconds") + "Z"},
    "keyword": {"string": lambda v: v.removeprefix(":"), "number": str},
    "long": {"string": int, "number": int, "instant": _millis},
    "bigint": {"string": int, "number": int},
    "bigdec": {"string": Decimal, "number": lambda v: Decimal(str(v))},
    "float": {"string": float, "number": float},
    "double": {"string": float, "number": float},
    "instant": {"string": _instant, "number": lambda v: _EPOCH + __import__("datetime").timedelta(milliseconds=int(v))},
    "uuid": {"string": lambda v: str(_uuid.UUID(v))},
    "uri": {"string": _uri},
    "enum": {"string": lambda v: v.removeprefix(":"), "number": int},
    "ref": {"string": int, "number": int},
}


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, (datetime, date)):
        return "instant"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    return "string" if isinstance(value, str) else type(value).__name__


def has_type(value: Any, kind: str) -> bool:
    """Whether a value can be stored as this type as it is."""
    number = isinstance(value, int) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "boolean": isinstance(value, bool), "long": number and -(1 << 63) <= value < 1 << 63,
        "bigint": number, "float": isinstance(value, float), "double": isinstance(value, float), "bigdec": isinstance(value, Decimal),
        "instant": isinstance(value, datetime), "keyword": isinstance(value, str), "uuid": isinstance(value, _uuid.UUID), "uri": False,
        "bytes": isinstance(value, (bytes, bytearray)), "enum": isinstance(value, str) or number, "ref": number,
    }[kind]


def coerce(value: Any, kind: str, chart: dict | None = None) -> Any:
    """``value`` as the given type. Raises a DocumentError tagged ``coerce`` if there is no way.

    ``chart`` adds to or overrides the default functions for one call."""
    if kind in ("keyword", "enum") and isinstance(value, str):
        return value.removeprefix(":")
    if has_type(value, kind):
        return str(value) if kind == "uuid" else value
    function = ((chart or {}).get(kind, {})).get(kind_of(value)) or CHART.get(kind, {}).get(kind_of(value))
    if function is None:
        raise DocumentError("coerce", f"{value!r} to {kind}", value=value, type=kind)
    try:
        out = function(value)
    except (ValueError, TypeError, ArithmeticError) as error:
        raise DocumentError("coerce", f"{value!r} to {kind}", value=value, type=kind) from error
    if kind == "bigint" and abs(out) >= 10**38:
        raise DocumentError("coerce", f"{value!r} has more than 38 digits", value=value, type=kind)
    return out


def coerce_column(column: Column, source: str, kind: str) -> Column:
    """The same for a column of a Spark type; what cannot be coerced is null."""
    if kind == "long" and source.startswith("timestamp"):
        return F.unix_millis(column.cast("timestamp"))
    if kind == "instant" and source in ("bigint", "int"):
        return F.timestamp_millis(column)
    if kind == "keyword" and source == "string":
        return F.regexp_replace(column, "^:", "")
    if kind == "string" and source.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind in ("uuid",):
        return F.when(column.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(column))
    if kind in ("boolean", "bytes") and source not in ("boolean", "binary"):
        raise DocumentError("coerce", f"{source} to {kind}", type=kind)
    return column.try_cast(SPARK_TYPES[kind])
