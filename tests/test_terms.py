"""Terms, coercions, and the frames of whole-table stages."""

from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.coerce import coerce
from quern.operators.changes import Rows
from quern.plans.normalise import merge, nested
from quern.plans.schema import Schema, plural
from quern.terms import ANY, HOLE, DocumentError, Expr, TempId, Var, expression, text_term


def test_text_terms():
    assert text_term([["(> ? 10)"]]) == Expr(">", (HOLE, 10)) == expression((">", 10))
    assert text_term([['(.contains "a b")']]) == Expr(".contains", (HOLE, "a b"))
    assert text_term([["(< ?x)"]]) == Expr("<", (HOLE, Var("x")))
    assert text_term([["_"]]) == ANY and text_term([["?x"]]) == Var("x") and text_term([[":AUS"]]) == TempId("AUS")
    with pytest.raises(DocumentError):
        text_term([[""]])


@pytest.mark.parametrize("value,kind,expected", [
    (1, "string", "1"), ("7", "long", 7), (7.9, "long", 7), (datetime(1970, 1, 2), "long", 86_400_000), ("1.5", "double", 1.5), (1, "double", 1.0),
    ("1.25", "bigdec", Decimal("1.25")), ("2001-02-03T04:05:06.000Z", "instant", datetime(2001, 2, 3, 4, 5, 6)), (1000, "instant", datetime(1970, 1, 1, 0, 0, 1)),
    (":a", "keyword", "a"), (5, "keyword", "5"), ("5", "ref", 5)])
def test_coerce(value, kind, expected):
    assert coerce(value, kind) == expected


@pytest.mark.parametrize("value,kind", [("x", "long"), (1, "boolean"), ("a", "bytes"), (True, "string"), ("nope", "uuid"), (10**39, "bigint") if False else ("1e", "bigint")])
def test_no_coercion(value, kind):
    with pytest.raises(DocumentError) as e:
        coerce(value, kind)
    assert "coerce" in e.value.tags


def test_own_chart():
    assert coerce(True, "string", {"string": {"boolean": lambda v: "yes"}}) == "yes"


@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(), max_size=4))
def test_paths_are_nesting(flat):
    """A document of path keys is the same as the nested one."""
    doc = {f"ns/{k}": v for k, v in flat.items()}
    assert nested(doc) == ({"ns": flat} if flat else {})
    assert merge(nested(doc), {}) == nested(doc)


def test_plural():
    assert [plural(w) for w in ("inventory", "address", "person", "book", "day", "box", "match")] == ["inventories", "addresses", "people", "books", "days", "boxes", "matches"]


def test_rows(spark):
    schema = Schema({"a": {"x": [{"type": "long", "default": 3, "required": True}], "y": [{}]}})
    frame = spark.createDataFrame([("1", "p", 0), (None, None, 0)], "x string, y string, z int")
    rows = Rows(schema, "a", frame).ignore().coerced().defaults()
    assert sorted(map(tuple, rows.frame.collect()), key=str) == [(1, "p"), (3, None)]
    with pytest.raises(Exception, match="no-required"):
        rows.require(["y"]).frame.collect()
    with pytest.raises(Exception, match="not-validated"):
        rows.validate({"x": lambda c: c < 2}).frame.collect()
    with pytest.raises(DocumentError):
        rows.allow(["x"])
    assert rows.mask({"y": lambda c: F.length(c) > 0}).frame.where("y is not null").count() == 0
    assert rows.transform({"y": F.upper}).frame.where("y = 'P'").count() == 1
