"""Every type on the log, identities, components, predicates of retractions, results of changes."""

from datetime import datetime
from decimal import Decimal

import pytest

from quern.operators.store import Store
from quern.terms import DocumentError

THING = {
    "thing": {
        "key": [{"unique": "identity", "required": True}], "flag": [{"type": "boolean"}], "n": [{"type": "long"}], "big": [{"type": "bigint"}], "f": [{"type": "float"}],
        "d": [{"type": "double"}], "dec": [{"type": "bigdec"}], "at": [{"type": "instant"}], "kw": [{"type": "keyword", "keyword": {"ns": "k"}}], "id": [{"type": "uuid"}],
        "raw": [{"type": "bytes"}], "tags": [{"cardinality": "many"}], "numbers": [{"type": "long", "cardinality": "many"}],
        "parts": [{"type": "ref", "cardinality": "many", "isComponent": True, "ref": {"ns": "part"}}], "friend": [{"type": "ref", "ref": {"ns": "thing", "norev": True}}],
    },
    "part": {"name": [{"required": True}]},
}
VALUES = {"key": "a", "flag": False, "n": 3, "big": 10**30, "f": 0.5, "d": 1.25, "dec": Decimal("2.5"), "at": datetime(2020, 1, 2, 3, 4, 5), "kw": "x",
          "id": "00000000-0000-0000-0000-0000000000ff", "raw": bytearray(b"\x00\x01"), "tags": ["p", "q"], "numbers": [1, 2, 3]}


def test_types(spark, tmp_path):
    ds = Store.open(spark, str(tmp_path), THING)
    commit = ds.insert({"thing": VALUES | {"kw": "k/x", "raw": b"\x00\x01", "parts": [{"name": "one"}, {"name": "two"}], "friend": {"key": "b"}}})
    thing = ds.documents({"thing/key": "a"}, pull={"thing": {}}, first=True)["thing"]
    assert thing == VALUES
    assert commit.documents()[0]["db"]["id"] == ds.ids({"thing/key": "a"})[0]
    ds.insert({"thing": {"key": "a", "n": 4}})  # the identity names the entity
    assert ds.documents({"thing/n": 4}, pull={"thing": {"n": "checked"}}, blank=True) == [{"thing": {"n": 4}}] and len(ds.ids("thing")) == 2
    assert ds.documents({"thing/flag": False}, pull={"thing": {"key": "checked"}}, blank=True) == [{"thing": {"key": "a"}}]
    ds.retract({"thing/key": "a"}, [("thing/numbers", (">", 1)), ("thing/tags", "q"), ("thing/flag", False), "thing/kw"])
    thing = ds.documents({"thing/key": "a"}, first=True, pull={"thing": {}})["thing"]
    assert thing["numbers"] == [1] and thing["tags"] == ["p"] and "flag" not in thing and "kw" not in thing
    ds.retract_in({"thing/key": "a"}, ["thing/friend", {"key": "b"}], ["key"])
    assert len(ds.ids("thing")) == 1  # nothing is left of the friend
    assert ds.select("part").count() == 2
    gone = ds.delete({"thing/key": "a"})
    assert ds.select("part").count() == 0 and {d.get("thing", {}).get("key") for d in gone.documents()} == {"a", None}
    for path, tag in (("thing/nothing", "walk-path-key-not-in-schema"), ("thing/key/more", "walk-path-cannot-walk-past-non-ref"), (5, "invalid-retraction-entry")):
        ds.insert({"thing": {"key": "c"}})
        with pytest.raises(DocumentError) as e:
            ds.retract({"thing/key": "c"}, [path])
        assert tag in e.value.tags


def test_two_writers(spark, tmp_path):
    one, two = (Store.open(spark, str(tmp_path), THING) for _ in range(2))
    version, manifest = one.log.manifest()
    two.insert({"thing": {"key": "x"}})
    facts = two.source.facts.drop("tx")
    with pytest.raises(DocumentError) as e:
        one.log.commit(version, manifest, facts, 0)
    assert "conflict" in e.value.tags
    assert one.ids("thing") == two.ids("thing")
