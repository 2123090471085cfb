"""Writers that get in each other's way, bulk inserts, compaction, and what a schema must not do."""

import pytest
from pyspark.sql import functions as F

from quern.operators.store import Store
from quern.plans.schema import Schema
from quern.terms import DocumentError, TempId

SCHEMA = {
    "account": {
        "user": [{"required": True, "unique": "value"}], "credits": [{"type": "long", "default": 0}], "code": [{"default": lambda: "made"}],
        "kind": [{"type": "enum", "enum": {"ns": "kind", "values": {"free", "paid"}}}], "password": [{"restrict": ("a digit is needed", lambda s: any(c.isdigit() for c in s))}],
        "books": [{"type": "ref", "cardinality": "many", "ref": {"ns": "book"}}],
    },
    "book": {"isbn": [{"unique": "identity", "required": True}], "name": [{}]},
    "node": {"name": [{"required": True}], "next": [{"type": "ref", "ref": {"ns": "node"}}]},
}


@pytest.fixture()
def ds(spark, tmp_path):
    return Store.open(spark, str(tmp_path), SCHEMA)


def users(ds):
    return {d["account"]["user"]: {b["name"] for b in d["account"].get("books", [])} for d in ds.documents("account", pull={"account": {"books": {"name": "checked"}}})}


def test_interleaved_writers(spark, ds):
    """Two writers hold the same first free id; the later one's ids, references among them, move on."""
    other = Store.open(spark, ds.log.path, SCHEMA)
    with ds.sync() as one, other.sync() as two:
        one.insert({"account": {"user": "ann", "books": [{"isbn": "1", "name": "Emma"}]}})
        two.insert({"account": {"user": "bob", "books": [{"isbn": "2", "name": "Ulysses"}, {"isbn": "3", "name": "Dubliners"}]}})
    assert users(ds) == {"ann": {"Emma"}, "bob": {"Ulysses", "Dubliners"}}
    assert len(ds.ids("account")) == 2 and len(ds.ids("book")) == 3


def test_interleaved_unique_value(spark, ds):
    other = Store.open(spark, ds.log.path, SCHEMA)
    with pytest.raises(DocumentError) as e, ds.sync() as one:
        one.insert({"account": {"user": "ann"}})
        other.insert({"account": {"user": "ann"}})
    assert "unique" in e.value.tags and len(ds.ids("account")) == 1


def test_async_commits(spark, ds):
    waiting = [ds.insert({"account": {"user": f"u{k}", "books": [{"isbn": str(k), "name": f"b{k}"}]}}, transact="async") for k in range(3)]
    done = [w.result() for w in waiting]
    assert sorted(c.tx for c in done) == [1001, 1002, 1003]
    assert users(ds) == {f"u{k}": {f"b{k}"} for k in range(3)}
    assert [d["account"]["user"] for c in done for d in c.documents() if "account" in d] == ["u0", "u1", "u2"]


def test_insert_frame_rules(spark, ds):
    rows = lambda *r: spark.createDataFrame(list(r), "user string, kind string, password string")
    for row, tag in ((("a", "vip", "p1"), "wrong-input"), ((None, "free", "p1"), "required"), (("a", "free", "none"), "failed-restriction")):
        with pytest.raises(DocumentError) as e:
            ds.insert_frame("account", rows(row))
        assert tag in e.value.tags
    with pytest.raises(DocumentError) as e:
        ds.insert_frame("account", rows(("a", "free", None), ("a", "free", None)))
    assert "unique" in e.value.tags
    with pytest.raises(DocumentError) as e:
        ds.insert_frame("account", spark.createDataFrame([("a", "many")], "user string, credits string"))
    assert "wrong-type" in e.value.tags
    assert not ds.ids("account")
    ds.insert_frame("account", rows(("a", ":kind/free", "p1"), ("b", None, None)))
    found = {d["account"]["user"]: d["account"] for d in ds.documents("account")}
    assert found == {"a": {"user": "a", "credits": 0, "code": "made", "kind": "free", "password": "p1"}, "b": {"user": "b", "credits": 0, "code": "made"}}
    ds.insert_frame("book", spark.createDataFrame([("1", "Emma")], "isbn string, name string"))
    ds.insert_frame("book", spark.createDataFrame([("1", "Emma, again"), ("2", "Persuasion")], "isbn string, name string"))
    assert {(d["book"]["isbn"], d["book"]["name"]) for d in ds.documents("book")} == {("1", "Emma, again"), ("2", "Persuasion")} and len(ds.ids("book")) == 2


def test_compaction(spark, ds):
    ds.insert([{"account": {"user": "ann"}}, {"account": {"user": "bob"}}])
    ds.update({"account/user": "ann"}, {"account": {"credits": ("inc", 5)}})
    before = {tx: ds.transaction_time(tx) for tx in (1001, 1002)}
    ds.compact()
    ds.update({"account/user": "ann"}, {"account": {"credits": ("dec", 2)}})
    ds.delete({"account/user": "bob"})
    credits = lambda **keys: {d["account"]["user"]: d["account"]["credits"] for d in ds.documents("account", **keys)}
    assert [credits(at=tx) for tx in (1001, 1002, 1003, 1004)] == [{"ann": 0, "bob": 0}, {"ann": 5, "bob": 0}, {"ann": 3, "bob": 0}, {"ann": 3}]
    assert {tx: ds.transaction_time(tx) for tx in (1001, 1002)} == before and credits(at=before[1002]) == {"ann": 5, "bob": 0}
    assert ds.transactions("account/credits") == [1001, 1002, 1003, 1004] and ds.history().where("a = 'account/credits'").count() == 5
    assert ds.source.facts.where(F.col("tx") < 1002).where("a = 'account/credits' and l = 0").count() == 1  # bob's; ann's old value is not read
    ds.compact()
    assert credits() == {"ann": 3} and credits(at=1002) == {"ann": 5, "bob": 0}


def test_yield_beyond(spark, ds):
    """What lies beyond the depth is shown by its id; the depth is a key of the call."""
    ds.insert([{"node": {"name": f"n{k}", "next": TempId(k + 1)}, "db/id": TempId(k)} for k in range(4)] + [{"node": {"name": "n4"}, "db/id": TempId(4)}])
    last = ds.ids({"node/name": "n2"})[0]
    found = ds.documents({"node/name": "n0"}, pull={"node": {"next": "yield"}}, yield_depth=1, first=True)
    assert found == {"node": {"name": "n0", "next": {"name": "n1", "next": {"+": {"db": {"id": last}}}}}}
    deep = ds.documents({"node/name": "n0"}, pull={"node": {"next": "yield"}}, yield_depth=9, first=True)
    names = []
    at = deep["node"]
    while at:
        names.append(at["name"])
        at = at.get("next")
    assert names == [f"n{k}" for k in range(5)]


def test_records_and_options(spark, ds):
    made = ds.insert({"account": {"user": "ann", "books": [{"isbn": "1"}]}}, record=True)
    assert made.op == "insert" and made.result.count() == 5 and not ds.ids("account")
    ids = iter((7_000_001, 7_000_002))
    commit = ds.insert({"account": {"user": "ann", "books": [{"isbn": "1"}]}}, generate_ids=lambda: next(ids))
    assert {r["eid"] for r in ds.select(["account", "book"], returns="ids").collect()} == {7_000_001, 7_000_002} and commit.tx == 1001
    with pytest.raises(DocumentError):
        ds.insert({"account": {"user": "bob"}}, generate_ids=False)
    asked = ds.select({"account/books": {"isbn": "1"}}, record=True)
    assert asked.result.count() == 1 and asked.patterns == ds.select({"account/books": {"isbn": "1"}}, raw=True) and asked.entities[0].values
    names = iter("abc")
    assert ds.select({"account/books": {"isbn": "1"}}, raw=True, generate_syms=lambda: next(names)) == [["find", "?self", "where", ["?self", "account/books", "?a"], ["?a", "book/isbn", "1"]]]


def test_reverse_name_taken():
    ref = lambda **r: [{"type": "ref", "ref": {"ns": "book"} | r}]
    for account in ({"books": ref(rval="name")}, {"books": ref(rval="x"), "more": ref(rval="x")}):
        with pytest.raises(DocumentError) as e:
            Schema({"account": account, "book": {"name": [{}]}})
        assert "wrong-schema" in e.value.tags


def test_unreachable_folder(spark, monkeypatch):
    """On a cluster there must be a shared folder; a temporary one of the driver will not do."""
    from types import SimpleNamespace

    from quern.sources import log

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(DocumentError) as e:
            log.own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
        assert "no-checkpoint-dir" in e.value.tags
    assert log.own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="local[8]")))
