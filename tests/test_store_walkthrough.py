"""The stores of the walkthrough: accounts, accounts with books, a bookstore network.

Fixed values: schemas, documents and results are those that a user of the document language knows.
"""

from datetime import datetime

import pytest

from quern.operators.store import Store
from quern.terms import DocumentError, TempId

ACCOUNT = {
    "account": {
        "user": [{"required": True, "unique": "value"}],
        "password": [{"required": True, "restrict": ("a digit is needed", lambda s: any(c.isdigit() for c in s))}],
        "credits": [{"type": "long", "default": 0}],
    }
}
TYPED = {"account": ACCOUNT["account"] | {"type": [{"type": "enum", "default": "free", "enum": {"ns": "account.type", "values": {"admin", "free", "paid"}}}]}}
BOOKS = {
    "account": TYPED["account"] | {"books": [{"type": "ref", "cardinality": "many", "ref": {"ns": "book"}}]},
    "book": {"name": [{"required": True, "fulltext": True}], "author": [{"fulltext": True}]},
}
NETWORK = {
    "book": {"name": [{"required": True, "fulltext": True}], "author": [{"fulltext": True}]},
    "inventory": {
        "count": [{"type": "long", "required": True}],
        "cover": [{"type": "enum", "enum": {"ns": "cover.type", "values": {"hard", "soft"}}}],
        "book": [{"type": "ref", "ref": {"ns": "book"}}],
        "store": [{"type": "ref", "ref": {"ns": "store"}}],
    },
    "store": {"name": [{"required": True, "fulltext": True}], "address": [{"type": "ref", "ref": {"ns": "address"}}]},
    "address": {"country": [{"required": True}]},
}


def test_accounts(spark, tmp_path, same):
    ds = Store.open(spark, str(tmp_path), ACCOUNT)
    ds.insert({"account": {"user": "angela", "password": "hello1"}})
    ds.insert([{"account": {"user": "billy", "password": "pass1"}}, {"account": {"user": "carl", "password": "pass1"}}])
    same(ds.documents({"account": {"password": "pass1"}}), [{"account": {"user": "billy", "password": "pass1", "credits": 0}}, {"account": {"user": "carl", "password": "pass1", "credits": 0}}])
    one = ds.documents({"account": {"user": "angela"}}, first=True, ids=True)
    assert one["account"]["user"] == "angela" and isinstance(one["db"]["id"], int)
    with pytest.raises(DocumentError) as e:
        ds.insert({"account": {"credits": 10}})
    assert e.value.data["keys"] == ["account/password", "account/user"]
    with pytest.raises(DocumentError) as e:
        ds.insert({"account": {"user": "x", "password": "hello"}})
    assert "failed-restriction" in e.value.tags
    with pytest.raises(DocumentError) as e:
        ds.insert({"account": {"user": "x", "password": "hello1", "type": "vip"}})
    assert "no-schema" in e.value.tags and e.value.data["nsv"] == ["account", "type"]
    with pytest.raises(DocumentError) as e:
        ds.insert({"account": {"user": "billy", "password": "pass2"}})
    assert "unique" in e.value.tags
    assert ds.transactions("account/user") == [1001, 1002]
    assert ds.transactions("account/user", "angela") == [1001]
    assert isinstance(ds.transaction_time(1001), datetime)
    same(ds.documents("account", at=1001), [{"account": {"user": "angela", "password": "hello1", "credits": 0}}])
    assert len(ds.documents("account", at=1002)) == 3
    assert len(ds.documents("account", at=ds.transaction_time(1001))) == 1
    assert ds.schema_properties().count() == 3
    assert Store.open(spark, str(tmp_path), ACCOUNT).select("account").count() == 3  # reopened
    assert Store.open(spark, str(tmp_path), ACCOUNT, reset=True).select("account").count() == 0


def test_types_and_expressions(spark, tmp_path, same):
    ds = Store.open(spark, str(tmp_path), TYPED)
    ds.insert({"account": {"user": "user1", "password": "hello1"}, "account/type": "paid"})
    ds.insert([{"account": {"password": "hello2", "type": "account.type/admin"}, "account/user": "user2"}, {"account": {"user": "user3", "credits": 1000}, "account/password": "hello3"}])
    two = {"account": {"user": "user2", "password": "hello2", "credits": 0, "type": "admin"}}
    same(ds.documents({"account/type": "admin"}), [two])
    ds.update({"account/user": "user1"}, {"account/type": "admin"})
    same(ds.documents({"account/type": "admin"}), [two, {"account": {"user": "user1", "password": "hello1", "credits": 0, "type": "admin"}}])
    with pytest.raises(DocumentError):
        ds.insert({"account": {"user": "user4", "password": "hello4", "type": "vip"}})
    three = {"account": {"user": "user3", "password": "hello3", "credits": 1000, "type": "free"}}
    for query in (1000, (">", 10), (">", "?", 10), ("<", 10, "?"), [["(> ? 10)"]]):
        same(ds.documents({"account/credits": query}, first=True), three)
    same(ds.documents({"account/type": "free"}, first=True, pull={"account": {"credits": "unchecked", "type": "unchecked"}}), {"account": {"user": "user3", "password": "hello3"}})
    for query in ((".contains", "2"), (".contains", "?", "2"), (".contains", "user222", "?")):
        same(ds.documents({"account/user": query}, first=True), two)


def test_books(spark, tmp_path, same):
    ds = Store.open(spark, str(tmp_path), BOOKS)
    three = [{"name": "The Count of Monte Cristo", "author": "Alexander Dumas"}, {"name": "Tom Sawyer", "author": "Mark Twain"}, {"name": "Les Miserables", "author": "Victor Hugo"}]
    ds.insert({"account": {"user": "user1", "password": "hello1"}})
    ds.insert({"account": {"user": "user2", "password": "hello2", "books": three}})
    one = {"credits": 0, "type": "free", "password": "hello1", "user": "user1"}
    two = {"credits": 0, "type": "free", "password": "hello2", "user": "user2"}
    same(ds.documents("account"), [{"account": one}, {"account": two}])
    same(ds.documents("account", pull={"account": {"books": "checked"}}), [{"account": one}, {"account": two | {"books": three}}])
    pulled = {d["account"]["user"]: d["account"] for d in ds.documents("account", pull={"account": {"books": "id"}})}
    assert "books" not in pulled["user1"] and sorted(pulled["user2"]["books"]) == ds.ids("book")
    narrow = {"account": {"books": {"author": "unchecked"}, "credits": "unchecked", "type": "unchecked"}}
    names = [{"name": b["name"]} for b in three]
    short = {"account": {"user": "user2", "password": "hello2", "books": names}}
    same(ds.documents("account", access=narrow), [{"account": {"user": "user1", "password": "hello1"}}, short])
    same(ds.documents({"account": {"books/author": "Victor Hugo"}}, first=True, pull=narrow), short)
    with pytest.raises(DocumentError) as e:
        ds.select({"account": {"books/author": "Victor Hugo"}}, first=True, access=narrow)
    assert "not-allowed" in e.value.tags and e.value.data["key_path"] == ["account", "books", "author"] and e.value.data["nsv"] == ["book", "author"]
    same(ds.documents({"account": {"books/author": "Victor Hugo"}}, first=True, access={"account": {"books": "checked"}}, pull=narrow), short)
    ds.insert([{"book": {"name": "The Book and the Sword", "author": "Louis Cha", "accounts": ds.ids("account")}}])
    same(ds.documents({"book": {"accounts/user": "user1"}}), [{"book": {"name": "The Book and the Sword", "author": "Louis Cha"}}])
    ds.insert({"book": {"name": "Charlie and the Chocolate Factory", "author": "Roald Dahl", "accounts": [{"user": "user3", "password": "hello3", "credits": 100}, {"user": "user4", "password": "hello4", "credits": 500}]}})
    same(ds.documents({"account": {"books/author": "Roald Dahl"}}, pull={"account": {"password": "unchecked", "credits": "unchecked", "type": "unchecked"}}), [{"account": {"user": "user3"}}, {"account": {"user": "user4"}}])
    same(ds.documents({"book/author": ("?fulltext", "Louis")}, pull={"book": {"accounts": "checked"}}, first=True), {"book": {"author": "Louis Cha", "name": "The Book and the Sword", "accounts": [one, two]}})
    with pytest.raises(DocumentError) as e:
        ds.delete_all({"book/author": "Roald Dahl"})
    assert "missing-allow-model" in e.value.tags
    ds.delete_all({"book/author": "Roald Dahl"}, access={"book": {"accounts": "checked"}})
    same(ds.documents("account"), [{"account": one}, {"account": two}])


def test_network(spark, tmp_path, same):
    ds = Store.open(spark, str(tmp_path), NETWORK)
    ds.insert([{"address": {"country": "USA", "stores": [{"name": "Canyon Books"}, {"name": "Capital Books"}]}}, {"db/id": [["AUS"]], "address": {"country": "Australia"}}, {"store": {"address": TempId("AUS"), "name": "Koala Books"}}])
    same(ds.documents({"store": {"address/country": "Australia"}}), [{"store": {"name": "Koala Books"}}])
    same(ds.documents({"store": {"address/country": "USA"}}), [{"store": {"name": "Canyon Books"}}, {"store": {"name": "Capital Books"}}])
    ds.update({"store": {"address/country": "Australia"}}, {"store/inventories": [
        {"count": 10, "cover": "hard", "book": {"name": "The Count of Monte Cristo", "author": "Alexander Dumas"}},
        {"count": 5, "cover": "hard", "book": {"name": "Tom Sawyer", "author": "Mark Twain"}}, {"count": 3, "cover": "soft", "book": {"name": "Les Miserables", "author": "Victor Hugo"}}]})
    same(ds.documents({"inventory": {"book/name": ("?fulltext", "Les")}}, first=True), {"inventory": {"count": 3, "cover": "soft"}})
    ds.update_in({"store/name": "Koala Books"}, ["store/inventories", {"book/name": "Tom Sawyer"}], {"count": 4})
    tom = {"inventory": {"book/name": "Tom Sawyer", "store/name": "Koala Books"}}
    same(ds.documents(tom, first=True), {"inventory": {"count": 4, "cover": "hard"}})
    koala = {"name": "Koala Books"}
    same(ds.documents("book", access={"book": {"inventories": {"store": "checked"}}}), [
        {"book": {"author": "Mark Twain", "name": "Tom Sawyer", "inventories": [{"store": koala, "count": 4, "cover": "hard"}]}},
        {"book": {"author": "Victor Hugo", "name": "Les Miserables", "inventories": [{"store": koala, "count": 3, "cover": "soft"}]}},
        {"book": {"author": "Alexander Dumas", "name": "The Count of Monte Cristo", "inventories": [{"store": koala, "count": 10, "cover": "hard"}]}}])
    ds.retract(tom, ["inventory/cover"])
    same(ds.documents(tom, first=True), {"inventory": {"count": 4}})
    ds.update_in({"book/name": "Tom Sawyer"}, ["book/inventories", {"store/name": "Koala Books"}], {"cover": "soft"})
    ds.update(tom, {"inventory/cover": "hard"})
    ds.update_in({"store/name": "Koala Books"}, ["store/inventories", {"book/name": "Tom Sawyer"}], {"count": 3})
    same(ds.documents({"inventory": {"book/name": "Tom Sawyer"}}, first=True), {"inventory": {"count": 3, "cover": "hard"}})
    stock = ds.documents({"inventory": {"store/name": "Koala Books"}}, pull={"inventory": {"book": "id"}})
    ds.update({"store/name": "Capital Books"}, {"store/inventories": [d["inventory"] for d in stock]})
    pull = {"book": {"inventories": {"store": "checked"}}}
    both = [{"cover": "hard", "count": 3, "store": koala}, {"cover": "hard", "count": 3, "store": {"name": "Capital Books"}}]
    same(ds.documents({"book/name": "Tom Sawyer"}, pull=pull, first=True), {"book": {"author": "Mark Twain", "name": "Tom Sawyer", "inventories": both}})
    done = ds.delete({"inventory": {"store/name": "Koala Books", "book/name": ("?fulltext", "Count")}})
    assert done.before.select("inventory").count() > 0 and done.changed.count() == 1
    same(ds.documents({"book/name": ("?fulltext", "Count")}, pull=pull, first=True)["book"]["inventories"], [{"cover": "hard", "count": 10, "store": {"name": "Capital Books"}}])
    ds.delete_in({"store/name": "Capital Books"}, ["store/inventories", {"book/name": "Tom Sawyer"}])
    same(ds.documents({"book/name": "Tom Sawyer"}, pull=pull, first=True)["book"]["inventories"], both[:1])
    left = ds.ids({"inventory": {"store/name": "Capital Books"}})
    before = ds.tx
    with ds.sync() as tx:
        tx.update({"store/name": "Canyon Books"}, {"store/inventories": left})
        tx.delete({"store/name": "Capital Books"})
    assert ds.tx == before + 1
    same(ds.documents("store", pull={"store": {"inventories": {"cover": "unchecked", "book": {"author": "unchecked"}}}}), [
        {"store": koala | {"inventories": [{"book": {"name": "Les Miserables"}, "count": 3}, {"book": {"name": "Tom Sawyer"}, "count": 3}]}},
        {"store": {"name": "Canyon Books", "inventories": [{"book": {"name": "The Count of Monte Cristo"}, "count": 10}, {"book": {"name": "Les Miserables"}, "count": 3}]}}])
