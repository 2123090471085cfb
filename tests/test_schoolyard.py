"""A graph of classes, teachers and students: multi-hop queries, raw patterns, options, stages.

Fixed values: schema, data and results are those that a user of the document language knows.
"""

import pytest

from quern.operators.query import View
from quern.operators.store import Store
from quern.plans.schema import Schema
from quern.terms import ANY, DocumentError, TempId, Var

SCHOOL = {
    "class": {"type": [{"type": "keyword"}], "name": [{"required": True}], "accelerated": [{"type": "boolean"}], "teacher": [{"type": "ref", "ref": {"ns": "teacher", "rval": "teaches"}}]},
    "teacher": {"name": [{"fulltext": True, "required": True}], "canTeach": [{"type": "keyword", "cardinality": "many"}], "pets": [{"type": "keyword", "cardinality": "many"}]},
    "student": {"name": [{"required": True}], "siblings": [{"type": "long"}], "classes": [{"type": "ref", "cardinality": "many", "ref": {"ns": "class"}}]},
}


def ref(*names):
    return [TempId(n) for n in names]


def student(name, siblings, *classes):
    return {"name": name, "siblings": siblings, "classes": ref(*classes)}


DATA = [
    {"db/id": TempId("MATHS"), "class": {"type": "maths", "name": "Maths", "accelerated": True}},
    {"db/id": TempId("SCIENCE"), "class": {"type": "science", "name": "Science", "accelerated": False}},
    {"db/id": TempId("ART"), "class": {"type": "art", "name": "Art", "accelerated": False}},
    {"teacher": {"name": "Mr. Blair", "teaches": ref("ART", "SCIENCE"), "canTeach": ["maths", "science"], "pets": ["fish", "bird"]}},
    {"teacher": {"name": "Mr. Carpenter", "canTeach": ["sports", "maths"], "pets": ["dog", "fish", "bird"], "teaches": [
        {"+": {"db/id": TempId("SPORTS")}, "type": "sports", "name": "Sports", "accelerated": False, "students": [{"name": "Jack", "siblings": 4, "classes": [
            {"+": {"db/id": TempId("ENGLISHB")}, "type": "english", "name": "English B", "accelerated": False, "students": [
                student("Anna", 1, "ART", "SPORTS"), student("Charlie", 3, "ART"), student("Francis", 0, "MATHS"), student("Harry", 2, "SCIENCE")]}]}]}]}},
    {"db/id": TempId("ENGLISHA"), "class": {"type": "english", "name": "English A", "accelerated": True,
        "teacher": {"name": "Mr. Anderson", "teaches": ref("MATHS", "ENGLISHB"), "canTeach": "maths", "pets": "dog"},
        "students": [student("Bobby", 2, "MATHS"), student("David", 5, "SCIENCE", "MATHS"), student("Erin", 1, "ART"), student("Kelly", 0, "SCIENCE", "MATHS")]}},
]


@pytest.fixture(scope="module")
def school(spark, tmp_path_factory):
    ds = Store.open(spark, str(tmp_path_factory.mktemp("school")), SCHOOL)
    ds.insert(DATA)
    # Reading from a table of the facts, as every read would from the files.
    return ds.snapshot()


def names(view, query, ns="student", **keys):
    return {d[ns]["name"] for d in view.documents(query, **keys)}


def test_queries(school, same):
    same(school.documents({"student/name": "Harry"}), [{"student": {"name": "Harry", "siblings": 2}}])
    maths = {"Bobby", "Francis", "David", "Kelly"}
    assert names(school, {"student": {"classes/type": "maths"}}) == maths
    found = school.query(["find", "?x", "in", "$", "?class", "where", ["?x", "student/classes", "?c"], ["?c", "class/type", "?class"]], ["maths"])
    assert {r["student"]["name"] for r in found.collect()} == maths
    blair = [{"student": {"name": "Charlie", "siblings": 3}}, {"student": {"name": "David", "siblings": 5}}]
    same(school.documents({"student": {"classes/teacher": {"name": ("?fulltext", "Blair")}, "siblings": (">", 2)}}), blair)
    raw = school.query(["find", "?s", "where", ["?s", "student/siblings", "?n"], [[">", "?n", 2]], ["?s", "student/classes", "?c"], ["?c", "class/teacher", "?t"],
                        [["fulltext", "$", "teacher/name", "Blair"], [["?t", "?v"]]]])
    assert {r["student"]["name"] for r in raw.collect()} == {"Charlie", "David"}
    assert names(school, {"class/teacher": {"name": "Mr. Anderson"}}, "class") == {"English A", "English B", "Maths"}
    assert names(school, {"teacher": {"teaches": {"students/name": "Harry"}, "pets": "bird"}}, "teacher") == {"Mr. Blair"}
    assert names(school, {"student/classes": {"teacher/name": "Mr. Blair"}}) == {"Charlie", "Anna", "David", "Harry", "Erin", "Kelly"}
    assert names(school, {"student/classes": {"teacher/pets": "fish"}}) == {"Charlie", "Jack", "Anna", "David", "Harry", "Erin", "Kelly"}
    assert names(school, {"class/teacher": {"teaches/students": {"classes/teacher": {"name": "Mr. Carpenter"}}}}, "class") == {"Science", "English B", "English A", "Art", "Sports", "Maths"}
    assert names(school, {"class/teacher/teaches/students/classes/teacher/name": "Mr. Carpenter"}, "class") == {"Science", "English B", "English A", "Art", "Sports", "Maths"}


def test_sets_and_variables(school):
    assert names(school, {"teacher": {"pets": ["dog", "fish"]}}, "teacher") == {"Mr. Carpenter"}  # both
    assert names(school, {"student": {"classes": [{"type": "science"}, {"type": "maths"}]}}) == {"David", "Kelly"}
    assert names(school, [{"student/name": "Anna"}, {"student/name": "Jack"}]) == {"Anna", "Jack"}  # either
    assert names(school, {"teacher": {"canTeach": ("?not", "maths")}}, "teacher") == {"Mr. Blair", "Mr. Carpenter"}  # some value differs
    # Teachers that have a class of a type that they can teach.
    assert names(school, {"teacher": {"canTeach": Var("x"), "teaches": {"type": Var("x")}}}, "teacher") == {"Mr. Blair", "Mr. Carpenter", "Mr. Anderson"}
    # Students with fewer siblings than a class mate of theirs called Harry.
    assert names(school, {"student": {"siblings": Var("n"), "classes/students": {"name": "Harry", "siblings": (">", Var("n"))}}}) == {"Anna", "Francis", "Kelly"}
    anna = school.ids({"student/name": "Anna"})[0]
    assert names(school, {"class/students": anna}, "class") == {"Art", "Sports", "English B"}
    assert names(school, anna) == {"Anna"}
    assert names(school, {"class": {"students": {"+": {"db/id": Var("s")}, "name": "David"}, "teacher/name": ANY}}, "class") == {"Science", "Maths", "English A"}
    assert school.documents({"student": {"name": "Nobody"}}) == []
    with pytest.raises(DocumentError):
        school.select({})


def test_bans(school):
    anna = school.ids({"student/name": "Anna"})[0]
    for query, flag, tag in ((anna, "ban_top_id", "top-id-banned"), (anna, "ban_ids", "id-banned"), ({"class/students": anna}, "ban_body_ids", "body-id-banned"),
                             ({"class/students": anna}, "ban_ids", "id-banned"), ("student", "ban_underscores", "keyword-banned"),
                             ({"student/name": (".startsWith", "?", "A")}, "ban_expressions", "not-allowed")):
        with pytest.raises(DocumentError) as e:
            school.select(query, **{flag: True})
        assert tag in e.value.tags
    assert names(school, anna, ban_body_ids=True) == {"Anna"}
    assert names(school, {"student/name": (".startsWith", "?", "A")}) == {"Anna"}
    with pytest.raises(DocumentError) as e:
        school.select("class/nothing")
    assert "no-schema" in e.value.tags


def test_shapes(school, same):
    assert school.documents({"student/name": "Anna"}, blank=True) == [{}]
    same(school.documents({"student/name": "Anna"}, blank=True, pull={"student": {"name": "checked"}}), [{"student": {"name": "Anna"}}])
    same(school.documents({"student/name": "Anna"}, blank=True, pull={"student": {"classes": {"teacher": {"name": "checked"}}}}),
         [{"student": {"classes": [{"teacher": {"name": n}} for n in ("Mr. Blair", "Mr. Carpenter", "Mr. Anderson")]}}])
    with pytest.raises(DocumentError) as e:
        school.select({"student/classes/teacher/name": "Mr. Blair"}, blank=True, access={"student": {"name": "checked"}})
    assert "not-allowed" in e.value.tags
    raw = school.select({"student": {"classes/type": "maths"}}, raw=True)
    assert raw == [["find", "?self", "where", ["?self", "student/classes", "?e0"], ["?e0", "class/type", "maths"]]]
    assert school.select("student", returns="ids").columns == ["eid"]
    assert school.linked({"student/name": "Charlie"}, {"student": {"classes": {"teacher": "checked"}}}).count() == 5
    assert school.documents({"class/name": "Art"}, pull={"class": {"teacher": {"pets": "checked", "canTeach": "unchecked"}}}, first=True)["class"]["teacher"] == {"name": "Mr. Blair", "pets": ["bird", "fish"]}


def capitalise(text):
    return text[:1].upper() + text[1:].lower()


def test_stages(school):
    charlie = {"student/name": "Charlie"}

    def replaced(doc, ctx=None):
        return doc | {"student": {"name": "Bobby" if ctx is None else ctx["params"]["name"]}}

    assert names(school, charlie, pipeline={"pre_process": lambda d: replaced(d)}) == {"Bobby"}
    assert names(school, charlie, pipeline={"pre_process": lambda d, c: replaced(d, c)}, params={"name": "Erin"}) == {"Erin"}
    assert names(school, charlie, pipeline={"pre_require": {"student": {"name": "checked"}}}) == {"Charlie"}
    for stage in ("pre_require", "post_require"):
        with pytest.raises(DocumentError) as e:
            school.select({"student/classes/type": "maths"}, pipeline={stage: {"student": {"name": "checked"}}})
        assert "no-required" in e.value.tags
    both = {"student": {"name": "Charlie", "classes": {"type": "maths"}}}
    maths = {"Bobby", "Francis", "David", "Kelly"}
    assert names(school, both) == set()
    assert names(school, both, pipeline={"pre_mask": {"student": {"name": "checked"}}}) == maths
    assert names(school, both, pipeline={"pre_mask": {"student": {"classes": lambda v: True}}}) == {"Charlie"}
    assert names(school, {"student": {"name": "Charlie", "classes": {"name": "ART"}}}, pipeline={"pre_transform": {"student": {"classes": {"name": capitalise}}}}) == {"Charlie"}
    science = {"David", "Harry", "Kelly"}
    for rule in ("Science", lambda above: "Science", lambda above, ctx: ctx["params"]):
        assert names(school, {}, pipeline={"fill_empty": {"student": {"classes": {"name": rule}}}}, params="Science") == science
    query = {"student": {"classes": {"name": "Science"}}}
    assert names(school, query, pipeline={"fill_assoc": {"student": {"classes": [{"name": "Maths"}]}}}) == {"David", "Kelly"}
    assert names(school, query, pipeline={"fill_assoc": {"student": {"classes": lambda above: {"name": "Maths"}}}}) == {"David", "Kelly"}
    assert names(school, query, pipeline={"fill_assoc": {"student": {"classes": {"name": "Maths"}}}}) == set()  # one class of two names
    rated = {"student": {"rating": 10, "classes": [{"name": "Science"}]}}
    with pytest.raises(DocumentError):
        school.select(rated)
    assert names(school, rated, pipeline={"ignore": {"student": {"rating": "checked"}}}) == science
    assert names(school, query, pipeline={"allow": {"student": {"classes": {"name": "checked"}}}}) == science
    for allow, asked in (({"student": {"classes": {"name": "checked"}}}, charlie), ({}, query)):
        with pytest.raises(DocumentError) as e:
            school.select(asked, pipeline={"allow": allow})
        assert "not-allowed" in e.value.tags
    assert names(school, charlie, pipeline={"validate": {"student": {"name": lambda v, c: v == c["want"]}}}, want="Charlie") == {"Charlie"}
    with pytest.raises(DocumentError) as e:
        school.select(charlie, pipeline={"validate": {"student": {"name": lambda v: v != "Charlie"}}})
    assert "not-validated" in e.value.tags
    assert names(school, {"student/name": "anna"}, pipeline={"convert": {"student": {"name": capitalise}}}) == {"Anna"}
    asked, fill = {"student": {"classes": {"type": "maths"}}}, {"student": {"name": "Bobby"}}
    assert names(school, asked, pipeline={"fill_assoc": fill, "post_require": {"student": {"name": "checked"}}}) == {"Bobby"}
    assert names(school, asked, pipeline={"fill_assoc": fill, "post_mask": {"student": {"name": lambda v: True}}}) == maths
    assert names(school, asked, pipeline={"fill_assoc": fill, "pre_mask": {"student": {"name": "checked"}}}) == {"Bobby"}
    assert names(school, asked, pipeline={"fill_assoc": {"student": {"name": "BOBBY"}}, "post_transform": {"student": {"name": capitalise}}}) == {"Bobby"}
    assert names(school, asked, pipeline={"fill_assoc": {"student": {"name": "BOBBY"}}, "pre_transform": {"student": {"name": capitalise}}}) == set()
    assert names(school, charlie, pipeline={"post_process": lambda d, c: {"student": {"name": ["Bobby"]}}}) == {"Bobby"}
    more = {"student/siblings": (">", 3)}
    for rule in ("_", ">", (">", 3), lambda e: e.head == ">", [">", "_"], {"<", ">"}):
        assert names(school, more, pipeline={"expression": {"student": {"siblings": rule}}}) == {"Jack", "David"}
    for rule in ("<", (">", 4), {"<", "="}):
        with pytest.raises(DocumentError) as e:
            school.select(more, pipeline={"expression": {"student": {"siblings": rule}}})
        assert "failed-check" in e.value.tags


def test_views_and_connections(school, spark, tmp_path, same):
    narrow = {"student": {"name": [{"required": True}]}}
    same(school.documents({"student/name": "Anna"}, schema=narrow), [{"student": {"name": "Anna"}}])
    with pytest.raises(DocumentError):
        school.select({"student/siblings": 1}, schema=narrow)
    other = Store.open(spark, str(tmp_path / "other"), SCHOOL)
    other.insert({"student": {"name": "Zoe", "siblings": 9}})
    assert names(school, "student", connection=other) == {"Zoe"}
    before = other.tx
    trial = other.insert({"student": {"name": "Yan"}}, simulate=True)
    assert other.tx == before and names(trial.after, "student") == {"Zoe", "Yan"} and names(other, "student") == {"Zoe"}
    assert other.insert({"student": {"name": "Xu"}}, transact="async").result().tx == before + 1
    with pytest.raises(DocumentError):
        other.insert({"student": {"name": "W"}}, transact="nothing")
    other.update({"student/name": "Zoe"}, {"student": {"siblings": ("inc", 2)}})
    assert other.documents({"student/name": "Zoe"}, first=True)["student"]["siblings"] == 11
    frame = spark.createDataFrame([("Una", 1), ("Vic", None)], "name string, siblings int")
    other.insert_frame("student", frame)
    assert names(other, "student") == {"Zoe", "Xu", "Una", "Vic"}
    zoe = other.ids({"student/name": "Zoe"})[0]
    other.transact([(zoe, "student/siblings", 11, False)])
    assert "siblings" not in other.documents(zoe, first=True)["student"]
    assert other.history().where("not added").count() == 1
    assert isinstance(school, View) and "Store(" in repr(school)


NODES = {"node": {"name": [{"required": True}], "next": [{"type": "ref", "ref": {"ns": "node", "rval": "previous"}}]}}


def test_yield(spark, tmp_path, same):
    ds = Store.open(spark, str(tmp_path), NODES)
    ds.insert({"node": {"name": "A", "next": {"name": "B", "next": {"name": "C", "next": {"name": "D"}}}}})
    same(ds.documents({"node/name": "A"}, pull={"node": {"next": "yield"}}, first=True), {"node": {"name": "A", "next": {"name": "B", "next": {"name": "C", "next": {"name": "D"}}}}})
    same(ds.documents({"node/name": "C"}, pull={"node": {"previous": "yield"}}, first=True), {"node": {"name": "C", "previous": [{"name": "B", "previous": [{"name": "A"}]}]}})
    assert ds.linked({"node/name": "A"}, {"node": {"next": "yield"}}).count() == 4
    ds.delete_all({"node/name": "C"}, access={"node": {"next": "yield"}})
    same([d["node"]["name"] for d in ds.documents("node")], ["A", "B"])


FAMILY = {
    "person": {
        "name": [{"required": True}], "age": [{"type": "long"}], "gender": [{"type": "enum", "enum": {"ns": "person.gender", "values": {"m", "f"}}}],
        "parent": [{"type": "ref", "cardinality": "many", "ref": {"ns": "person", "rval": "child"}}],
        "sibling": [{"type": "ref", "cardinality": "many", "ref": {"ns": "person", "mutual": True}}],
        "son": [{"type": "alias", "alias": {"ns": "child", "template": {"child": {"gender": "m"}}}}],
        "grandson": [{"type": "alias", "alias": {"ns": "child/child", "template": {"child": {"son": {}}}}}],
        "brother": [{"type": "alias", "alias": {"ns": "sibling", "template": {"sibling": {"gender": "m"}}}}],
        "uncle": [{"type": "alias", "alias": {"ns": "parent/sibling", "template": {"parent": {"brother": {}}}}}],
        "elder-brother": [{"type": "alias", "alias": {"ns": "sibling", "template": {"age": Var("x"), "sibling": {"age": ("<", Var("x")), "gender": "m"}}}}],
    },
    "male": [{"type": "alias", "alias": {"ns": "person", "template": {"person": {"gender": "m"}}}}],
}


def test_aliases(spark, tmp_path):
    ds = Store.open(spark, str(tmp_path), FAMILY)
    ds.insert([{"db/id": TempId("sam"), "person": {"name": "Sam", "age": 60, "gender": "m", "sibling": {"name": "Bob", "age": 50, "gender": "m"}}},
               {"person": {"name": "Chris", "age": 30, "gender": "m", "parent": TempId("sam"), "sibling": {"name": "Jane", "age": 28, "gender": "f"}}}])
    assert names(ds, {"male/name": (".startsWith", "?", "C")}, "person") == {"Chris"}
    assert names(ds, {"person": {"son/name": "Chris"}}, "person") == {"Sam"}
    assert names(ds, {"person": {"brother/name": "Chris"}}, "person") == {"Jane"}  # the edge holds both ways
    assert names(ds, {"person": {"brother/name": "Bob"}}, "person") == {"Sam"}
    assert names(ds, {"person": {"uncle/name": "Bob"}}, "person") == {"Chris"}
    assert names(ds, {"person": {"elder-brother": {}}}, "person") == {"Sam"}  # as the template says: a brother of less age
    with pytest.raises(DocumentError) as e:
        ds.insert({"person": {"name": "X", "elder-brother": {"name": "Y"}}})
    assert "no-alias" in e.value.tags


def test_schema_names():
    link = Schema(NODES)
    assert link.flat["node/previous"].link.other == "node/next" and link.flat["node/next"].link.back == "previous"
    assert Schema({"a": {"b": [{"type": "ref", "ref": {"ns": "a"}}]}}).flat["a/b_of"].many
    two = Schema({"user": {"home": [{"type": "ref", "ref": {"ns": "city"}}], "work": [{"type": "ref", "ref": {"ns": "city"}}]}, "city": {"name": [{}]}})
    assert {"city/home_users", "city/work_users"} <= set(two.flat) and two.lookup["user/_home"] == "city/home_users"
    one = Schema({"inventory": {"book": [{"type": "ref", "ref": {"ns": "book"}}]}, "book": {"name": [{}]}})
    assert "book/inventories" in one.flat
    with pytest.raises(DocumentError):
        Schema({"a": {"b": [{"type": "nothing"}]}})
