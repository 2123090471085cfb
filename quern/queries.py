"""The registered queries over the driver's tables, and the SQL that they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.coerce import coerce_column
from quern.operators.changes import Rows, TableView
from quern.operators.query import View
from quern.operators.store import Store
from quern.plans.schema import Schema
from quern.sources.log import FACTS, VALUES, Facts, shared_folder
from quern.sources.tables import Table, Tables
from quern.terms import ANY, DocumentError, TempId, Var


def _ref(ns: str) -> list:
    return [{"type": "ref", "ref": {"ns": ns}}]


def _kind(kind: str) -> list:
    return [{"type": kind}]


SCHEMA = {
    "region": {"name": [{"representative": True}]},
    "nation": {"name": [{"representative": True}], "region": _ref("region")},
    "customer": {
        "name": [{"representative": True}], "acctbal": _kind("double"), "nation": _ref("nation"),
        "mktsegment": [{"type": "enum", "enum": {"ns": "customer.segment", "values": {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"}}}],
    },
    "supplier": {"name": [{"representative": True}], "acctbal": _kind("double"), "nation": _ref("nation")},
    "part": {"name": [{"representative": True, "fulltext": True}], "brand": [{}], "type": [{"fulltext": True}], "size": _kind("long"), "retailprice": _kind("double")},
    "order": {
        "status": [{"type": "enum", "enum": {"ns": "order.status", "values": {"F", "O", "P"}}}], "totalprice": _kind("double"),
        "orderdate": _kind("instant"), "priority": [{"representative": True}], "customer": _ref("customer"),
        "urgent": [{"type": "alias", "alias": {"ns": "customer", "template": {"priority": "1-URGENT", "status": "O"}}}],
    },
    "lineitem": {
        "quantity": _kind("double"), "extendedprice": _kind("double"), "discount": _kind("double"), "tax": _kind("double"),
        "returnflag": [{"representative": True}], "linestatus": [{}], "linenumber": _kind("long"), "order": _ref("order"), "part": _ref("part"),
        "supplier": _ref("supplier"),
    },
    "document": {"lang": [{"representative": True}], "source": [{}], "chars": _kind("long")},
    "label": {"quality": [{"type": "long", "representative": True}], "toxic": _kind("long"), "document": _ref("document")},
    "event": {"user": _kind("long"), "type": [{"representative": True}], "value": _kind("double")},
}

_FILES = {"order": "orders", "label": "labels", "document": "documents", "event": "events"}
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey",
         "document": "doc_id", "event": "event_id"}
_COLUMNS = {
    "region": {"name": "r_name"}, "nation": {"name": "n_name", "region": "n_regionkey"},
    "customer": {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment", "nation": "c_nationkey"},
    "supplier": {"name": "s_name", "acctbal": "s_acctbal", "nation": "s_nationkey"},
    "part": {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"},
    "order": {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority", "customer": "o_custkey"},
    "lineitem": {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag",
                 "linestatus": "l_linestatus", "linenumber": "l_linenumber", "order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"},
    "document": {"lang": "lang", "source": "source", "chars": "n_chars"}, "label": {"quality": "quality", "toxic": "toxic", "document": "doc_id"},
    "event": {"user": "user_id", "type": "event_type", "value": "value"},
}


def view(spark: SparkSession, sf_dir: str) -> TableView:
    """The driver's tables as namespaces. Tables without a key get two hashes of the whole row as id; one
    would put different rows together in a table of billions."""
    tables = {}
    for ns, columns in _COLUMNS.items():
        path = f"{sf_dir}/{_FILES.get(ns, ns)}.parquet"
        tables[ns] = Table(lambda path=path: spark.read.parquet(path), _KEYS.get(ns) or (lambda frame: F.struct(F.xxhash64(*map(F.col, frame.columns)), F.xxhash64(F.lit(1), *map(F.col, frame.columns)))), columns)
    return TableView(Tables(Schema(SCHEMA), tables))


_EVENT_LOG = {"user": {"last": [{}], "kinds": [{"cardinality": "many"}]}}


def event_log(spark: SparkSession, sf_dir: str) -> Facts:
    """The events as facts, a transaction a day: a user's last type of event, and the set of its types,
    to which a value under 50 adds and from which another value takes away."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tx = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1001).cast("long")
    # Of a day's events of a user, the last one is the day's assertion.
    day = events.groupBy(F.col("user_id").alias("e"), tx.alias("tx")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    last = day.select("e", "tx", F.lit("user/last").alias("a"), "s", F.lit(True).alias("added"))
    kinds = events.select(F.col("user_id").alias("e"), tx.alias("tx"), F.lit("user/kinds").alias("a"), F.col("event_type").alias("s"),
                          (F.col("value") < 50).alias("added")).distinct()
    facts = last.unionByName(kinds)
    fields = {f.name: f.dataType for f in FACTS.fields}
    sizes = lambda: dict.fromkeys(("user/last", "user/kinds"), events.count())  # noqa: E731  at most
    return Facts(Schema(_EVENT_LOG), facts.select("e", "a", *(F.col("s") if c == "s" else F.lit(None).cast(fields[c]).alias(c) for c in VALUES), "added", "tx"), sizes)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[TableView], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(view(spark, sf_dir))
    SQL[name] = sql


def _select(name: str, ns: str, query: object, sql: str, columns: str = "*", **keys: object) -> None:
    """A document query whose result's namespace struct is laid out flat."""
    _add(name, lambda v: v.select(query, **keys).select(*(f"{ns}.{c.strip()}" for c in columns.split(","))), sql)


_REGION = "r_name AS name"
_NATION = "n_name AS name"
_CUSTOMER = "c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment"
_SUPPLIER = "s_name AS name, s_acctbal AS acctbal"
_PART = "p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, p_retailprice AS retailprice"
_ORDER = "o_orderstatus AS status, o_totalprice AS totalprice, o_orderpriority AS priority"
_ORDER_MODEL = {"order": {"orderdate": "unchecked"}}
_LINE = ("l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag, "
         "l_linestatus AS linestatus, CAST(l_linenumber AS BIGINT) AS linenumber")


# Filters
_select("sel_exists_ns", "nation", "nation", f"SELECT DISTINCT {_NATION} FROM nation WHERE n_name IS NOT NULL")
_select("sel_exists_attr", "customer", {"customer/acctbal": ANY}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_acctbal IS NOT NULL")
_select("sel_eq", "customer", {"customer": {"mktsegment": "BUILDING"}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'")
_select("sel_enum_qualified", "customer", {"customer/mktsegment": "customer.segment/BUILDING"}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'")
_select("sel_and", "order", {"order": {"status": "F", "priority": "1-URGENT"}}, f"SELECT DISTINCT {_ORDER} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", pull=_ORDER_MODEL)
_select("sel_gt", "customer", {"customer": {"acctbal": (">", 5000.0)}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_acctbal > 5000")
_select("sel_lt_flipped", "customer", {"customer": {"acctbal": ("<", 5000.0, "?")}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE 5000 < c_acctbal")
_select("sel_text_term", "part", {"part": {"size": [["(>= ? 40)"]]}}, f"SELECT DISTINCT {_PART} FROM part WHERE p_size >= 40")
_select("sel_not", "order", {"order": {"status": ("?not", "F")}}, f"SELECT DISTINCT {_ORDER} FROM orders WHERE o_orderstatus <> 'F'", pull=_ORDER_MODEL)
_select("sel_contains", "part", {"part": {"type": (".contains", "RO")}}, f"SELECT DISTINCT {_PART} FROM part WHERE contains(p_type, 'RO')")
_select("sel_startswith", "part", {"part": {"name": (".startsWith", "?", "b")}}, f"SELECT DISTINCT {_PART} FROM part WHERE starts_with(p_name, 'b')")
_select("sel_endswith", "customer", {"customer": {"name": (".endsWith", "7")}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE ends_with(c_name, '7')")
_select("sel_rev_contains", "region", {"region": {"name": (".contains", "ASIA AND EUROPE", "?")}}, f"SELECT DISTINCT {_REGION} FROM region WHERE contains('ASIA AND EUROPE', r_name)")
_select("sel_matches", "customer", {"customer": {"name": (".matches", ".*00[0-4]")}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE regexp_full_match(c_name, '.*00[0-4]')")
_select("sel_fulltext", "part", {"part": {"name": ("?fulltext", "ring")}}, f"SELECT DISTINCT {_PART} FROM part WHERE list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'ring')")
_select("sel_union", "customer", [{"customer": {"mktsegment": "BUILDING"}}, {"customer": {"acctbal": ("<", 0.0)}}],
        f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
_select("sel_by_id", "order", {"order": {"status": ANY}, "db/id": 5}, f"SELECT DISTINCT {_ORDER} FROM orders WHERE o_orderkey = 5", pull=_ORDER_MODEL)
_select("sel_ref_id", "nation", {"nation": {"region": 2}}, f"SELECT DISTINCT {_NATION} FROM nation WHERE n_regionkey = 2")
_select("sel_rev_ref_id", "customer", {"customer": {"orders": 5}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = 5)")

# Joins
_select("sel_fwd1", "customer", {"customer": {"nation/name": "NATION_3"}}, f"SELECT DISTINCT {_CUSTOMER} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
_select("sel_fwd2", "customer", {"customer": {"nation": {"region": {"name": "ASIA"}}}},
        f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name = 'ASIA')")
_select("sel_fwd4", "lineitem", {"lineitem": {"order/customer/nation/region/name": "ASIA"}},
        f"SELECT DISTINCT {_LINE} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
_select("sel_rev1", "nation", {"nation": {"customers": {"acctbal": (">", 9900.0)}}}, f"SELECT DISTINCT {_NATION} FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
_select("sel_rev2", "region", {"region": {"nations/customers": {"mktsegment": "BUILDING"}}},
        f"SELECT DISTINCT {_REGION} FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING')")
_select("sel_rev_fwd", "supplier", {"supplier": {"lineitems/part": {"brand": "Brand#13", "size": ("<", 10)}}},
        f"SELECT DISTINCT {_SUPPLIER} FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#13' AND p_size < 10)")
_select("sel_and_maps", "customer", {"customer": {"orders": [{"status": "F"}, {"status": "O"}]}},
        f"SELECT DISTINCT {_CUSTOMER} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
_select("sel_cycle", "nation", {"nation": {"customers/orders/lineitems/supplier/nation": {"name": "NATION_3"}}},
        f"SELECT DISTINCT {_NATION} FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey "
        "JOIN supplier ON l_suppkey = s_suppkey JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_name = 'NATION_3')")
_select("sel_var_join", "order", {"order": {"lineitems/supplier/nation": Var("n"), "customer/nation": Var("n")}},
        f"SELECT DISTINCT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey "
        "WHERE s_nationkey = c_nationkey", pull=_ORDER_MODEL)
_select("sel_var_entity", "order", {"order": {"lineitems/supplier/nation": {"+": {"db/id": Var("n")}, "name": ANY}, "customer/nation": {"+": {"db/id": Var("n")}, "name": ANY}}},
        SQL["sel_var_join"], pull=_ORDER_MODEL)
_select("sel_theta", "order", {"order": {"lineitems": [{"quantity": Var("q"), "linenumber": 1}, {"quantity": (">", Var("q")), "linenumber": 2}]}},
        f"SELECT DISTINCT {_ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_orderkey = o_orderkey "
        "AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND b.l_quantity > a.l_quantity)", pull=_ORDER_MODEL)
_select("sel_alias", "order", {"order": {"urgent": {"mktsegment": "BUILDING"}}},
        f"SELECT DISTINCT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'", pull=_ORDER_MODEL)
_select("sel_labels", "document", {"document": {"labels": {"quality": 1, "toxic": 1}}},
        "SELECT DISTINCT lang, source, n_chars AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1)")

# Projection
_select("pull_default", "supplier", "supplier", f"SELECT DISTINCT {_SUPPLIER} FROM supplier")
_select("pull_unchecked", "customer", "customer", "SELECT DISTINCT c_mktsegment AS mktsegment FROM customer", pull={"customer": {"name": "unchecked", "acctbal": "unchecked"}})
_select("pull_blank", "customer", "customer", "SELECT DISTINCT c_mktsegment AS mktsegment FROM customer", pull={"customer": {"mktsegment": "checked"}}, blank=True)
_add("pull_one", lambda v: v.select({"order/status": "P"}, pull={"order": {"orderdate": "unchecked", "customer": {"acctbal": "unchecked"}}}).select(
    "order.status", "order.totalprice", "order.priority", F.col("order.customer.name").alias("customer_name"), F.col("order.customer.mktsegment").alias("customer_segment")),
    f"SELECT DISTINCT {_ORDER}, c_name AS customer_name, c_mktsegment AS customer_segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
_add("pull_rev", lambda v: v.select("nation", pull={"nation": {"suppliers": {"acctbal": "unchecked"}}}).select("nation.name", F.explode("nation.suppliers.name").alias("supplier")),
     "SELECT DISTINCT n_name AS name, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_add("pull_rev_ids", lambda v: v.select("nation", pull={"nation": {"customers": "id"}}).select("nation.name", F.concat_ws(",", F.col("nation.customers").cast("array<string>")).alias("customers")),
     "SELECT n_name AS name, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
_add("pull_id", lambda v: v.select("nation", pull={"nation": {"region": "id"}}).select("nation.name", F.col("nation.region").cast("long").alias("region")),
     "SELECT DISTINCT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
_add("pull_deep", lambda v: v.select({"region/name": "EUROPE"}, pull={"region": {"nations": {"suppliers": {"acctbal": "unchecked"}}}}).select(
    F.col("region.name").alias("region"), F.explode("region.nations").alias("n")).select("region", F.col("n.name").alias("nation"), F.explode("n.suppliers.name").alias("supplier")),
    "SELECT DISTINCT r_name AS region, n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'EUROPE'")
_add("pull_flat", lambda v: v.children({"nation/name": "NATION_3"}, "nation/customers").select(F.col("eid").cast("long").alias("eid"), "child"),
     "SELECT CAST(c_nationkey AS BIGINT) AS eid, c_custkey AS child FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
_select("access_ok", "customer", {"customer/mktsegment": "MACHINERY"}, "SELECT DISTINCT c_name AS name, c_mktsegment AS mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'",
        access={"customer": {"acctbal": "unchecked"}})
_select("first", "customer", {"customer/mktsegment": "BUILDING"}, f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1", first=True)
_add("return_ids", lambda v: v.select({"order/status": "P"}, returns="ids"), "SELECT o_orderkey AS eid FROM orders WHERE o_orderstatus = 'P'")
_add("return_entities", lambda v: v.select("nation", returns="entities").select("eid", "nation.name"), "SELECT n_nationkey AS eid, n_name AS name FROM nation")
_add("with_ids", lambda v: v.select("region", ids=True).select(F.col("db.id").cast("long").alias("id"), "region.name"), "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
_add("linked", lambda v: View(v.source).linked({"customer/name": (".endsWith", "11")}, {"customer": {"nation": {"region": "checked"}}}).select(F.col("eid").cast("long").alias("eid")),
     "WITH c AS (SELECT * FROM customer WHERE ends_with(c_name, '11')) SELECT c_custkey AS eid FROM c UNION SELECT c_nationkey FROM c UNION "
     "SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)")

# Stages on the query document
_BOTH = {"order": {"status": "F", "customer": {"mktsegment": "BUILDING"}}}
_select("stage_pre_process", "customer", {"customer/mktsegment": "none"}, SQL["sel_eq"], pipeline={"pre_process": lambda d: {"customer": {"mktsegment": "BUILDING"}}})
_select("stage_mask", "order", _BOTH, f"SELECT DISTINCT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", pull=_ORDER_MODEL,
        pipeline={"pre_mask": {"order": {"status": "checked"}}})
_select("stage_transform", "customer", {"customer/mktsegment": "BUILDING"}, SQL["sel_eq"].replace("BUILDING", "MACHINERY"),
        pipeline={"pre_transform": {"customer": {"mktsegment": lambda v: "MACHINERY"}}})
_select("stage_fill_empty", "order", {"order": {"status": "F"}}, f"SELECT DISTINCT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'",
        pull=_ORDER_MODEL, pipeline={"fill_empty": {"order": {"customer": {"mktsegment": "BUILDING"}}}})
_select("stage_fill_assoc", "customer", {"customer": {"orders": {"status": "F"}}}, SQL["sel_and_maps"], pipeline={"fill_assoc": {"customer": {"orders": [{"status": "O"}]}}})
_select("stage_convert", "region", {"region/name": "asia"}, f"SELECT {_REGION} FROM region WHERE r_name = 'ASIA'", pipeline={"convert": {"region": {"name": str.upper}}})
_select("stage_ignore", "region", {"region": {"name": "ASIA", "colour": "red"}}, f"SELECT {_REGION} FROM region WHERE r_name = 'ASIA'", pipeline={"ignore": {"region": {"colour": "checked"}}})
_select("stage_post_process", "region", {"region/name": "ASIA"}, f"SELECT {_REGION} FROM region WHERE r_name = 'EUROPE'", pipeline={"post_process": lambda d: {"region": {"name": ["EUROPE"]}}})

_select("stage_require", "customer", {"customer/mktsegment": "BUILDING"}, SQL["sel_eq"], pipeline={"pre_require": {"customer": {"mktsegment": "checked"}}})
_select("stage_post_require", "customer", {"customer/mktsegment": "BUILDING"}, SQL["sel_eq"], pipeline={"post_require": {"customer": {"mktsegment": "checked"}}})
_select("stage_post_mask", "order", _BOTH, SQL["stage_mask"], pull=_ORDER_MODEL, pipeline={"post_mask": {"order": {"status": "checked"}}})
_select("stage_post_transform", "customer", {"customer/mktsegment": "BUILDING"}, SQL["stage_transform"], pipeline={"post_transform": {"customer": {"mktsegment": lambda v: "MACHINERY"}}})
_select("stage_expression", "customer", {"customer": {"acctbal": (">", 5000.0)}}, SQL["sel_gt"], pipeline={"expression": {"customer": {"acctbal": {">", "<"}}}})
_select("stage_validate", "customer", {"customer/mktsegment": "BUILDING"}, SQL["sel_eq"], pipeline={"validate": {"customer": {"mktsegment": lambda v: v.isupper()}}})
_select("stage_typecheck", "part", {"part": {"size": "40"}}, f"SELECT DISTINCT {_PART} FROM part WHERE p_size = 40", use_typecheck=True, use_coerce=True)
_select("skip_normalise", "customer", {"customer": {"mktsegment": ["BUILDING"]}}, SQL["sel_eq"], skip_normalise=True)
_add("record", lambda v: v.select({"customer/mktsegment": "BUILDING"}, record=True).result.select("customer.name", "customer.acctbal", "customer.mktsegment"), SQL["sel_eq"])

# Raw patterns
_DATALOG = ["find", "?o", "in", "$", "?segment", "where", ["?o", "order/customer", "?c"], ["?c", "customer/mktsegment", "?segment"], ["?o", "order/totalprice", "?p"], [[">", "?p", 300000.0]]]
_add("datalog_join", lambda v: v.query(_DATALOG, ["BUILDING"], returns="ids"),
     "SELECT DISTINCT o_orderkey AS eid FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
_add("datalog_fulltext", lambda v: v.query(["find", "?s", "where", ["?l", "lineitem/supplier", "?s"], ["?l", "lineitem/part", "?p"], [["fulltext", "$", "part/name", "ring"], [["?p", "?n"]]]], returns="ids"),
     "SELECT DISTINCT l_suppkey AS eid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'ring')")

# Changes, simulated
_ALL_CUSTOMERS = "SELECT c_name, c_acctbal, c_mktsegment FROM customer"


def _customers(v: TableView) -> DataFrame:
    return v.source.tables["customer"].frame.select("c_name", "c_acctbal", "c_mktsegment")


_add("update_sim", lambda v: _customers(v.update("customer", {"customer/nation/name": "NATION_3"}, {"acctbal": 0.0})),
     "SELECT c_name, CASE WHEN n_name = 'NATION_3' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("delete_sim", lambda v: _customers(v.delete("customer", {"customer/acctbal": ("<", 0.0)})), f"{_ALL_CUSTOMERS} WHERE NOT c_acctbal < 0")
_add("retract_sim", lambda v: _customers(v.retract("customer", {"customer/mktsegment": "BUILDING"}, ["acctbal"], lambda c: c > 5000)),
     "SELECT c_name, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
_add("update_in_sim", lambda v: _customers(v.update_in({"region/name": "ASIA"}, ["nations", "_", "nation/customers", {"mktsegment": "BUILDING"}], {"acctbal": 1.0})),
     "SELECT c_name, CASE WHEN r_name = 'ASIA' AND c_mktsegment = 'BUILDING' THEN 1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey "
     "JOIN region ON n_regionkey = r_regionkey")
_add("delete_in_sim", lambda v: _customers(v.delete_in({"nation/name": "NATION_3"}, ["customers", {"acctbal": (">", 5000.0)}])),
     f"{_ALL_CUSTOMERS} JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_name = 'NATION_3' AND c_acctbal > 5000)")
_add("retract_in_sim", lambda v: _customers(v.retract_in({"nation/name": "NATION_3"}, ["customers", "_"], ["mktsegment"])),
     "SELECT c_name, c_acctbal, CASE WHEN n_name = 'NATION_3' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("insert_sim", lambda v: v.insert("region", v.source.tables["region"].frame.select(F.concat(F.lit("NEW "), "r_name").alias("name"), (F.col("r_regionkey") + 100).alias("r_regionkey")))
     .select("region").select("region.name"), "SELECT r_name AS name FROM region UNION SELECT 'NEW ' || r_name FROM region")
_add("sync_sim", lambda v: _customers(v.update("customer", {"customer/mktsegment": "BUILDING"}, {"acctbal": 7.0}).delete("customer", {"customer/acctbal": ("<", 0.0)})),
     f"SELECT * FROM (SELECT c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 7.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer) WHERE NOT c_acctbal < 0")


# Stages on whole tables
def _rows(v: TableView, ns: str) -> Rows:
    table = v.source.tables[ns]
    return Rows(v.schema, ns, table.frame.select(*(F.col(c).alias(n) for n, c in table.columns.items() if isinstance(c, str))))


_add("rows_mask", lambda v: _rows(v, "supplier").mask({"nation": "checked", "acctbal": lambda c: c < 0}).frame, "SELECT s_name AS name, CASE WHEN NOT s_acctbal < 0 THEN s_acctbal END AS acctbal FROM supplier")
_add("rows_transform", lambda v: _rows(v, "region").transform({"name": F.lower}).frame, "SELECT lower(r_name) AS name FROM region")
_add("rows_fill", lambda v: _rows(v, "supplier").mask({"acctbal": lambda c: c < 0, "nation": "checked"}).fill_empty({"acctbal": 0.0}).frame,
     "SELECT s_name AS name, CASE WHEN NOT s_acctbal < 0 THEN s_acctbal ELSE 0.0 END AS acctbal FROM supplier")
_add("rows_require_validate", lambda v: _rows(v, "region").require(["name"]).validate({"name": lambda c: F.length(c) > 2}).frame, "SELECT r_name AS name FROM region")
_add("rows_fill_assoc", lambda v: Rows(v.schema, "event", v.source.tables["event"].frame.groupBy(F.col("user_id").alias("user")).agg(F.collect_set("event_type").alias("kinds")))
     .fill_assoc({"kinds": ["visit"]}).frame.select("user", F.concat_ws(",", "kinds").alias("kinds")),
     "SELECT user_id AS user, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT DISTINCT user_id, event_type AS k FROM events UNION SELECT user_id, 'visit' FROM events) GROUP BY user_id")
_add("coerce_columns", lambda v: v.source.tables["part"].frame.select(
    F.col("p_partkey"), coerce_column(F.col("p_size"), "int", "string").alias("as_text"), coerce_column(F.col("p_retailprice"), "double", "long").alias("as_long"),
    coerce_column(F.regexp_extract("p_brand", "([0-9]+)", 1), "string", "long").alias("from_text")),
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS as_text, CAST(trunc(p_retailprice) AS BIGINT) AS as_long, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS from_text FROM part")


# History
def _log(name: str, query: Callable[[Facts], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(event_log(spark, sf_dir))
    SQL[name] = sql


_DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1001"
_LAST = f"(SELECT user_id AS e, {_DAY} AS tx, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY 1, 2)"
_KINDS = f"(SELECT DISTINCT user_id AS e, {_DAY} AS tx, event_type AS s, value < 50 AS added FROM events)"


def _as_of(facts: Facts, tx: int | None) -> Facts:
    return facts if tx is None else Facts(facts.schema, facts.facts.where(F.col("tx") <= tx), facts.sizes)


_log("log_snapshot", lambda f: f.wide("user", [f.schema.flat["user/last"]]).select("eid", F.col("user/last").alias("last")),
     f"SELECT e AS eid, arg_max(s, tx) AS last FROM {_LAST} GROUP BY e")
_log("log_as_of", lambda f: _as_of(f, 1010).wide("user", [f.schema.flat["user/last"]]).select("eid", F.col("user/last").alias("last")).where("last is not null"),
     f"SELECT e AS eid, arg_max(s, tx) AS last FROM {_LAST} WHERE tx <= 1010 GROUP BY e")
_log("log_many", lambda f: f.pairs(f.schema.flat["user/kinds"]).select("e", "v"),
     f"SELECT e, s AS v FROM {_KINDS} GROUP BY e, s HAVING arg_max(added, (tx, added))")
_log("log_history", lambda f: f.facts.select("e", "a", "s", "tx", "added"),
     f"SELECT e, 'user/last' AS a, s, CAST(tx AS BIGINT) AS tx, true AS added FROM {_LAST} UNION ALL SELECT e, 'user/kinds', s, CAST(tx AS BIGINT), added FROM {_KINDS}")
_log("log_transactions", lambda f: f.facts.where((F.col("a") == "user/kinds") & (F.col("s") == "error")).select("tx").distinct(), f"SELECT DISTINCT CAST(tx AS BIGINT) AS tx FROM {_KINDS} WHERE s = 'error'")
_log("log_query", lambda f: View(f).select({"user": {"kinds": ["click", "error"], "last": "view"}}, returns="ids"),
     f"WITH k AS (SELECT e, s FROM {_KINDS} GROUP BY e, s HAVING arg_max(added, (tx, added))), l AS (SELECT e, arg_max(s, tx) AS s FROM {_LAST} GROUP BY e) "
     "SELECT e AS eid FROM l WHERE s = 'view' AND e IN (SELECT e FROM k WHERE s = 'click') AND e IN (SELECT e FROM k WHERE s = 'error')")


# Stores: the tables are loaded, then changed by real transactions
_STORED = {
    "nation": {"key": [{"type": "long", "unique": "identity", "required": True}], "name": [{"fulltext": True}]},
    "customer": {
        "key": [{"type": "long", "unique": "identity", "required": True}], "name": [{"restrict": ("a name starts so", lambda s: s.startswith("Customer"))}],
        "acctbal": _kind("double"), "credits": [{"type": "long", "default": 0}], "nation": _ref("nation"),
        "segment": [{"type": "enum", "enum": {"ns": "segment", "values": {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"}}}],
        "marks": [{"type": "keyword", "cardinality": "many", "keyword": {"ns": "mark"}}],
    },
}


def loaded(spark: SparkSession, sf_dir: str) -> Store:
    """A new store with the nations (transaction 1001) and the customers (1002)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ds = Store.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", _STORED)
    ds.insert_frame("nation", read("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))
    nations = ds.source.pairs(ds.schema.flat["nation/key"]).select(F.col("e").alias("nation"), F.col("v").alias("c_nationkey"))
    marks = F.array(F.concat(F.lit("mark/"), F.lower("c_mktsegment")), F.lit(":mark/all"))
    ds.insert_frame("customer", read("customer").join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
        F.concat(F.lit(":segment/"), "c_mktsegment").alias("segment"), "nation", marks.alias("marks")))
    return ds


_STATE = ("key", "name", "acctbal", "credits", "segment")


def _state(ds: Store, query: object = "customer", **keys: object) -> DataFrame:
    return ds.select(query, pull={"customer": dict.fromkeys(_STATE, "checked") | {"marks": "unchecked"}}, **keys).select(*(f"customer.{c}" for c in _STATE))


def _store(name: str, change: Callable[[Store], object], sql: str, show: Callable[[Store], DataFrame] = _state) -> None:
    """A change of a loaded store, and what the store, or what the change returned, shows then."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = loaded(spark, sf_dir)
        out = change(ds)
        return show(out if isinstance(out, Store) else ds)

    QUERIES[name] = run
    SQL[name] = sql


def _stored(acctbal: str = "c_acctbal", segment: str = "c_mktsegment", name: str = "c_name", where: str = "true", credits: str = "CAST(0 AS BIGINT)") -> str:
    return (f"SELECT c_custkey AS key, {name} AS name, {acctbal} AS acctbal, {credits} AS credits, {segment} AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {where}")


_IN_3, _BUILDING = {"customer/nation/name": "NATION_3"}, {"customer/segment": "BUILDING"}
_store("store_insert_frame", lambda ds: None, _stored())
_store("store_marks", lambda ds: None, "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'",
       lambda ds: ds.select({"customer": {"marks": [":mark/building", "all"]}}, pull={"customer": {"key": "checked"}}, blank=True).select("customer.key"))
_store("store_update", lambda ds: ds.update(_IN_3, {"customer/acctbal": 0.0}), _stored("CASE WHEN n_name = 'NATION_3' THEN 0.0 ELSE c_acctbal END"))
_store("store_update_function", lambda ds: ds.update(_BUILDING, {"customer": {"credits": ("inc", 5)}}), _stored(credits="CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END AS BIGINT)"))
_store("store_update_nested", lambda ds: ds.update({"customer/key": 7}, {"customer": {"nation": {"key": 77, "name": "ATLANTIS"}}}),
       "SELECT n_name AS name FROM nation UNION ALL SELECT 'ATLANTIS'", lambda ds: ds.select("nation", pull={"nation": {"name": "checked"}}, blank=True).select("nation.name"))
_store("store_delete", lambda ds: ds.delete({"customer/acctbal": ("<", 0.0)}), _stored(where="NOT c_acctbal < 0"))
_store("store_delete_all", lambda ds: ds.delete_all({"nation/name": "NATION_3"}, access={"nation": {"customers": {}}}), _stored(where="n_name <> 'NATION_3'"))
_store("store_retract", lambda ds: ds.retract(_BUILDING, [("customer/acctbal", (">", 5000.0))]), _stored("CASE WHEN NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) THEN c_acctbal END"))
_store("store_update_in", lambda ds: ds.update_in({"nation/name": "NATION_3"}, ["customers", {"segment": "BUILDING"}], {"acctbal": 1.0}),
       _stored("CASE WHEN n_name = 'NATION_3' AND c_mktsegment = 'BUILDING' THEN 1.0 ELSE c_acctbal END"))
_store("store_delete_in", lambda ds: ds.delete_in({"nation/name": "NATION_3"}, ["customers", {"acctbal": (">", 5000.0)}]), _stored(where="NOT (n_name = 'NATION_3' AND c_acctbal > 5000)"))
_store("store_retract_in", lambda ds: ds.retract_in({"nation/name": "NATION_3"}, ["customers", "_"], ["segment"]), _stored(segment="CASE WHEN n_name <> 'NATION_3' THEN c_mktsegment END"))
_store("store_transact", lambda ds: ds.transact([(TempId("x"), "nation/name", "ATLANTIS"), (TempId("x"), "nation/key", 77)]),
       "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT 77, 'ATLANTIS'", lambda ds: ds.select("nation").select("nation.key", "nation.name"))


def _two_changes(ds: Store) -> None:
    with ds.sync() as held:
        held.update(_BUILDING, {"customer/acctbal": 7.0})
        held.delete({"customer/acctbal": ("<", 0.0)})  # both see the snapshot from before


_store("store_sync", _two_changes, _stored("CASE WHEN c_mktsegment = 'BUILDING' THEN 7.0 ELSE c_acctbal END", where="NOT c_acctbal < 0"),
       lambda ds: _state(ds, {"customer/key": ANY}, at=1003))
_store("store_snapshot", lambda ds: ds.update("customer", {"customer/acctbal": 0.0}), _stored(), lambda ds: _state(ds, at=1002))
_store("store_instant", lambda ds: ds.delete("customer"), _stored(), lambda ds: _state(ds.snapshot(ds.transaction_time(1002))))
_store("store_simulate", lambda ds: ds.delete({"customer/acctbal": ("<", 0.0)}, simulate=True).after.update(_BUILDING, {"customer/credits": 3}, simulate=True).after,
       _stored(where="NOT c_acctbal < 0", credits="CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END AS BIGINT)"))
_store("store_transactions", lambda ds: (ds.update(_BUILDING, {"customer/acctbal": 1.0}), ds.update(_BUILDING, {"customer/credits": 2})), "SELECT CAST(unnest([1002, 1003]) AS BIGINT) AS tx",
       lambda ds: ds.spark.createDataFrame([(t,) for t in ds.transactions("customer/acctbal")], "tx long"))
_store("store_history", lambda ds: ds.retract(_BUILDING, "customer/acctbal"),
       "SELECT 1002 AS tx, true AS added, count(*) AS n FROM customer UNION ALL SELECT 1003, false, count(*) FROM customer WHERE c_mktsegment = 'BUILDING'",
       lambda ds: ds.history().where("a = 'customer/acctbal'").groupBy(F.col("tx").cast("int").alias("tx"), "added").agg(F.count("*").alias("n")))


def _compacted(ds: Store) -> None:
    ds.update(_IN_3, {"customer/acctbal": 0.0})
    ds.compact()
    ds.delete(_BUILDING)


_store("store_compact", _compacted, _stored("CASE WHEN n_name = 'NATION_3' THEN 0.0 ELSE c_acctbal END", where="c_mktsegment <> 'BUILDING'"))
_store("store_compact_as_of", _compacted, _stored(), lambda ds: _state(ds, at=1002))
_store("store_upsert", lambda ds: ds.insert_frame("customer", ds.spark.createDataFrame([(7, "Customer seven", 9), (-1, "Customer none", None)], "key long, name string, credits long")),
       _stored(name="CASE WHEN c_custkey = 7 THEN 'Customer seven' ELSE c_name END", credits="CAST(CASE WHEN c_custkey = 7 THEN 9 ELSE 0 END AS BIGINT)")
       + " UNION ALL SELECT -1, 'Customer none', NULL, 0, NULL")
_store("store_insert", lambda ds: ds.insert([{"customer": {"key": -1, "name": "Customer A", "nation": TempId("n")}}, {"nation": {"key": -5, "name": "N"}, "db/id": TempId("n")}]),
       "SELECT -1 AS key, 'N' AS nation", lambda ds: ds.select({"customer/nation/key": -5}, pull={"customer": {"key": "checked", "nation": {"name": "checked"}}}, blank=True)
       .select(F.col("customer.key").cast("int").alias("key"), F.col("customer.nation.name").alias("nation")))
_store("store_linked", lambda ds: None, "SELECT count(*) + 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
       lambda ds: ds.linked({"nation/name": "NATION_3"}, {"nation": {"customers": "id"}}).agg(F.count("*").alias("n")))
_store("store_fulltext", lambda ds: ds.update({"nation/key": 3}, {"nation/name": "A sci-fi Land"}), "SELECT 3 AS key",
       lambda ds: ds.select({"nation": {"name": ("?fulltext", "Sci-Fi")}}, pull={"nation": {"key": "checked"}}, blank=True).select(F.col("nation.key").cast("int").alias("key")))
_store("store_properties", lambda ds: None, "SELECT * FROM (VALUES ('nation/key', 'long', 'one'), ('nation/name', 'string', 'one'), ('customer/key', 'long', 'one'), ('customer/name', 'string', 'one'), "
       "('customer/acctbal', 'double', 'one'), ('customer/credits', 'long', 'one'), ('customer/nation', 'ref', 'one'), ('customer/segment', 'enum', 'one'), ('customer/marks', 'keyword', 'many')) "
       "t(ident, type, cardinality)", lambda ds: ds.schema_properties())


def _waiting(ds: Store) -> None:
    waiting = [ds.update({"customer/key": k}, {"customer/credits": k}, transact="async") for k in (1, 2, 3)]
    for w in waiting:
        w.result()


_store("store_async", _waiting, _stored(credits="CAST(CASE WHEN c_custkey <= 3 THEN c_custkey ELSE 0 END AS BIGINT)"), lambda ds: _state(ds, at=1005))
_store("store_retract_path", lambda ds: ds.retract({"customer/key": 1}, "customer/nation/name"),
       "SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN n_nationkey <> (SELECT c_nationkey FROM customer WHERE c_custkey = 1) THEN n_name END AS name FROM nation",
       lambda ds: ds.select("nation").select("nation.key", "nation.name"))
_store("store_deleted_documents", lambda ds: None, _stored(where="c_acctbal < 0"),
       lambda ds: ds.delete({"customer/acctbal": ("<", 0.0)}).select(pull={"customer": dict.fromkeys(_STATE, "checked") | {"marks": "unchecked"}}).select(*(f"customer.{c}" for c in _STATE)))
_store("store_query", lambda ds: None, "SELECT DISTINCT c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND c_acctbal > 0",
       lambda ds: ds.query(["find", "?c", "where", ["?c", "customer/nation", "?n"], ["?n", "nation/name", "NATION_3"], ["?c", "customer/acctbal", "?b"], [[">", "?b", 0.0]]],
                           pull={"customer": {"key": "checked"}}, blank=True).select("customer.key"))

_CHAIN = {"node": {"key": [{"type": "long", "unique": "identity"}], "next": [{"type": "ref", "ref": {"ns": "node", "rval": "previous"}}],
                   "near": [{"type": "ref", "cardinality": "many", "ref": {"ns": "node", "mutual": True}}],
                   "parts": [{"type": "ref", "cardinality": "many", "isComponent": True, "ref": {"ns": "part"}}]}, "part": {"of": [{"type": "long", "required": True}]}}


def chained(spark: SparkSession, sf_dir: str) -> Store:
    """A node for each nation, each followed by that of the next key, near the one after that, with a part of its own."""
    ds = Store.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", _CHAIN)
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("key"))
    ds.insert_frame("node", keys)
    ds.insert_frame("part", keys.select(F.col("key").alias("of")))
    known = lambda ident, shift, name: ds.source.pairs(ds.schema.flat[ident]).select((F.col("v") - shift).alias("key"), F.col("e").alias(name))
    ds.insert_frame("node", keys.join(known("node/key", 1, "next"), "key", "left").join(known("node/key", 2, "near"), "key", "left").join(known("part/of", 0, "parts"), "key").select(
        "key", "next", F.when(F.col("near").isNotNull(), F.array("near")).alias("near"), F.array("parts").alias("parts")))
    return ds


def _chain(name: str, show: Callable[[Store], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: show(chained(spark, sf_dir))
    SQL[name] = sql


def _keys_of(ds: Store, ids: DataFrame) -> DataFrame:
    return ds.source.pairs(ds.schema.flat["node/key"]).join(ids.select(F.col("eid").alias("e")), "e", "left_semi").select(F.col("v").alias("key"))


def _cascaded(ds: Store) -> DataFrame:
    ds.delete({"node/key": (">", 9)})
    return ds.select("part").select("part.of")


_NODE_KEY = "CAST(n_nationkey AS BIGINT) AS key FROM nation"
_chain("store_closure", lambda ds: _keys_of(ds, ds.linked({"node/key": 20}, {"node": {"next": "yield", "near": "unchecked", "parts": "unchecked"}})), f"SELECT {_NODE_KEY} WHERE n_nationkey >= 20")
_chain("store_self_join", lambda ds: _keys_of(ds, ds.select({"node": {"next/next/next": {"key": (">", 20)}}}, returns="ids")), f"SELECT {_NODE_KEY} WHERE n_nationkey + 3 > 20 AND n_nationkey + 3 < (SELECT count(*) FROM nation)")
_chain("store_reverse", lambda ds: _keys_of(ds, ds.select({"node": {"previous": {"key": ("<", 5)}}}, returns="ids")), f"SELECT {_NODE_KEY} WHERE n_nationkey BETWEEN 1 AND 5")
_chain("store_mutual", lambda ds: _keys_of(ds, ds.select({"node": {"near": {"key": 10}}}, returns="ids")), f"SELECT {_NODE_KEY} WHERE n_nationkey IN (8, 12)")
_chain("store_yield", lambda ds: ds.select({"node/key": 20}, pull={"node": {"next": "yield"}}, yield_depth=3).select(
    F.col("node.key").alias("a"), F.col("node.next.key").alias("b"), F.col("node.next.next.key").alias("c"), F.col("node.next.next.next.key").alias("d")),
    "SELECT CAST(20 AS BIGINT) AS a, CAST(21 AS BIGINT) AS b, CAST(22 AS BIGINT) AS c, CAST(23 AS BIGINT) AS d")
_chain("store_components", _cascaded, "SELECT CAST(n_nationkey AS BIGINT) AS of FROM nation WHERE n_nationkey <= 9")


# What documents must not be: the tag of the error of each
_MISTAKES: dict[str, tuple[str, Callable[[TableView, Store], object]]] = {
    "unknown attribute": ("no-schema", lambda v, ds: v.select({"customer": {"colour": "red"}})),
    "outside an enumeration": ("wrong-input", lambda v, ds: v.select({"customer/mktsegment": "none"})),
    "no constraint": ("empty-query", lambda v, ds: v.select({"customer": {}})),
    "an id where none may be": ("id-banned", lambda v, ds: v.select({"nation": {"region": 2}}, ban_ids=True)),
    "an id in the body": ("body-id-banned", lambda v, ds: v.select({"nation": {"region": 2}}, ban_body_ids=True)),
    "an id at the top": ("top-id-banned", lambda v, ds: v.select({"nation": {"name": ANY}, "db/id": 2}, ban_top_id=True)),
    "a name as a query": ("keyword-banned", lambda v, ds: v.select("nation", ban_underscores=True)),
    "an expression where none may be": ("not-allowed", lambda v, ds: v.select({"customer/acctbal": (">", 0.0)}, ban_expressions=True)),
    "an expression of another kind": ("failed-check", lambda v, ds: v.select({"customer/acctbal": (">", 0.0)}, pipeline={"expression": {"customer": {"acctbal": "<"}}})),
    "outside the access model": ("not-allowed", lambda v, ds: v.select({"customer/acctbal": 0.0}, access={"customer": {"acctbal": "unchecked"}})),
    "a value that is not valid": ("not-validated", lambda v, ds: v.select({"customer/name": "x"}, pipeline={"validate": {"customer": {"name": str.isupper}}})),
    "a key that is asked for": ("no-required", lambda v, ds: v.select({"customer/name": "x"}, pipeline={"pre_require": {"customer": {"acctbal": "checked"}}})),
    "a value of another type": ("wrong-type", lambda v, ds: v.select({"part/size": "40"}, use_typecheck=True)),
    "a required attribute": ("required", lambda v, ds: ds.insert({"customer": {"name": "Customer x"}})),
    "a restricted value": ("failed-restriction", lambda v, ds: ds.insert({"customer": {"key": -1, "name": "x"}})),
    "two values of a single attribute": ("wrong-input", lambda v, ds: ds.insert({"customer": {"key": -1, "name": ["Customer a", "Customer b"]}})),
    "any value in a write": ("query-only", lambda v, ds: ds.insert({"customer": "_"})),
    "an identity of two": ("unique", lambda v, ds: ds.update("nation", {"nation/key": 1})),
    "no access model": ("missing-allow-model", lambda v, ds: ds.delete_all("customer")),
    "a path that is not there": ("walk-path-key-not-in-schema", lambda v, ds: ds.retract("customer", "customer/colour")),
    "a path beyond a value": ("walk-path-cannot-walk-past-non-ref", lambda v, ds: ds.retract("customer", "customer/name/more")),
    "a way that is no reference": ("cannot-perform-reverse-lookup", lambda v, ds: ds.update_in("customer", ["name", "_"], {"name": "x"})),
    "a snapshot that is not the latest": ("conflict", lambda v, ds: ds.snapshot(1001).delete("nation")),
}


def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, ds = view(spark, sf_dir), loaded(spark, sf_dir)
    found = []
    for mistake, (_, attempt) in _MISTAKES.items():
        try:
            attempt(v, ds)
            found.append((mistake, "none"))
        except DocumentError as error:
            found.append((mistake, ",".join(sorted(error.tags))))
    return spark.createDataFrame(found, "mistake string, tag string")


QUERIES["document_errors"] = document_errors
SQL["document_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{tag}')" for m, (tag, _) in _MISTAKES.items()) + ") t(mistake, tag)"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of Asia by a two-hop document query."""
    return QUERIES["sel_fwd2"](spark, sf_dir)
