"""Facts are dealt over as many tasks as their number takes, however the input is dealt."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators.store import Store
from quern.sources import log as logs

NODES = {"node": {"key": [{"type": "long", "unique": "identity", "required": True}], "name": [{}], "weights": [{"type": "double", "cardinality": "many"}],
                  "tags": [{"cardinality": "many"}], "next": [{"type": "ref", "ref": {"ns": "node", "rval": "previous"}}]}}
N, SHARE = 600, 100


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(logs, "TASK_FACTS", SHARE, raising=False)


def _nodes(spark, path):
    """A chain of nodes, each with two weights and two tags, loaded from one partition."""
    ds = Store.open(spark, str(path), NODES)
    ds.insert_frame("node", spark.range(0, N, 1, 1).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id") / 2, F.lit(-0.0)).alias("weights"),
                                                           F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 7)).alias("tags")))
    known = ds.source.pairs(ds.schema.flat["node/key"]).select("e", "v")
    ds.insert_frame("node", known.select((F.col("v") - 1).alias("key"), F.col("e").alias("next")).where("key >= 0").coalesce(1))
    return ds


def _most(df, by=None):
    return df.groupBy((F.spark_partition_id() if by is None else by).alias("p")).count().agg(F.max("count")).first()[0]


def test_no_task_has_more_than_its_share(spark, tmp_path, small_tasks):
    ds = _nodes(spark, tmp_path)
    flat = ds.schema.flat
    assert _most(ds.history(), F.input_file_name()) < 2 * SHARE  # as they were written
    assert _most(ds.source.current()) < 2 * SHARE
    assert _most(ds.source.pairs(flat["node/tags"])) < 2 * SHARE
    assert _most(ds.source.wide("node", [flat["node/key"]])) < 2 * SHARE
    ds.compact()
    assert _most(ds.history(), F.input_file_name()) < 2 * SHARE
    ds.delete("node")
    assert _most(ds.history().where("not added"), F.input_file_name()) < 2 * SHARE


def test_grouping_is_done_where_the_facts_are(spark, tmp_path, small_tasks):
    """The only exchange is the one that deals the facts; nothing is sorted or grouped before it."""
    ds = _nodes(spark, tmp_path)
    for df in (ds.source.current(), ds.source.pairs(ds.schema.flat["node/weights"]), ds.source.wide("node", [ds.schema.flat["node/key"]], implied=True)):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
        assert len(exchanges) == 1 and not any("Aggregate" in line or "Sort" in line for line in plan[exchanges[0]:]), plan


@pytest.mark.parametrize("share", [SHARE, 10**9])
def test_results_do_not_depend_on_the_share(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(logs, "TASK_FACTS", share, raising=False)
    ds = _nodes(spark, tmp_path)
    before = ds.tx
    ds.delete({"node/key": ("<", 50)})
    ds.delete({"node/key": 300})  # 299 refers to it
    gone = ds.history().where("not added")
    # A node has 7 facts; its two weights are one for key 0, whose next is among those deleted.
    assert gone.count() == gone.distinct().count() == (50 * 7 - 1) + (7 + 1)
    ds.compact()
    ds.update({"node/key": ("<", 60)}, {"node/name": "young"})
    assert ds.select({"node/tags": "all"}, returns="ids").count() == N - 51
    keys = {r["key"] for r in ds.select({"node": {"next": {"tags": "all"}}}).select("node.key").collect()}
    assert keys == {k for k in range(50, N - 1) if k not in (299, 300)}
    assert ds.select({"node/name": "young"}, returns="ids").count() == 10
    assert ds.source.pairs(ds.schema.flat["node/weights"]).count() == 2 * (N - 51)
    assert ds.snapshot(before).select("node", returns="ids").count() == N
    simulated = ds.delete("node", simulate=True).after
    assert simulated.source.current().count() == 0 and ds.ids({"node/key": 299})


def test_sizes_of_older_manifests_are_counted(spark, tmp_path):
    ds = _nodes(spark, tmp_path)
    sizes = ds.log.sizes(ds.tx)
    assert sizes == {"node/key": 2 * N - 1, "node/name": N, "node/weights": 2 * N, "node/tags": 2 * N, "node/next": N - 1}
    version, manifest = ds.log.manifest()
    ds.log._put(version + 1, json.loads(json.dumps({k: v for k, v in manifest.items() if k != "sizes"})))
    assert ds.log.sizes(ds.tx) == sizes
