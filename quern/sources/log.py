"""The append-only log of facts: a parquet folder for each transaction and versioned manifests.

A fact is (e, a, value, tx, added). A transaction is written to a folder of its own; it exists from
the moment that a manifest names it. Manifests are numbered and created exclusively, so of two
writers that commit the same number one fails and nothing is half visible. ``Log.compact`` puts all
folders together and adds the state that they lead to, from which later reads start; no fact is
lost by it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.schema import SPARK_TYPES, Attribute, Schema
from quern.terms import DocumentError

#: The value column of each type.
COLUMN = {"string": "s", "keyword": "s", "uuid": "s", "uri": "s", "enum": "s", "long": "l", "ref": "l", "double": "d", "float": "d",
          "boolean": "b", "bigint": "i", "bigdec": "n", "instant": "t", "bytes": "x"}
VALUES = ("s", "l", "d", "b", "i", "n", "t", "x")
FACTS = T.StructType([T.StructField(name, kind) for name, kind in (
    ("e", T.LongType()), ("a", T.StringType()), ("s", T.StringType()), ("l", T.LongType()), ("d", T.DoubleType()), ("b", T.BooleanType()),
    ("i", T.DecimalType(38, 0)), ("n", T.DecimalType(38, 18)), ("t", T.TimestampType()), ("x", T.BinaryType()), ("added", T.BooleanType()))])
_LOGGED = T.StructType([*FACTS.fields, T.StructField("tx", T.LongType())])
FIRST_ID, FIRST_TX = 1_000_000, 1000
#: Facts that a task sorts. More of them are dealt over as many tasks as that takes.
TASK_FACTS = 250_000


class Facts:
    """A state of the log as a source. ``sizes`` gives the number of facts of each attribute, or more;
    without it they are not dealt anew."""

    def __init__(self, schema: Schema, facts: DataFrame, sizes: Callable[[], dict[str, int]] | None = None):
        self.schema, self.facts, self.sizes = schema, facts, sizes

    def parts(self, attributes: list[Attribute]) -> int:
        """The number of tasks for the facts of attributes; 0 if they may be dealt in any way."""
        sizes = self.sizes() if self.sizes else {}
        return parts(self.facts.sparkSession, sum(sizes.get(a.ident, 0) for a in attributes))

    def current(self, attributes: list[Attribute] | None = None, logged: bool = False) -> DataFrame:
        """The facts that hold: of each (e, a) - (e, a, value) if it may have many - the last one, if
        it was added. With ``logged``, as they stand on the log."""
        wanted = self.schema.stored() if attributes is None else attributes
        facts = self.facts.where(F.col("a").isin([a.ident for a in wanted]))
        several = [a for a in wanted if a.many]
        # Of given attributes, only the value columns of their types are carried.
        used = lambda some: [c for c in VALUES if attributes is None or c in {COLUMN[a.type] for a in some}]
        values = F.struct(*used(wanted))
        # A double in the key would be grouped as another expression than it is dealt by, so it stands there as text.
        own = F.struct(*((F.col(c) + 0.0).cast("string").alias(c) if c == "d" else F.col(c) for c in used(several))) if several else None
        facts = facts.withColumn("k", F.when(F.col("a").isin([a.ident for a in several]), own) if several else F.lit(None).cast("string"))
        if count := self.parts(wanted):
            # Dealt by the groups' key, each is whole in one task, which sorts no more than its share; nothing is grouped before.
            facts = facts.repartition(count, *(("e", "a", "k") if several else ("e",)))
        last = facts.groupBy("e", "a", "k").agg(
            F.max_by(values, F.struct("tx", "added")).alias("v"), F.max_by("added", F.struct("tx", "added")).alias("added"), F.max("tx").alias("tx"))
        last = last.where("added")
        kinds = {f.name: f.dataType for f in FACTS.fields}
        columns = [(F.col(f"v.{c}") if c in used(wanted) else F.lit(None).cast(kinds[c])).alias(c) for c in VALUES]
        return last.select("e", "a", *columns, "added", "tx") if logged else last.select("e", "a", *columns)

    def wide(self, ns: str, attributes: list[Attribute], implied: bool = False) -> DataFrame:
        # Only where an entity may be known by other attributes than the wanted ones are all of them read.
        known = attributes if implied and attributes else [a for a in self.schema.stored() if a.ns == ns]
        columns = [F.max(F.when(F.col("a") == a.ident, F.col(COLUMN[a.type]))).cast(SPARK_TYPES[a.type]).alias(a.ident) for a in attributes]
        rest = [a for a in known if a not in attributes]
        if attributes and rest and (count := self.parts(known)):
            # The other attributes only show which entities there are.
            there = self.current(rest).select("e").distinct()
            own = self.current(attributes).unionByName(there, allowMissingColumns=True).repartition(count, "e")
        else:
            own = self.current(known)
        grouped = own.groupBy(F.col("e").alias("eid"))
        return grouped.agg(*columns) if columns else grouped.agg(F.lit(1).alias("_one")).select("eid")

    def pairs(self, attribute: Attribute) -> DataFrame:
        return self.current([attribute]).select("e", F.col(COLUMN[attribute.type]).cast(SPARK_TYPES[attribute.type]).alias("v"))


class Log:
    """The files of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self._fs.exists(self._at(f"{self.path}/manifest")))

    def create(self) -> None:
        self._put(0, {"tx": FIRST_TX, "next": FIRST_ID, "times": {str(FIRST_TX): _now()}})

    def drop(self) -> None:
        self._fs.delete(self._at(self.path), True)

    def _put(self, version: int, content: dict) -> None:
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._at(f"{self.path}/manifest/{version:012d}.json"), False)
            out.write(bytearray(json.dumps(content).encode()))
            out.close()
        except Py4JJavaError as error:
            raise DocumentError("conflict", f"version {version} was committed by another writer") from error

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def manifest(self) -> tuple[int, dict]:
        last = max(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifest")) if not s.getPath().getName().startswith("."))
        return int(last.split(".")[0]), self._get(f"manifest/{last}")

    def times(self) -> dict[int, datetime]:
        """The instant of every transaction."""
        manifest = self.manifest()[1]
        older = self._get(f"times/{manifest['older']}.json") if manifest.get("older") else {}
        return {int(tx): datetime.fromisoformat(when) for tx, when in (older | manifest["times"]).items()}

    def _named(self, tx: int, history: bool) -> tuple[dict, dict[str, int], str | None]:
        """The manifest, the folders that hold facts up to a transaction, each with its last one, and the state that they go on from."""
        manifest = self.manifest()[1]
        states = {int(t): name for t, name in manifest.get("states", {}).items() if int(t) <= tx and not history}
        since = max(states, default=0)
        return manifest, {name: last for name, (first, last) in manifest.get("folders", {}).items() if first <= tx and last > since}, states.get(since)

    def facts(self, tx: int, history: bool = False) -> DataFrame:
        """The facts up to a transaction that can matter to the state then, or with ``history`` all of
        them. Only folders that hold some are read, from the last compacted state on."""
        _, folders, state = self._named(tx, history)
        paths = [f"{self.path}/facts/{name}" for name in [*folders, *([state] if state else [])]]
        if not paths:
            return self.spark.createDataFrame([], _LOGGED)
        out = self.spark.read.schema(_LOGGED).parquet(*paths)
        return out.where(F.col("tx") <= tx) if any(last > tx for last in folders.values()) else out

    def sizes(self, tx: int, history: bool = False) -> dict[str, int]:
        """The number of facts of each attribute in the folders that ``facts`` reads."""
        manifest, folders, state = self._named(tx, history)
        names = [*folders, *([state] if state else [])]
        sizes = manifest.get("sizes", {})
        unknown = [name for name in names if name not in sizes]  # of a manifest from before there were sizes
        found = [sizes[name] for name in names if name in sizes] + ([self._count(*unknown)] if unknown else [])
        return dict(sum(map(Counter, found), Counter()))

    def _count(self, *names: str) -> dict[str, int]:
        facts = self.spark.read.schema(_LOGGED).parquet(*(f"{self.path}/facts/{name}" for name in names))
        return {r["a"]: r["n"] for r in facts.groupBy("a").agg(F.count("*").alias("n")).collect()}

    def compact(self, schema: Schema) -> None:
        """All facts in one folder, the state of the last transaction in another. Attributes that the
        schema does not know keep all their facts in the state. Raises ``conflict`` if another
        writer commits meanwhile; nothing is changed then."""
        version, manifest = self.manifest()
        tx, mark = manifest["tx"], uuid.uuid4().hex
        every = self.facts(tx, history=True)
        known = [a.ident for a in schema.stored()]
        sizes = self.sizes(tx, history=True)
        count = parts(self.spark, sum(sizes.values()))
        state = Facts(schema, every, lambda: sizes).current(logged=True).unionByName(every.where(~F.col("a").isin(known)))
        for name, facts in ((f"all-{tx}-{mark}", every), (f"state-{tx}-{mark}", state)):
            facts.select(_LOGGED.names).repartitionByRange(*([count] if count else []), "a", "e").sortWithinPartitions("a", "e").write.parquet(f"{self.path}/facts/{name}")
        out = self._fs.create(self._at(f"{self.path}/times/{tx}-{mark}.json"), False)
        out.write(bytearray(json.dumps({str(t): when.isoformat(timespec="milliseconds") for t, when in self.times().items()}).encode()))
        out.close()
        self._put(version + 1, {"tx": tx, "next": manifest["next"], "times": {}, "older": f"{tx}-{mark}", "folders": {f"all-{tx}-{mark}": [FIRST_TX, tx]},
                                "states": manifest.get("states", {}) | {str(tx): f"state-{tx}-{mark}"},
                                "sizes": {name: n for name, n in manifest.get("sizes", {}).items() if name in manifest.get("states", {}).values()}
                                | {f"all-{tx}-{mark}": sizes, f"state-{tx}-{mark}": self._count(f"state-{tx}-{mark}")}})

    def commit(self, version: int, before: dict, facts: DataFrame, used: int) -> int:
        """Write the facts as the next transaction and return its number. The folder is the writer's
        own, so a writer that fails to put its manifest harms nobody."""
        tx = before["tx"] + 1
        name = f"{tx}-{uuid.uuid4().hex}"
        # Sorted by attribute, so that a query's attributes are few row groups of each file.
        facts.withColumn("tx", F.lit(tx).cast("long")).sortWithinPartitions("a", "e").write.parquet(f"{self.path}/facts/{name}")
        try:
            self._put(version + 1, before | {"tx": tx, "next": before["next"] + used, "times": before["times"] | {str(tx): _now()},
                                             "folders": before.get("folders", {}) | {name: [tx, tx]}, "sizes": before.get("sizes", {}) | {name: self._count(name)}})
        except DocumentError:
            self._fs.delete(self._at(f"{self.path}/facts/{name}"), True)
            raise
        return tx


def parts(spark: SparkSession, rows: int) -> int:
    """The number of tasks for so many facts; 0 if one can take them all."""
    return max(-(-rows // TASK_FACTS), spark.sparkContext.defaultParallelism) if rows > TASK_FACTS else 0


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage gone. The folder is the one that the
    session names in ``spark.checkpoint.dir``; only where there is none, and all runs on one machine, one of our own."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))
    return context.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A temporary folder, for a session whose executors are on this machine, with its disk."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise DocumentError("no-checkpoint-dir", "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quern-")


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


def fact_row(e: int, a: Attribute, value: Any, added: bool = True) -> tuple:
    """A fact as a row of FACTS."""
    from decimal import Decimal

    kind = COLUMN[a.type]
    if kind == "d":
        value = float(value)
    elif kind in "in":
        value = Decimal(value)
    return (e, a.ident, *(value if c == kind else None for c in VALUES), added)
