"""Helpers shared by the text operators: table access, shared scratch tables, batch plumbing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.log import shared_folder

# The characters 9-13 and 32, which the word contracts call white space.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; without it an error is raised. Only where all runs on
    one machine is a folder of our own made, and kept as the context's checkpoint folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (shared or shared_folder(spark)).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting the lineage.

    Later jobs, and tasks that are run again after an executor is lost, read the files instead
    of recomputing. The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


#: Ids of at most so many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``df`` without the rows whose id is in ``ids``, a table of one column; null equals null."""
    gone = materialise(ids.toDF("quern_gone").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, df[f"`{id_col}`"].eqNullSafe(gone["quern_gone"]), "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


#: Bytes of an Arrow batch that goes to a Python worker. Spark's own bound of 64 MB, several times
#: over in a worker, is too much for executors of little memory.
BATCH_BYTES = 8 << 20


def _bound_batches(df: DataFrame) -> None:
    """Lower the session's bound on batches. It stays so: plans read it when they are run, which is later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(key, "64m")
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own, null texts as empty."""
    _bound_batches(df)
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply a function of one Arrow batch. Batches are bounded in bytes and in rows; memory that
    Arrow keeps for later batches is given back at the end of a task."""
    _bound_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del batch, out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system. Workers live on after
    their tasks, and those of earlier stages would hold it for nothing."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without nulls."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()
