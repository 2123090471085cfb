"""A corpus pipeline of five of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes every stage to the shared folder and reads it back as the next
one's input, so a lost executor costs at most the stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, neardup, packing, quality, secrets
from quern.llm.common import materialise, read_table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. It learns from labelled documents
    of this stage's input."""
    return quality.accepted(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return neardup.keep_first(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; ``n_chars`` follows the text."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret redaction", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The stages learn, hash and pack; SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs
