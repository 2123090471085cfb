"""Quality classifier by compression with class dictionaries.

Method
    A zstandard dictionary is trained on good and another on bad labelled text. A text is
    compressed with either; the difference of the two compressed sizes, normalised by the text's
    size and by the compressed sizes, and the compressed size itself (also normalised) enter a
    logistic calibration that is fitted on labelled texts the dictionaries have not seen.

The fit uses a bounded sample of the labelled rows: of each class the ``max_train_rows`` rows with
the smallest hash of their id among texts of at most ``max_train_bytes`` bytes. Every text is
scored whole.

Defined results: a null text is an empty one and gets a score like any other; a null id is carried
along and counts as not held out (its crc32 is taken of the empty string); labels other than 0 and
1 are ignored; a document with several labels is used once for each; without labels of both
classes every score is the add-one smoothed share of good labels; an empty table gives no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, read_table, text_bytes, texts_of

DICTIONARY_BYTES = 65_536
LEVEL = 3
#: The documented bound of the training sample, for each class.
MAX_TRAIN_ROWS = 2_000
MAX_TRAIN_BYTES = 32_768

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Model:
    """Dictionaries of the two classes and the calibration's weights; ``prior`` alone if there
    was too little to learn from."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def features(self, texts: list[bytes]) -> np.ndarray:
        import zstandard

        sizes = np.empty((3, len(texts)))
        sizes[0] = [len(t) for t in texts]
        for row, data in ((1, self.good), (2, self.bad)):
            press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False,
                                             write_checksum=False, write_dict_id=False)
            sizes[row] = [len(press.compress(t)) for t in texts]
        raw, good, bad = sizes
        return np.column_stack([np.ones(len(texts)), (bad - good) / (raw + 16), (bad - good) / (good + bad + 1),
                                np.log((good + 16) / (raw + 16))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps on standardised columns, the weights given for the columns as they are."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0, 1
    spread[spread == 0] = 1
    z = (x - mean) / spread
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + 1e-2 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    w = w / spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def fit_texts(good: list[bytes], bad: list[bytes]) -> Model:
    """Every other text of a class goes into its dictionary, the rest calibrate."""
    prior = (len(good) + 1) / (len(good) + len(bad) + 2)
    if len(good) < 2 or len(bad) < 2:
        return Model(prior=prior)
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), prior=prior)
    x = model.features(good[1::2] + bad[1::2])
    y = np.repeat([1.0, 0.0], [len(good[1::2]), len(bad[1::2])])
    return Model(model.good, model.bad, tuple(_logistic(x, y).tolist()), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train_rows: int = MAX_TRAIN_ROWS, max_train_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Learn from the labelled rows that are not held out."""
    texts = texts_of(docs, id_col, text_col)
    wanted = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = (F.xxhash64(F.col("doc_id")), F.col("doc_id"))
    # At most max_train_rows small rows of each class: safe to broadcast.
    chosen = [wanted.where(F.col("label") == label).orderBy(*order).limit(max_train_rows) for label in (0, 1)]
    sample = texts.where(F.octet_length("text") <= max_train_bytes).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = sample.toArrow()
    byte_texts = text_bytes(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    found = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("label").to_pylist(), byte_texts))
    return fit_texts([t for _, label, t in found if label == 1], [t for _, label, t in found if label == 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    texts = texts_of(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.score(text_bytes(batch.column(2)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())],
            names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(texts, run, SCORES)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [b"" if t is None else t for t in text_bytes(batch.column(at))]
        return batch.filter(pa.array(model.score(texts) >= 0.5))

    return map_batches(docs, run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
