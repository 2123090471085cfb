"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Method
    Benchmark items are cut into overlapping windows of ``WINDOW`` characters every ``STEP``
    characters, so that a leaked part of ``WINDOW`` + ``STEP`` - 1 characters holds a whole one; items
    of at most ``WINDOW`` characters are one window. A
    window of m characters may differ from the text by e = floor(``RATE`` * m) edits. By the q-gram
    lemma a text region within e edits shares at least m - q + 1 - q * e q-grams with it, on
    diagonals at most e apart. Shared q-grams are counted in overlapping diagonal bands, each band
    as wide as to hold such a run of diagonals; bands that meet the bound are verified by an
    edit-distance alignment confined to the band, many bands at once. Characters are code points after lower-casing
    and making white space single. Items of fewer than ``LEAST`` characters allow no edits: they are
    found where they stand as they are, between other characters than letters and digits. The benchmark is taken in
    blocks of bounded size, each sent to all tasks and searched against all texts.

Defined results: a null or empty text holds nothing; null or empty items are not searched for; a null id is carried along;
repeated rows of a document give one row for each item; repeated items are reported for each of their ids; empty tables give
no rows; other columns are ignored by ``leaks`` and kept by ``clean``, for which items of fewer than ``LEAST`` characters are no
leak: a short phrase may stand anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import give_back, read_table, texts_of, without_ids

Q = 8
WINDOW, STEP = 100, 25
#: Edits in a window's characters.
RATE = 0.08
#: Fewest characters of an item that may be found with edits, and that ``clean`` removes documents for.
LEAST = 20
#: Characters of the benchmark that are searched for at once.
BLOCK_CHARS = 4_000_000

_CHUNK = 1 << 18  # characters of text at once
_TOGETHER = 512  # bands that are aligned at once
_TABLE_BITS = 22
_GAP = 0x110000  # no code point: stands between texts


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the Q = 8 characters from each place on, by doubling."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    out = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    for width, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
        out = out[:-width] * np.uint64(factor) + out[width:]
    return out * np.uint64(0xFF51AFD7ED558CCD)


def banded_distances(patterns: list[np.ndarray], texts: list[np.ndarray], lows: np.ndarray, width: int, most: np.ndarray) -> np.ndarray:
    """Fewest edits between each pattern and any part of its text on the diagonals from ``low`` on
    (text place less pattern place), ``width`` of them, or most + 1 if there are more than ``most``."""
    n, longest = len(patterns), max(map(len, patterns))
    far = (most + 1)[:, None]
    steps = np.arange(width)
    # The characters at which a band may look, from its lowest diagonal on; _GAP where there is no text.
    seen = np.full((n, longest + width), _GAP, np.uint32)
    chars = np.full((n, longest), _GAP + 1, np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    for k, (pattern, text, low) in enumerate(zip(patterns, texts, lows.tolist())):
        chars[k, : len(pattern)] = pattern
        part = text[max(0, low) : max(0, low + longest + width)]
        seen[k, max(0, -low) : max(0, -low) + len(part)] = part
    place = lows[:, None] + steps  # characters of the text used by each diagonal before the first step
    row = np.where((place >= 0) & (place <= sizes[:, None]), 0, far)  # a part may start anywhere
    lengths = np.fromiter(map(len, patterns), np.int64, n)
    for i in range(longest):
        place = place + 1
        new = np.where(place > 0, row + (seen[:, i : i + width] != chars[:, i, None]), far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where((place < 0) | (place > sizes[:, None]), far, new)
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # characters of the text alone
        new = np.where((place < 0) | (place > sizes[:, None]), far, np.minimum(new, far))
        row = np.where((i < lengths)[:, None], new, row)
    return np.minimum(row.min(1), far[:, 0])


def banded_distance(pattern: str, text: str, low: int, high: int, most: int) -> int:
    """The same for one pattern, on the diagonals ``low`` to ``high``."""
    return int(banded_distances([code_points(pattern)], [code_points(text)], np.array([low]), high - low + 1, np.array([most]))[0])


class Index:
    """The q-grams of the windows of some items."""

    def __init__(self, items: tuple[tuple[int | None, str], ...]):
        self.items = items
        self.windows: list[tuple[int, int, str]] = []  # item, start, text
        for k, (_, text) in enumerate(items):
            if len(text) >= LEAST:
                last = max(0, len(text) - WINDOW)
                self.windows += [(k, s, text[s : s + WINDOW]) for s in sorted({*range(0, last + 1, STEP), last})]
        short: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(items):
            if 0 < len(text) < LEAST:
                short.setdefault(text, []).append(k)
        self.short = ahocorasick.Automaton() if short else None
        for text, numbers in short.items():
            self.short.add_word(text, (len(text), numbers))
        if short:
            self.short.make_automaton()
        length = np.array([len(w) for _, _, w in self.windows], np.int64)
        self.edits = (RATE * length).astype(np.int64)
        # A short window's budget is cut until the bound asks for a shared q-gram at least.
        self.edits = np.minimum(self.edits, (length - Q) // Q)
        self.least = length - Q + 1 - Q * self.edits
        self.points = [code_points(w) for _, _, w in self.windows]
        found = [grams(p) for p in self.points]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        window = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found]) if found else order
        self.post_window, self.post_place = window[order], place[order]
        self.keys, self.heads = np.unique(every[order], return_index=True)
        self.heads = np.append(self.heads, len(every))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        # Bands start every ``reach`` diagonals and are twice as wide.
        self.reach = int(self.edits.max(initial=0)) + 1

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): fewest edits in a window, number of windows found, place in the normal text."""
        points = [code_points(t) for t in texts]
        gap = np.array([_GAP], np.uint32)
        starts = np.cumsum([0, *(len(p) + 1 for p in points)])[:-1]
        hashes = grams(np.concatenate([x for p in points for x in (p, gap)]))
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        slot = np.searchsorted(self.keys, hashes[at])
        slot[slot == len(self.keys)] = 0
        same = self.keys[slot] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        at, slot = at[same], slot[same]
        number = self.heads[slot + 1] - self.heads[slot]
        post = np.repeat(self.heads[slot] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        at = np.repeat(at, number)
        window, place = self.post_window[post], self.post_place[post]
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - starts[text] - place + WINDOW + STEP  # not negative
        bands: set[tuple[int, int, int]] = set()
        for shift in (0, self.reach):
            band = (diagonal + shift) // (2 * self.reach)
            # Counts by hash are never too low, and leave few bands to be counted exactly.
            key = (text * len(self.windows) + window) * np.int64(0x2545F4914F6CDD1D) + band
            slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
            full = np.flatnonzero(np.bincount(slot, minlength=1 << 18)[slot] >= self.least[window])
            bands.update((t, w, b * 2 * self.reach - shift - (WINDOW + STEP)) for t, w, b in self._bands(text[full], window[full], band[full], place[full]))
        out: dict[tuple[int, int], list] = {}

        for t, w, edits, where in self._verified(texts, points, sorted(bands)):
            best = out.setdefault((t, self.windows[w][0]), [edits, where, set()])
            best[2].add(w)
            best[:2] = min(best[:2], [edits, where])
        for t, own in enumerate(texts if self.short else []):
            for last, (size, numbers) in self.short.iter(own):
                first = last + 1 - size
                if not own[first - 1 : first].isalnum() and not own[last + 1 : last + 2].isalnum():
                    for k in numbers:
                        out.setdefault((t, k), [0, first, set()])
        return {k: (edits, len(ws), where) for k, (edits, where, ws) in out.items()}

    def _bands(self, text: np.ndarray, window: np.ndarray, band: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bands in which enough different q-grams of the window occur."""
        order = np.lexsort((place, band, window, text))
        t, w, b, p = text[order], window[order], band[order], place[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1])
        fresh = new.copy()
        fresh[1:] |= p[1:] != p[:-1]
        heads = np.flatnonzero(new)
        counts = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else heads
        good = heads[counts >= self.least[w[heads]]]
        return zip(t[good].tolist(), w[good].tolist(), b[good].tolist())

    def _verified(self, texts: list[str], points: list[np.ndarray], bands: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """Text, window, edits and place of the bands that hold their window within its budget."""
        open_bands = []
        for t, w, low in bands:
            pattern = self.windows[w][2]
            exact = texts[t].find(pattern, max(0, low), max(0, low + 2 * self.reach + len(pattern)))
            if exact >= 0:
                yield t, w, 0, exact
            else:
                open_bands.append((t, w, low))
        for at in range(0, len(open_bands), _TOGETHER):
            some = open_bands[at : at + _TOGETHER]
            budget = self.edits[[w for _, w, _ in some]]
            lows = np.array([low for *_, low in some], np.int64) - self.reach
            patterns = [self.points[w] for _, w, _ in some]
            edits = banded_distances(patterns, [points[t] for t, *_ in some], lows, 4 * self.reach, budget)
            for (t, w, low), e, most in zip(some, edits.tolist(), budget.tolist()):
                if e <= most:
                    yield t, w, e, max(0, low)


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int | None, str], ...]) -> Index:
    return Index(items)


FOUND = "doc_id long, item_id long, edits int, n_windows int, place long"


def _search(texts: DataFrame, items: tuple[tuple[int | None, str], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: list[str] = []
            first = size = 0
            for i, text in enumerate([*batch.column(1).to_pylist(), None]):
                if text is not None:
                    held.append(normal(text))
                    size += len(held[-1])
                if held and (text is None or size > _CHUNK):
                    found = index.search(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + t] for t, _ in found], pa.int64()), pa.array([items[k][0] for _, k in found], pa.int64()),
                         pa.array([v[0] for v in found.values()], pa.int32()), pa.array([v[1] for v in found.values()], pa.int32()),
                         pa.array([v[2] for v in found.values()], pa.int64())], names=["doc_id", "item_id", "edits", "n_windows", "place"])
                    held, first, size = [], i + 1, 0
        give_back()

    return texts.mapInArrow(run, FOUND)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The benchmark's items, normalised, in blocks of about BLOCK_CHARS characters."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = normal(row["text"])
        held.append((row["item_id"], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield tuple(sorted(held, key=str))
            held, size = [], 0
    if held:
        yield tuple(sorted(held, key=str))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, n_windows, place: a row for every document and item of which it holds
    a window, or a short item (n_windows is 0); fewest edits, and where that stands in the normal text."""
    texts = texts_of(docs, id_col, text_col)
    result = docs.sparkSession.createDataFrame([], FOUND)
    for items in _blocks(benchmark, item_col, item_text_col):
        result = result.union(_search(texts, items))
    order = F.struct("edits", "place", -F.col("n_windows"))
    best = result.groupBy("doc_id", "item_id").agg(F.min(order).alias("best"), F.max("n_windows").alias("n_windows"))
    return best.select("doc_id", "item_id", F.col("best.edits").alias("edits"), "n_windows", F.col("best.place").alias("place"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; rows without an id go if one of
    them holds one."""
    found = leaks(docs, benchmark, id_col, text_col).where("n_windows > 0")
    return without_ids(docs, found.select("doc_id"), id_col)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
