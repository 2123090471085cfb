"""Language-model scores by a class-based bigram model (Brown), classes found by exchange.

Method
    Words are 64-bit hashes. One pass over the texts writes blocks of whole documents, coded by a
    dictionary of the block's own words; the dictionaries' training counts, summed by word, are the
    corpus counts, and come back to the blocks that hold the word.
    Exchange clustering assigns words to ``CLASSES`` classes. Words of at least the share ``FREQUENT`` of
    all training tokens - of which there can be at most 1 / ``FREQUENT``, whatever the corpus - are moved in
    passes: tasks count how often each of them follows and precedes every class, and the
    words go to the class that most raises the likelihood of the class bigrams. In the first passes the
    ``HEAD`` most frequent words are moved, one after another; in those that follow all, by tasks for ranges of
    words, each on its own copy of the bigrams. Every rarer word of the training texts is
    then assigned, by its own neighbours in the whole corpus and the same likelihood, to a class of its own choice,
    with the corpus counts' shuffle. As a neighbour, a rare word stands for all rare ones.
    A token's probability is the transition to its class from the neighbour before it, times its share of the class,
    interpolated with the add-one unigram. Start and end of a text are a neighbour of their own. Words
    that the training texts do not have are in the class of the most different words.

Only the frequent words with their classes (nine bytes each), the class bigrams and the classes' sums come to the driver.

Defined results: a null or empty text is the end token alone; a null id is carried along, its crc32
taken of the empty string; repeated rows count and appear as often as they occur; without training
rows all counts are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import give_back, materialise, read_table, text_bytes, texts_of
from quern.llm.shingles import chunks, hash_words, mix

CLASSES = 32
#: Passes over the most frequent words alone, and over all frequent words.
HEAD_PASSES, PASSES = 2, 3
#: Least share of the training tokens of a word that takes part in the passes.
FREQUENT = 2.0**-20
#: Weight of the class model against the unigram; pseudo-counts of transitions and emissions.
MIXTURE, TRANSITION, EMISSION = 0.85, 0.1, 0.5
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: The end token's word.
END = int(mix(np.array([0xE2D], np.uint64)).view(np.int64)[0])

#: Most different words, and entries of all blocks' dictionaries, of a range of word hashes that is
#: summed at once; they bound that task's memory.
RANGE_WORDS, RANGE_ENTRIES = 250_000, 2_000_000
#: Words that one task moves one by one; ranges of the others, each counted and moved by a task; of these words so
#: many are moved at once.
HEAD, CHUNKS, BATCH = 4096, 64, 64
#: Blocks whose counts are summed together at first.
GROUP = 64
#: Neighbours: the classes, any rare word, the start or end of the text.
RARE, EDGE = CLASSES, CLASSES + 1
WIDTH = CLASSES + 2

_SAMPLED = 1023  # a word is one of the sample by which different words are counted if these bits of its hash are 0
_BLOCKS = "block long, docs array<long>, held array<boolean>, lengths array<long>, codes binary, words binary, train binary, n_words long, n_train long, sample array<long>"


def _press(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _read(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of a schema of long and binary columns; None is a column of nulls."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    n = max(len(c) for c in columns if c is not None)
    types = [pa.int64() if kind == "long" else pa.binary() for kind in kinds]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one at a time, so that no more than one block's arrays are Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _encode(texts: DataFrame) -> DataFrame:
    """Blocks of whole documents: ids, fold, token counts, and the tokens as places in the block's
    sorted words; of those words the hashes and training counts."""

    def block_of(number: int, docs: pa.Array, held: pa.Array, raw: list[bytes]) -> pa.RecordBatch:
        hashes, lengths = [], []
        for a, b in chunks(raw):
            words, counts = hash_words(raw[a:b])
            hashes.append(np.insert(words, np.cumsum(counts), np.uint64(END % (1 << 64))))
            lengths.append(counts + 1)
        length = np.concatenate(lengths)
        words, codes = np.unique(np.concatenate(hashes).view(np.int64), return_inverse=True)
        train = np.bincount(codes, np.repeat(~held.to_numpy(zero_copy_only=False), length), len(words)).astype("<i8")
        values = [number, docs.to_pylist(), held.to_pylist(), length.tolist(), _press(codes.astype("<u4")), words.tobytes(), _press(train), len(words),
                  int(train.sum()), words[(words & _SAMPLED == 0) & (train > 0)].tolist()]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.int64()] * 2, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw = text_bytes(batch.column(2))
            at = size = 0
            for i in range(len(raw) + 1):
                if i > at and (i == len(raw) or size + len(raw[i]) > BLOCK_BYTES):
                    yield block_of(number, batch.column(0).slice(at, i - at), batch.column(1).slice(at, i - at), raw[at:i])
                    number, at, size = number + 1, i, 0
                if i < len(raw):
                    size += len(raw[i])
        give_back()

    return texts.mapInArrow(run, _BLOCKS)


def _dealt(blocks: DataFrame, ranges: int, entries: Callable[[dict], tuple[np.ndarray, Callable[[int, int], bytes]]], add: Callable[[int, list], Iterator[pa.RecordBatch]],
           schema: str) -> DataFrame:
    """For every block its sorted words, and what is to be said of those from one place to another, go to
    the task of their range of hashes, all of a range's at once to ``add``: (block, words, data)."""
    edges = np.array([-(1 << 63) + (i << 64) // ranges for i in range(1, ranges)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, data = entries(row)
            cuts = [0, *np.searchsorted(words, edges).tolist(), len(words)]
            some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if some:
                yield _batch("part long, block long, words binary, data binary",
                             [[i for i, _, _ in some], [row["block"]] * len(some), [words[a:b].tobytes() for _, a, b in some], [data(a, b) for _, a, b in some]])
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for number, block, words, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number != part and held:
                    yield from add(part, held)
                    held = []
                part = number
                held.append((block, np.frombuffer(words, np.int64), data))
        if held:
            yield from add(part, held)
        give_back()

    dealt = blocks.mapInArrow(deal, "part long, block long, words binary, data binary")
    return dealt.repartition(min(ranges, 10_000), "part").sortWithinPartitions("part").mapInArrow(run, schema)


_COUNTED = "block long, part long, totals binary, words binary, counts binary, tokens long, types long"


def _corpus_counts(blocks: DataFrame, ranges: int, least: int) -> DataFrame:
    """Rows of two kinds: (block, part, totals), the corpus training counts of the block's words of
    one range of hashes; and (words, counts, tokens, types), of a range the words of at least so
    many training tokens, its training tokens and its different words."""

    def entries(row: dict) -> tuple[np.ndarray, Callable]:
        counts = _read(row["train"], "<i8")
        return np.frombuffer(row["words"], np.int64), lambda a, b: _press(counts[a:b])

    def add(part: int, held: list) -> Iterator[pa.RecordBatch]:
        words, place = np.unique(np.concatenate([w for _, w, _ in held]), return_inverse=True)
        totals = np.bincount(place, np.concatenate([_read(data, "<i8") for *_, data in held]), len(words)).astype("<i8")
        ends = np.cumsum([len(w) for _, w, _ in held])
        packed = [_press(totals[place[e - len(w) : e]]) for (_, w, _), e in zip(held, ends)]
        yield _batch(_COUNTED, [[block for block, *_ in held], [part] * len(held), packed, None, None, None, None])
        often = (totals >= least) & (words != END)
        yield _batch(_COUNTED, [None, [part], None, [words[often].tobytes()], [totals[often].tobytes()], [int(totals.sum())], [int((totals > 0).sum())]])

    return _dealt(blocks.select("block", "words", "train"), ranges, entries, add, _COUNTED)


@dataclass
class Frequent:
    """The frequent words: hashes, sorted, and the rank of each; counts and classes by rank."""

    words: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(words: np.ndarray, counts: np.ndarray) -> Frequent:
        """Ranked by count. The first words have a class each, all others share the last."""
        order = np.lexsort((words, -counts))
        by_hash = np.argsort(words[order])
        return Frequent(words[order][by_hash], by_hash, counts[order], np.minimum(np.arange(len(words)), CLASSES - 1))

    def places(self, words: np.ndarray) -> np.ndarray:
        """The ranks of the words; the number of frequent words for all others."""
        n = len(self.words)
        if not n:
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.words, words)
        at[at == n] = 0
        return np.where(self.words[at] == words, self.ranks[at], n)

    def bounds(self) -> np.ndarray:
        """The ranks at which the chunks of words begin, and the last one's end."""
        n = len(self.words)
        if n <= HEAD:
            return np.array([0, n])
        return np.unique(np.append(np.arange(HEAD, n, -(-(n - HEAD) // CHUNKS)), (0, n)))

    def neighbours(self, places: np.ndarray) -> np.ndarray:
        return np.append(self.classes, RARE)[places]


def _neighbours(row: dict, kind: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token the neighbour before and after it, and whether it is an end. ``kind``: what each
    of the block's words is as a neighbour."""
    own = kind[codes]
    ends = np.zeros(len(codes), bool)
    ends[np.cumsum(row["lengths"]) - 1] = True
    own[ends] = EDGE
    before = np.empty_like(own)
    before[0], before[1:] = EDGE, own[:-1]  # every text ends with the end token, which opens the next
    after = np.append(own[1:], EDGE)
    return before, after, ends


def _cells(codes: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word * WIDTH + neighbour, sorted, and how often."""
    every = np.bincount(codes * WIDTH + other, minlength=n * WIDTH)
    found = np.flatnonzero(every)
    return found, every[found]


def _count_pass(blocks: DataFrame, frequent: Frequent, groups: int) -> DataFrame:
    """(chunk, counts): of the frequent words of a chunk how often each
    comes after and before every neighbour, as an array (2, words, WIDTH). What the tasks count is summed in
    so many groups of tasks first, since all of them have the most frequent words."""
    bounds = frequent.bounds()

    def merged(parts: list) -> list:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() % groups
        held: list[list] = [[], []]
        for row in _rows(batches):
            codes = _read(row["codes"], "<u4").astype(np.int64)
            places = frequent.places(np.frombuffer(row["words"], np.int64))
            before, after, ends = _neighbours(row, frequent.neighbours(places), codes)
            train = np.repeat(~np.array(row["held"], bool), row["lengths"]) & ~ends & (places[codes] < bounds[-1])
            for side, other in enumerate((before, after)):
                cells, counts = _cells(codes[train], other[train], len(places))
                held[side].append((places[cells // WIDTH] * WIDTH + cells % WIDTH, counts))
                if sum(len(k) for k, _ in held[side]) > 4_000_000:
                    held[side] = merged(held[side])
        for side in (0, 1):
            for keys, counts in merged(held[side]) if held[side] else []:
                cuts = np.searchsorted(keys, bounds * WIDTH).tolist()
                some = [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                if some:
                    yield _batch(cells_of, [
                        [c for c, _, _ in some], [group] * len(some), [side] * len(some), [_press(np.diff(keys[a:b], prepend=bounds[c] * WIDTH).astype("<u4")) for c, a, b in some],
                        [_press(counts[a:b].astype("<u4")) for _, a, b in some]])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for row in _rows(batches):
            c = row["chunk"]
            own = total.setdefault((c, row["grp"]), np.zeros((2, (bounds[c + 1] - bounds[c]) * WIDTH), np.int64))
            own[row["side"]][np.cumsum(_read(row["cells"], "<u4").astype(np.int64))] += _read(row["counts"], "<u4")
        for (chunk, _), counts in total.items():
            yield _batch("chunk long, counts binary", [[chunk], [_press(counts)]])
        give_back()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            total[row["chunk"]] = total.get(row["chunk"], 0) + _read(row["counts"], "<i8")
        for chunk, counts in total.items():
            yield _batch("chunk long, counts binary", [[chunk], [_press(counts)]])
        give_back()

    cells_of, n = "chunk long, grp long, side long, cells binary, counts binary", len(bounds) - 1
    partial = blocks.select("held", "lengths", "codes", "words").mapInArrow(count, cells_of)
    summed = partial.repartition(min(n * groups, 10_000), "chunk", "grp").mapInArrow(add, "chunk long, counts binary")
    if groups > 1:
        summed = summed.repartition(n, "chunk").mapInArrow(fold, "chunk long, counts binary")
    return materialise(summed, "neighbours")


def class_bigrams(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """grid[k, l]: how often neighbour l comes after neighbour k, one of the two being a class."""
    out = np.zeros((WIDTH, WIDTH))
    np.add.at(out, classes, counts[1])
    above = np.zeros((CLASSES, 2))
    np.add.at(above, classes, counts[0][:, CLASSES:])
    out[CLASSES:, :CLASSES] = above.T
    return out


def _per_chunk(counted: DataFrame, bounds: np.ndarray, function: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The first word of each chunk and what the function makes of its counts (2, words, WIDTH), in a task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = int(bounds[row["chunk"]])
            yield _batch("start long, made binary", [[at], [function(_read(row["counts"], "<i8").reshape(2, -1, WIDTH), at).astype("<f8").tobytes()]])

    for row in counted.repartition(len(bounds) - 1, "chunk").mapInArrow(run, "start long, made binary").collect():  # a row for each chunk
        yield row["start"], np.frombuffer(row["made"], "<f8")


def _grid(counted: DataFrame, frequent: Frequent) -> np.ndarray:
    classes = frequent.classes
    part = lambda counts, at: class_bigrams(counts, classes[at : at + counts.shape[1]])
    return sum((made.reshape(WIDTH, WIDTH) for _, made in _per_chunk(counted, frequent.bounds(), part)), np.zeros((WIDTH, WIDTH)))


def _log(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(counts: np.ndarray, classes: np.ndarray, grid: np.ndarray, batch: int = 1) -> np.ndarray:
    """One round: words, most frequent first and one or a batch at a time, go to the class that most raises the
    likelihood of the class bigrams. ``counts`` (2, words, WIDTH), how often a word comes after and before
    each neighbour; ``grid`` the class bigrams, in which these words' own counts are."""
    classes, grid = classes.copy(), grid.copy()
    order = np.argsort(-counts.sum((0, 2)), kind="stable")
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        came, went, old = counts[0, some].astype(float), counts[1, some].astype(float), classes[some]
        each = np.arange(len(some))
        rows = np.repeat(grid[None, :CLASSES], len(some), 0)
        columns = np.repeat(grid[:, :CLASSES].T[None], len(some), 0)
        # The word's own counts go out of its class first.
        rows[each, old] -= went
        rows[each, :, old] -= came[:, :CLASSES]
        columns[each, old] -= came
        columns[each, :, old] -= went[:, :CLASSES]
        gain = (_log(rows + went[:, None]) - _log(rows)).sum(2) + (_log(columns + came[:, None]) - _log(columns)).sum(2)
        row, column = rows.sum(2), columns.sum(2)
        gain -= _log(row + went.sum(1)[:, None]) - _log(row) + _log(column + came.sum(1)[:, None]) - _log(column)
        new = gain.argmax(1)
        new = np.where(gain[each, new] > gain[each, old] + 1e-9, new, old)
        np.subtract.at(grid, old, went)
        np.add.at(grid, new, went)
        np.subtract.at(grid.T, old, came)
        np.add.at(grid.T, new, came)
        classes[some] = new
    return classes


def cluster(blocks: DataFrame, frequent: Frequent, groups: int) -> np.ndarray:
    """Give the frequent words their classes; returns the class bigrams."""
    if not len(frequent.words):
        return np.zeros((WIDTH, WIDTH))
    counted = _count_pass(blocks, frequent, groups)
    for number in range(HEAD_PASSES + PASSES):
        grid, now = _grid(counted, frequent), frequent.classes
        head = number < HEAD_PASSES

        def move(counts: np.ndarray, at: int, now: np.ndarray = now, grid: np.ndarray = grid, head: bool = head) -> np.ndarray:
            own = now[at : at + counts.shape[1]]
            return own if head and at else exchange(counts, own, grid, BATCH if at else 1)

        moved = now.copy()
        for start, made in _per_chunk(counted, frequent.bounds(), move):
            moved[start : start + len(made)] = made
        frequent.classes = moved
        counted = _count_pass(blocks, frequent, groups)
    return _grid(counted, frequent)


def assign(came: np.ndarray, went: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each rare word (words, WIDTH): the one that makes its neighbours likeliest, by smoothed class bigrams."""
    after = np.log((grid[:CLASSES] + TRANSITION) / (grid[:CLASSES] + TRANSITION).sum(1, keepdims=True))
    before = np.log((grid[:, :CLASSES] + TRANSITION) / (grid[:, :CLASSES] + TRANSITION).sum(1, keepdims=True))
    mass = np.log(grid[:, :CLASSES].sum(0) + 1)
    return (went @ after.T + came @ before - came.sum(1)[:, None] * mass).argmax(1)


_RARE = "block long, part long, classes binary, moves binary, tokens binary, types binary"


def _rare_classes(blocks: DataFrame, ranges: int, frequent: Frequent, grid: np.ndarray) -> DataFrame:
    """(block, part, classes): the classes of the block's rare words of one range, in their order; and for each range the sums of its rare words by class: moves (WIDTH, CLASSES), tokens, types."""
    n = len(frequent.words)

    def entries(row: dict) -> tuple[np.ndarray, Callable]:
        codes = _read(row["codes"], "<u4").astype(np.int64)
        words = np.frombuffer(row["words"], np.int64)
        places = frequent.places(words)
        before, after, ends = _neighbours(row, frequent.neighbours(places), codes)
        train = np.repeat(~np.array(row["held"], bool), row["lengths"]) & ~ends
        rare = (places == n) & (words != END)
        train &= rare[codes]
        number = np.cumsum(rare) - 1
        found = [_cells(number[codes[train]], other[train], int(rare.sum())) for other in (before, after)]

        def data(a: int, b: int) -> bytes:
            out = []
            for cells, counts in found:
                i, j = np.searchsorted(cells, (a * WIDTH, b * WIDTH))
                out += [(cells[i:j] - a * WIDTH).astype("<u4"), counts[i:j].astype("<u4")]
            sizes = np.array([len(out[0]), len(out[2])], "<u4")
            return _press(np.concatenate([sizes, *out]))

        return words[rare], data

    def add(part: int, held: list) -> Iterator[pa.RecordBatch]:
        words, place = np.unique(np.concatenate([w for _, w, _ in held]), return_inverse=True)
        ends = np.cumsum([len(w) for _, w, _ in held])
        keys: list[list] = [[], []]
        counts: list[list] = [[], []]
        for (_, w, data), e in zip(held, ends):
            raw = _read(data, "<u4")
            own, at = place[e - len(w) : e], 2
            for side in (0, 1):
                cells, many = raw[at : at + raw[side]].astype(np.int64), raw[at + raw[side] : at + 2 * raw[side]]
                keys[side].append(own[cells // WIDTH] * WIDTH + cells % WIDTH)
                counts[side].append(many)
                at += 2 * int(raw[side])
        keys, counts = [np.concatenate(k) for k in keys], [np.concatenate(c) for c in counts]
        orders = [np.argsort(k, kind="stable") for k in keys]
        keys, counts = [k[o] for k, o in zip(keys, orders)], [c[o] for c, o in zip(counts, orders)]
        classes = np.empty(len(words), np.int64)
        moves, tokens, types = np.zeros((WIDTH, CLASSES)), np.zeros(CLASSES), np.zeros(CLASSES)
        for a in range(0, len(words), 16_384):
            b = min(a + 16_384, len(words))
            both = []
            for side in (0, 1):
                i, j = np.searchsorted(keys[side], (a * WIDTH, b * WIDTH))
                both.append(np.bincount(keys[side][i:j] - a * WIDTH, counts[side][i:j], (b - a) * WIDTH).reshape(b - a, WIDTH))
            own = classes[a:b] = assign(*both, grid)
            np.add.at(moves.T, own, both[0])
            np.add.at(tokens, own, both[0].sum(1))
            types += np.bincount(own[both[0].any(1)], minlength=CLASSES)  # without words of held-out texts alone
        yield _batch(_RARE, [[block for block, *_ in held], [part] * len(held), [_press(classes[place[e - len(w) : e]].astype("u1")) for (_, w, _), e in zip(held, ends)],
                             None, None, None])
        yield _batch(_RARE, [None, [part], None, [moves.tobytes()], [tokens.tobytes()], [types.tobytes()]])

    return _dealt(blocks.select("block", "held", "lengths", "codes", "words", "train"), ranges, entries, add, _RARE)


@dataclass
class Model:
    """What scoring needs besides the counts and classes that come back to the blocks."""

    frequent: Frequent
    tokens: int  # of the training texts
    vocabulary: int
    moves: np.ndarray  # probabilities from the neighbour before (WIDTH) to the class or, last, the end
    below: np.ndarray  # of each class its smoothed tokens
    unseen: int  # class of words that the training texts do not have


@dataclass
class Fitted:
    """A model, the coded blocks, and (block, part, totals) and (block, part, classes) of their words."""

    model: Model
    blocks: DataFrame
    totals: DataFrame
    rare: DataFrame


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> Fitted:
    """Learn from the documents whose crc32 of the id is not ``held_fold``; code all."""
    texts = texts_of(df, id_col, text_col)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    blocks = materialise(_encode(texts.select("doc_id", held.alias("held"), "text")), "coded")
    entries, tokens, n_blocks = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_train"), F.count("*")).first())
    different = (_SAMPLED + 1) * blocks.select(F.explode("sample").alias("word")).distinct().count()
    ranges = max(1, -(-different // RANGE_WORDS), -(-entries // RANGE_ENTRIES))

    counted = materialise(_corpus_counts(blocks, ranges, max(1, int(np.ceil(FREQUENT * tokens)))), "counts")
    vocabulary, words, counts = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in counted.where("words is not null").select("words", "counts", "types").toLocalIterator():  # at most 1 / FREQUENT words
        vocabulary += row["types"]
        words.append(np.frombuffer(row["words"], np.int64))
        counts.append(np.frombuffer(row["counts"], np.int64))
    frequent = Frequent.of(np.concatenate(words), np.concatenate(counts))
    grid = cluster(blocks, frequent, max(1, -(-n_blocks // GROUP)))
    rare = materialise(_rare_classes(blocks, ranges, frequent, grid), "rare")

    moves = np.zeros((WIDTH, CLASSES + 1))
    moves[:, :CLASSES] = grid[:, :CLASSES]
    in_class = np.bincount(frequent.classes, frequent.counts, CLASSES)
    types = np.bincount(frequent.classes, minlength=CLASSES).astype(float)
    for row in rare.where("moves is not null").select("moves", "tokens", "types").toLocalIterator():  # a row for each range
        moves[:, :CLASSES] += np.frombuffer(row["moves"], "<f8").reshape(WIDTH, CLASSES)
        in_class += np.frombuffer(row["tokens"], "<f8")
        types += np.frombuffer(row["types"], "<f8")
    moves[:, CLASSES] = _ends(blocks, frequent)
    unseen = int(types.argmax())
    below = in_class + EMISSION * (types + (np.arange(CLASSES) == unseen))
    smooth = moves + TRANSITION
    return Fitted(Model(frequent, tokens, vocabulary, smooth / smooth.sum(1, keepdims=True), below, unseen), blocks,
                  counted.where("block is not null").select("block", "part", "totals"), rare.where("block is not null").select("block", "part", "classes"))


def _ends(blocks: DataFrame, frequent: Frequent) -> np.ndarray:
    """How often a training text ends after each neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH, np.int64)
        for row in _rows(batches):
            codes = _read(row["codes"], "<u4").astype(np.int64)
            before, _, ends = _neighbours(row, frequent.neighbours(frequent.places(np.frombuffer(row["words"], np.int64))), codes)
            total += np.bincount(before[ends & np.repeat(~np.array(row["held"], bool), row["lengths"])], minlength=WIDTH)
        yield _batch("neighbour long, n long", [list(range(WIDTH)), total.tolist()])
        give_back()

    out = np.zeros(WIDTH)
    counted = blocks.select("held", "lengths", "codes", "words").mapInArrow(run, "neighbour long, n long")
    for row in counted.groupBy("neighbour").agg(F.sum("n").alias("n")).collect():
        out[row["neighbour"]] = row["n"]
    return out


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def _classed(fitted: Fitted) -> DataFrame:
    """The blocks with their words' corpus counts and rare classes, range after range."""
    gather = lambda df, name: df.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", name))).alias(name))
    parts = gather(fitted.totals, "totals").join(gather(fitted.rare, "classes"), "block", "left")
    return fitted.blocks.select("block", "docs", "held", "lengths", "codes", "words").join(parts, "block")


def _word_classes(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block its training count, its class, and what it is as a neighbour."""
    count = np.concatenate([_read(part["totals"], "<i8") for part in row["totals"]])
    words = np.frombuffer(row["words"], np.int64)
    places = model.frequent.places(words)
    kind = np.append(model.frequent.classes, model.unseen)[places]
    rare = (places == len(model.frequent.words)) & (words != END)
    kind[rare] = np.concatenate([np.zeros(0, np.uint8), *(_read(part["classes"], "u1") for part in row["classes"] or [])])
    kind[count == 0] = model.unseen
    return count, kind, model.frequent.neighbours(places)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """A row for every document, learned from those whose crc32 of the id is not ``held_fold``."""
    fitted = fit(df, id_col, text_col, folds, held_fold)
    model = fitted.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield scored(row)
        give_back()

    def scored(row: dict) -> pa.RecordBatch:
        codes = _read(row["codes"], "<u4").astype(np.int64)
        count, kind, neighbour = _word_classes(row, model)
        before, _, ends = _neighbours(row, neighbour, codes)
        lengths = np.array(row["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        plain = (count + 1) / (model.tokens + model.vocabulary + 1)
        inside = np.where(ends, 1.0, ((count + EMISSION) / model.below[kind])[codes])
        target = np.where(ends, CLASSES, kind[codes])
        base = np.add.reduceat(np.log10(plain)[codes], starts)
        mixed = MIXTURE * model.moves[before, target] * inside + (1 - MIXTURE) * plain[codes]
        full = np.add.reduceat(np.log10(mixed), starts)
        known = np.add.reduceat((count > 0).astype(np.int64)[codes], starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(known),
             pa.array(np.full(len(lengths), model.tokens)), pa.array(base), pa.array(full), pa.array(10 ** np.minimum(-full / lengths, 300.0))],
            names=[c.split()[0] for c in SCORES.split(", ")])

    return _classed(fitted).drop("block").mapInArrow(run, SCORES)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
