"""Best-fit packing of documents into fixed-length token sequences, with bound certificates.

Method
    1. Documents are tokenised; only those longer than a sequence are cut into pieces.
    2. Pieces are dealt to partitions of a bounded number of pieces. Each partition runs
       best-fit decreasing and computes the best of a family of dual-feasible-function lower
       bounds on its bin count. A partition whose bin count equals its bound is certified.
    3. Bins that are nearly full stay, the more so in a certified partition. The pieces of all other
       bins go into a pool that is dealt anew to fewer partitions, so that partitions with gaps
       exchange documents, and best-fit decreasing runs again, until one partition holds the pool or
       a round leaves more than ``PROGRESS`` of it. ``certificate`` holds the result against the
       bound on all pieces.

Defined results: a null text is an empty one (a single piece: the end id alone); a null id is
carried along; repeated rows are packed as often as they occur; an empty table gives no rows;
columns other than the two named are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialise, read_table, text_bytes, texts_of

MAX_TOKENS = 2048
END_ID = 0
TOKENIZER_FILE = "word_bpe_49k.json"
#: Pieces that one packing task holds; bounds its memory.
PIECES_PER_PARTITION = 40_000
#: A bin keeps its pieces for another round if more than capacity // CERTIFIED_GAP of it is free. In
#: a partition that is not certified, more than capacity // OPEN_GAP is enough.
CERTIFIED_GAP, OPEN_GAP = 64, 512
#: Share of a round's pieces that may go on to another round.
PROGRESS = 0.75
#: Entries of a tokeniser worker's young and of its old word cache.
CACHE_WORDS = 400_000
#: Longer words (bytes) go to the tokeniser library: a merge on arrays takes a pass for each merge of a word.
LONG_WORD = 256

#: What the array path leaves to the tokeniser library: anything but visible Latin characters,
#: U+0130 (its lower case is two code points), and what may start a special token.
ODD = re.compile("[^\n\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]|<\\|")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class PairMerger:
    """Byte-pair merging of many pre-tokens at once, on arrays.

    Every round merges, in every pre-token that still has one, the leftmost pair of the lowest
    rank - the order in which byte-pair encoding merges a single pre-token.
    """

    NONE = np.int64(1 << 62)

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        shown = _byte_characters()
        self.inner = np.array([vocabulary[c] for c in shown], np.int64)
        self.final = np.array([vocabulary[c + "</w>"] for c in shown], np.int64)
        self.size = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # Two hash tables of ranks: what collides in the first is in the second, without collision.
        self.keys = np.append(keys, -1)
        self.first, rest = self._place(keys, np.arange(len(keys)), 21, 0x9E3779B97F4A7C15)
        multiplier = 0xC2B2AE3D27D4EB4F
        while True:
            self.second, left = self._place(keys, rest, 18, multiplier)
            if not len(left):
                break
            multiplier += 2
        self.multipliers = (np.uint64(0x9E3779B97F4A7C15), np.uint64(multiplier))

    @staticmethod
    def _place(keys: np.ndarray, which: np.ndarray, bits: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
        slots = (keys[which].view(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - bits)
        _, kept = np.unique(slots, return_index=True)
        table = np.full(1 << bits, len(keys), np.int32)
        table[slots[kept]] = which[kept]
        return table, np.delete(which, kept)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges if it is none."""
        unsigned, none = keys.view(np.uint64), len(self.keys) - 1
        found = self.first[unsigned * self.multipliers[0] >> np.uint64(43)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        again = self.second[unsigned[wrong] * self.multipliers[1] >> np.uint64(46)]
        again[self.keys[again] != keys[wrong]] = none
        found[wrong] = again
        return found

    def __call__(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty pre-tokens, whose bytes are given one after another, and how many
        each one has."""
        last = np.cumsum(lengths) - 1
        symbols = self.inner[raw]
        symbols[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            rank = self.ranks(symbols * self.size + np.append(symbols[1:], 0)).astype(np.int64)
            rank[np.append(new[1:], len(symbols)) - 1] = len(self.merged)  # no pair across pre-tokens
            best = np.minimum.reduceat((rank << 32) + np.arange(len(symbols)), new)
            merges = best >> 32 < len(self.merged)
            at = best[merges] & 0xFFFFFFFF
            symbols[at] = self.merged[best[merges] >> 32]
            live = np.repeat(merges, np.diff(np.append(new, len(symbols))))
            done.append((owner[~live], symbols[~live]))
            live[at + 1] = False
            owner, symbols = owner[live], symbols[live]
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([s for _, s in done])[order] if done else owners
        return ids.astype("<u4"), np.bincount(owners, minlength=len(lengths))


def _byte_characters() -> list[str]:
    """The printable character by which a byte-level vocabulary shows each byte: the byte's own
    Latin-1 character if that is visible, else the next one from U+0100 on."""
    shown, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            shown.append(chr(b))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


class WordTokeniser:
    """Token ids of whole texts through a cache of white-space-separated words.

    No token of this tokeniser spans ASCII white space, so a text's ids are those of its words
    in order. Unseen words of printable Latin characters are merged together on arrays; all others,
    and words of more than ``LONG_WORD`` bytes, go to the tokeniser library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.pattern = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.merge = PairMerger(model["model"]["vocab"], merges)
        self.cache_words = cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Make every one of the words known to the young cache."""
        if len(self.young) > self.cache_words:
            self.old, self.young = self.young, {}
        missing = words.difference(self.young)
        if self.old:
            again = [w for w in missing if w in self.old]
            self.young.update((w, self.old[w]) for w in again)
            missing.difference_update(again)
        own = [w for w in missing if len(w) <= LONG_WORD]
        other = [w for w in missing if len(w) > LONG_WORD] if len(own) < len(missing) else []
        if ODD.search(b"\n".join(own).decode()):
            texts = [w.decode() for w in own]
            other += [w for w, t in zip(own, texts) if ODD.search(t)]
            own = [w for w, t in zip(own, texts) if not ODD.search(t)]
        for i in range(0, len(other), 4096):
            some = [w.decode() for w in other[i : i + 4096]]
            for w, e in zip(other[i : i + 4096], self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self.young[w] = np.array(e.ids, dtype="<u4").tobytes()
        if own:
            self._merge_words(own)

    def _merge_words(self, words: list[bytes]) -> None:
        tokens = self.pattern.findall(b"\n".join(words).decode().lower())
        data = np.frombuffer("\n".join(tokens).encode(), np.uint8)
        # Between pre-tokens there is one line feed; a pre-token that is one marks the end of a word.
        breaks = np.flatnonzero(data == 10)
        feeds = np.array([t == "\n" for t in tokens])
        inner = np.ones(len(data), bool)
        inner[breaks] = False
        stops = np.append(np.cumsum(inner)[breaks], inner.sum())
        lengths = np.diff(stops, prepend=0)
        lengths = lengths[lengths > 0]
        ids, sizes = self.merge(data[inner], lengths)
        per_word = np.diff(np.append(np.flatnonzero(feeds), len(tokens)), prepend=-1) - 1
        ends = (np.append(0, np.cumsum(sizes))[np.cumsum(per_word)] * 4).tolist()
        raw = ids.tobytes()
        self.young.update(zip(words, (raw[i:j] for i, j in zip([0, *ends], ends))))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 2048):
            split = [t.split() for t in texts[at : at + 2048]]
            self.learn(set().union(*split))
            get = self.young.__getitem__
            for words in split:
                yield b"".join(map(get, words))


_TOKENISERS: dict[str, WordTokeniser] = {}


def _tokeniser(path: str) -> WordTokeniser:
    if path not in _TOKENISERS:
        _TOKENISERS[path] = WordTokeniser(path)
    return _TOKENISERS[path]


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def tokenise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
             tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _tokeniser(_tokenizer_path(tokenizer_path))
        texts = text_bytes(batch.column(1))
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                part = ids[at : at + 4 * max_tokens]
                for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(texts_of(df, id_col, text_col), pieces, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best dual-feasible-function lower bound on the bins for ``counts[s]`` items of size s.

    Families: the identity (volume); for each threshold, u_t, which rounds sizes over
    capacity - t up to a whole bin and sizes under t down to nothing; and, for each k, the
    rounding f_k(x) = floor((k + 1) x / c) / k where (k + 1) x / c is no integer, else x / c.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    volume = n * sizes
    best = int(-(-volume.sum() // capacity))
    whole = np.cumsum(n[::-1])[::-1]  # items of this size or more
    above = np.cumsum(volume)
    for t in sizes[sizes <= capacity // 2].tolist():
        big = np.searchsorted(sizes, capacity - t, side="right")
        low = np.searchsorted(sizes, t)
        middle = (above[big - 1] if big else 0) - (above[low - 1] if low else 0)
        best = max(best, int((whole[big] if big < len(sizes) else 0) + -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        weight = np.where(exact, sizes * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, int(-(-(n * weight).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset of each item, and the bins' free space. Open bins are kept by free space."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present: list[int] = []  # sorted distinct free spaces that have a bin
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(present, size)
        if at < len(present):
            space = present[at]
            b = by_free[space].pop()
            if not by_free[space]:
                present.pop(at)
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        space -= size
        free[b] = space
        if space:
            if not by_free[space]:
                insort(present, space)
            by_free[space].append(b)
    return bins, offsets, np.array(free, np.int64)


def _pack_round(pieces: DataFrame, partitions: int, capacity: int, level: int, last: bool) -> DataFrame:
    """Deal the pieces to partitions and pack each one. Bins with a gap are not ``done`` unless
    this round is the last."""
    names = pieces.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).select(names).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        certified = len(free) == bound
        gap = free > capacity // (CERTIFIED_GAP if certified else OPEN_GAP)
        done = np.ones(len(free), bool) if last else ~gap
        number = (np.int64(level) << 56) + (np.int64(TaskContext.get().partitionId()) << 28)
        out = table.append_column("sequence_id", pa.array(number + bins)).append_column("offset", pa.array(offsets))
        out = out.append_column("done", pa.array(done[bins])).append_column("certified", pa.array(np.full(len(bins), certified)))
        yield from out.to_batches(max_chunksize=20_000)

    dealt = pieces.repartition(partitions, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)))
    return dealt.mapInArrow(pack, PACKED + ", done boolean, certified boolean")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
         tokenizer_path: str | None = None, pieces_per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """One row per piece with its sequence and its offset there, and whether the partition that
    closed the sequence was certified."""
    pieces = materialise(tokenise(df, id_col, text_col, max_tokens, tokenizer_path), "pieces")
    full = pieces.where(F.col("length") >= max_tokens).select(
        "*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"))
    result, pool, level = full, pieces.where(F.col("length") < max_tokens), 0
    count = pool.count()
    while True:
        partitions = -(-count // pieces_per_partition) or 1
        packed = materialise(_pack_round(pool, partitions, max_tokens, level, partitions == 1), f"packed{level}")
        left = 0 if partitions == 1 else packed.where("not done").count()
        if left > PROGRESS * count:  # another exchange would not help: the bins stay as they are
            packed, left = packed.withColumn("done", F.lit(True)), 0
        result = result.unionByName(packed.where("done").drop("done"))
        if not left:
            return result
        pool, count, level = packed.where("not done").select(pieces.columns), left, level + 1


def certificate(packed: DataFrame, max_tokens: int = MAX_TOKENS) -> tuple[int, int]:
    """The sequences of a packing, and the lower bound on them that holds for all pieces together."""
    sizes = packed.groupBy("length").count().collect()  # at most a row for each length
    counts = np.zeros(max_tokens + 1, np.int64)
    for row in sizes:
        counts[row["length"]] = row["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, max_tokens)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
