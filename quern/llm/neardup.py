"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Method
    Two small collections of half keys of ``WIDTH`` minhashes each are computed for every distinct
    shingle set. A table key is a pair of one half key of either collection, so h * h tables of
    2 * WIDTH minhashes cost 2 * h * WIDTH minhashes; h follows from the similarity, so that a
    pair just at it is missed with probability ``MISS`` at most. Sets of equal content are one class
    from the start. Classes that share a table key are candidates and make candidate groups. They
    are contracted as the tables are gone through: after the first few tables a crowd of near copies
    is a few roots, and only distinct (root, key) rows are joined.
    In a group the full sets are compared through an inverted index, whatever the order of rows. A
    group of more than ``GROUP_ROWS`` classes or ``GROUP_SHINGLES`` shingles is dealt over blocks,
    each with the group's first class besides. Links of all blocks are put together; then
    only classes outside the group's largest component are compared with all blocks, since a
    link inside a component changes nothing. Where there are many such classes, the group is dealt
    anew first, as long as that halves their number. No pairs are listed and no link that
    joins components is lost.

Defined results: a null or empty text or one without words has no shingles and is linked with
nothing; rows of equal sets are always linked; a null id never becomes a component's id unless
all ids of the component are null, then the component's id is null; repeated rows are all returned; an empty table gives
no rows; other columns are ignored by ``link`` and kept by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialise, read_table, text_bytes, texts_of, without_ids
from quern.llm.graph import components
from quern.llm.shingles import chunks, hash_words, mix, shingles

#: Minhashes of a half key, and the probability of missing a pair just at the similarity asked for.
WIDTH, MISS = 3, 0.001
#: Tables by which candidates are contracted before all tables are looked at.
ROUNDS = 2
#: Most classes and most shingles of a block of a group; they bound a task's memory and time.
GROUP_ROWS, GROUP_SHINGLES = 128, 2_000_000
#: Most classes outside the largest component that meet a block at once.
OTHER_ROWS = 512
#: Candidate ids of at most so many rows (8 bytes each) are broadcast to pick their texts.
BROADCAST_IDS = 200_000


def halves(percent: int) -> int:
    """Half keys of either collection: a pair at the similarity shares one of a collection with
    probability 1 - (1 - s ** WIDTH) ** h, and must do so in both."""
    apart = 1 - (percent / 100) ** WIDTH
    return max(1, math.ceil(math.log(MISS / 2) / math.log(apart))) if apart > 0 else 1


def _key_names(h: int) -> list[str]:
    return [f"{side}{i}" for side in "ab" for i in range(h)]


def _sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and how many."""
    every, number = shingles(words, counts, size)
    stops = np.cumsum(number)
    parts = [np.unique(every[a:b]) for a, b in zip((stops - number).tolist(), stops.tolist())]
    return (np.concatenate(parts) if parts else every), np.fromiter(map(len, parts), np.int64, len(parts))


def _set_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: sums of two mixings of its members; 0 for an empty set."""
    out = np.zeros((2, len(sizes)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(2):
            out[k, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5 + k)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


def _half_keys(flat: np.ndarray, sizes: np.ndarray, h: int) -> list[np.ndarray]:
    seeds = np.random.default_rng(11).integers(0, 1 << 63, 2 * h * WIDTH, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out = []
    for i in range(2 * h):
        key = np.zeros(len(sizes), np.uint64)
        if len(full):
            part = np.full(len(full), i + 1, np.uint64)
            for seed in seeds[i * WIDTH : (i + 1) * WIDTH]:
                x = (flat ^ seed) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                part = mix(part + np.minimum.reduceat(x, starts))
            key[full] = part
        out.append(key.view(np.int64))
    return out


def signatures(texts: DataFrame, size: int, h: int) -> DataFrame:
    """doc_id, n_shingles, the set's key (h1, h2) and its half keys."""
    names = ["doc_id", "n_shingles", "h1", "h2", *_key_names(h)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = text_bytes(batch.column(1))
        for a, b in chunks(raw):
            flat, sizes = _sets(*hash_words(raw[a:b]), size)
            columns = [sizes, *_set_keys(flat, sizes), *_half_keys(flat, sizes, h)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return map_batches(texts, run, ", ".join(f"{n} long" for n in names))


def _groups(classes: DataFrame, h: int) -> DataFrame:
    """(class, grp): candidate groups by their smallest class, for all classes.

    An edge is kept for every contraction, so nothing that a table tells is lost: a class's root may
    be any class of its group, and the components of all edges are those of the candidates.
    """
    tables = [f"t{i}" for i in range(min(ROUNDS, h))]
    now = classes.select("class", F.col("class").alias("root"), *(F.xxhash64(f"a{i}", f"b{i}").alias(t) for i, t in enumerate(tables)))
    edges = []
    for i, table in enumerate(tables):
        least = now.groupBy(table).agg(F.min("root").alias("next"), F.max("root").alias("last")).where("next < last").select(table, "next")
        moved = materialise(now.join(least, table, "left").select("class", "root", *tables[i + 1 :], "next"), f"round{i}")
        steps = moved.where("next < root").select("root", "next").distinct()
        edges.append(steps)
        to = steps.groupBy("root").agg(F.min("next").alias("to"))
        now = moved.join(to, "root", "left").select("class", F.coalesce("to", "root").alias("root"), *tables[i + 1 :])
    roots = materialise(now.select("class", "root"), "roots")

    sides = _key_names(h)
    half = classes.join(roots, "class").select("root", F.explode(F.array(*sides[:h])).alias("ka"), F.array(*sides[h:]).alias("kbs"))
    shared = half.groupBy("ka").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least < last").select("ka")
    keys = half.join(shared, "ka", "left_semi").select("root", "ka", F.explode("kbs").alias("kb")).select("root", F.xxhash64("ka", "kb").alias("table_key"))
    keys = materialise(keys.distinct(), "tables")
    centers = keys.groupBy("table_key").agg(F.min("root").alias("next"), F.max("root").alias("last")).where("next < last").select("table_key", "next")
    edges.append(keys.join(centers, "table_key").where("next < root").select("root", "next").distinct())
    whole = components(reduce(DataFrame.union, edges), "root", "next")
    return roots.join(whole, roots["root"] == whole["node"], "left").select("class", F.coalesce("label", "root").alias("grp"))


def link_group(labels: np.ndarray, look: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """(label, least label) for the labels that links of some sets put together. Sets of one label
    are linked already; a link of two sets of which neither is to ``look`` is not searched for."""
    n = len(sizes)
    names, part = np.unique(labels, return_inverse=True)

    def linked(i: int, shared: np.ndarray) -> np.ndarray:
        return 100 * shared >= percent * (sizes + sizes[i] - shared)

    if n == 2:
        both = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
        if len(names) == 2 and 100 * both >= percent * (sizes.sum() - both):
            yield int(names[1]), int(names[0])
        return
    stops = np.cumsum(sizes)
    starts = stops - sizes
    _, member = np.unique(flat, return_inverse=True)
    order = np.argsort(member, kind="stable")
    posts = np.repeat(np.arange(n), sizes)[order]
    heads = np.searchsorted(member[order], np.arange(member.max() + 2))
    for i in np.flatnonzero(look).tolist():
        if (part == part[i]).all():
            continue
        own = member[starts[i] : stops[i]]
        lengths = heads[own + 1] - heads[own]
        at = np.repeat(heads[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        found = np.unique(part[linked(i, np.bincount(posts[at], minlength=n))])
        if len(found) > 1:
            part[np.isin(part, found)] = found[0]  # the smallest, and so is its name
    label_part = np.zeros(len(names), np.int64)
    label_part[np.searchsorted(names, labels)] = part
    for name, p in zip(names.tolist(), label_part.tolist()):
        if names[p] != name:
            yield name, int(names[p])


def _compare(groups: DataFrame, percent: int) -> DataFrame:
    """(label, root): what the links of every block put together. A block's rows come one after another."""
    dealt = groups.select("grp", "i", "j", "class", "label", "look", "shingles").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple[int, int]] = []
            for group, i, j, name, label, look, members in zip(*columns):
                if (group, i, j) != key:
                    out += _finish(held, percent)
                    key, held = (group, i, j), {}
                known = held.get(name)  # a class that comes twice is one
                held[name] = (label, look or bool(known and known[1]), members)
            yield _edges(out)
        yield _edges(_finish(held, percent))

    return dealt.mapInArrow(run, "label long, root long")


def _finish(held: dict[int, tuple[int, bool, bytes]], percent: int) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    labels, look, members = zip(*held.values())
    sizes = np.fromiter((len(m) // 8 for m in members), np.int64, len(members))
    return list(link_group(np.array(labels, np.int64), np.array(look, bool), np.frombuffer(b"".join(members), np.uint64), sizes, percent))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["label", "root"])


def _member_sets(texts: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(class, grp, parts, shingles) for the candidate classes, the sets made again from the texts."""
    wanted = members.select(F.col("doc"), "class", "h1", "h2", "grp", "parts")
    # Ids and keys of a known number of rows: small enough to send along, or joined by a shuffle.
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    picked = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "class", "h1", "h2", "grp", "parts")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = text_bytes(batch.column(0))
        h1, h2 = (batch.column(k).to_numpy() for k in (2, 3))
        for a, b in chunks(raw):
            flat, sizes = _sets(*hash_words(raw[a:b]), size)
            own1, own2 = _set_keys(flat, sizes)
            same = (own1 == h1[a:b]) & (own2 == h2[a:b])  # else another text under the same id
            stops = np.cumsum(sizes)
            members = [flat[s:e].tobytes() for s, e, ok in zip(stops - sizes, stops, same) if ok]
            keep = pa.array(same)
            columns = [batch.column(k).slice(a, b - a).filter(keep) for k in (1, 4, 5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(members, pa.binary())], names=["class", "grp", "parts", "shingles"])

    return map_batches(picked, run, "class long, grp long, parts long, shingles binary")


def _dealt(sets: DataFrame, turn: int) -> DataFrame:
    """A group's sets over its blocks, the group's first class in all of them."""
    mine = F.pmod(F.xxhash64("class", F.lit(turn)), F.col("parts"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    blocks = F.explode(F.when(F.col("class") == F.col("grp"), everywhere).otherwise(F.array(mine)))
    return sets.select("grp", blocks.alias("i"), F.lit(0).cast("long").alias("j"), "class", "label", "look", "shingles")


def _crossed(sets: DataFrame) -> DataFrame:
    """Every block of a group with every part of those that are outside its largest component."""
    mine = F.pmod(F.xxhash64("class", F.lit(0)), F.col("parts"))
    part = F.pmod(F.xxhash64("class", F.lit(-1)), F.col("others"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    blocks = sets.select("grp", mine.alias("i"), F.explode(upto("others")).alias("j"), "class", "label", "look", "shingles")
    outside = sets.where("look").select("grp", F.explode(upto("parts")).alias("i"), part.alias("j"), "class", "label", "look", "shingles")
    return blocks.union(outside)


def _links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(class, root) of the verified components of all groups; classes alone may be missing."""
    sets = _member_sets(texts, members, size)
    alone = sets.withColumns({"label": F.col("class"), "look": F.lit(True)})
    if not members.where("parts > 1").limit(1).count():
        return materialise(_compare(_dealt(alone, 0), percent), "links").toDF("class", "root")
    alone = materialise(alone, "sets")
    links = materialise(_compare(_dealt(alone, 0), percent), "links")
    turn, before = 0, None
    while True:
        roots = components(links, "label", "root")
        placed = members.where("parts > 1").select("class", "grp", "n_shingles").join(roots.withColumnRenamed("node", "class"), "class", "left")
        placed = materialise(placed.select("class", "grp", "n_shingles", F.coalesce("label", "class").alias("label")), "placed")
        main = placed.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        outside = placed.join(main, "grp").withColumn("look", F.col("label") != F.col("main"))
        counts = outside.where("look").groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("n_shingles"))
        counts = materialise(counts.select("grp", "n", F.ceil(F.greatest(F.col("n") / OTHER_ROWS, F.col("n_shingles") / GROUP_SHINGLES)).alias("others")), "outside")
        total, most = counts.agg(F.sum("n"), F.max("others")).first()
        if not total:
            return roots.toDF("class", "root")
        state = outside.join(counts.select("grp", "others"), "grp").select("class", "label", "look", "others")
        sets = alone.drop("label", "look").join(state, "class")
        again = most > 1 and (before is None or 2 * total <= before)
        turn, before = turn + 1, total
        links = materialise(links.union(_compare(_dealt(sets, turn) if again else _crossed(sets), percent)), "links")
        if not again:
            return components(links, "label", "root").toDF("class", "root")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: rows are linked whose shingle sets have
    100 * intersection >= percent * union; a component's id is its smallest doc_id."""
    texts, h = texts_of(df, id_col, text_col), halves(percent)
    signed = materialise(signatures(texts, size, h), "signatures")
    first = [F.first(c).alias(c) for c in ("n_shingles", *_key_names(h))]
    grouped = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), *first)
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")

    near = materialise(_groups(classes, h), "groups")
    weigh = F.ceil(F.greatest(F.sum("n_shingles") / GROUP_SHINGLES, F.count("*") / GROUP_ROWS)).alias("parts")
    sized = near.join(classes.select("class", "doc", "h1", "h2", "n_shingles"), "class")
    weights = sized.groupBy("grp").agg(F.count("*").alias("n"), weigh).where("n > 1").select("grp", "parts")
    members = materialise(sized.join(weights, "grp"), "members")
    roots = _links(members, texts, size, percent)

    placed = classes.join(roots, "class", "left").select("h1", "h2", "doc", F.coalesce("root", "class").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = placed.join(least, "root").select("h1", "h2", "component_id")
    linked = signed.where("n_shingles > 0").join(ids, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each component, the one of the smallest id. Rows that repeat an
    id stay or go together: they stay if one of them is kept. Rows without an id stay."""
    linked = link(df, id_col, text_col, size, percent).where("doc_id is not null")
    gone = linked.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return without_ids(df, gone, id_col)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
