"""Operators against plain brute-force versions on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import decontam, html, licenses, lm, media, neardup, packing, quality, secrets, urls
from tests.llm.conftest import WORDS, prose

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets(spark):
    pick = random.Random(3)
    parts = ["token = ", "Password:", "api_key='", "secret", "AKIA", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef", "deadbeef" * 3, "x", " ", "\n", "=", "é", "login: bob", "https://db.example.com/x",
             "pwd=hunter22", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZkdI"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(200)]
    rows = {r["doc_id"]: r for r in secrets.scan(frame(spark, texts)).collect()}
    words = "password|passwd|secret|token|api_?key"
    either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)
    assign = re.compile(rf"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    linked = 0
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [f"{k}:{a}:{e}" for a, _, e, k in sorted(spans)]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in rows[i]["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
        # The links, pair by pair.
        weak = []
        for kind in secrets.KINDS:
            if not kind.strong:
                for m in re.finditer(kind.pattern, t, re.ASCII):
                    g = m[kind.group]
                    ok = kind.least <= len(g) <= kind.most and (not kind.mixed or all(re.search(c, g) for c in ("[0-9]", "[a-z]", "[A-Z]"))) and (not kind.digit or re.search("[0-9]", g))
                    if ok:
                        weak.append((m.start(), m.end(), kind.name, kind.role))
        every = weak + [(a, e, k, "id" if k == "access" else "secret") for a, _, e, k in spans]
        near = lambda p, role: any(q is not p and q[3] == role and q[1] + secrets.SCOPE > p[0] and q[0] - secrets.SCOPE < p[1] for q in every)  # noqa: E731, B023
        expected = set()
        for p in weak:
            if any(a < p[1] and e > p[0] for a, _, e, _ in spans):
                continue
            if near(p, "id") if p[3] == "secret" else near(p, "secret") if p[3] == "id" else near(p, "id") and near(p, "secret"):
                expected.add(f"{p[2]}:{p[0]}:{p[1]}")
        assert {s for s in rows[i]["spans"].split(",") if s} - set(base) == expected
        linked += len(expected)
    assert linked > 20


def test_licenses(spark):
    pick = random.Random(5)
    parts = ["CC", "by", "BY", "general", "Public", "license", "All", "rights", "reserved", "accby", "é", "x1", "released under the mit license"]
    texts = ["".join(pick.choice(parts) + pick.choice((" ", "-", ".\n", "")) for _ in range(pick.randint(0, 30))) for _ in range(150)]
    texts.append("Permission is hereby granted,\nfree of charge, to any person obtaining a copy\nof this software and associated documentation files,\nto deal in the Software without restriction")
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall(t.translate(ASCII))
        places = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({label for _, label in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        lines = [set(word.findall(x.translate(ASCII))) for x in re.split("\r\n|[\r\n]", t)]
        found = set()
        for label, notice in licenses.TEMPLATES:
            own = licenses.words_of(notice)
            tokens = set(own)
            need = math.ceil(round(licenses.THRESHOLD * len(tokens), 9))
            runs = [set(w[k : k + 2 * len(own)]) for k in range(len(w))]
            if any(len(b & tokens) >= need for b in lines + runs):
                found.add(label)
        assert set(filter(None, r["labels"].split(","))) == found | {label for _, label in places}
    assert "mit" in rows[150]["labels"]


def test_near_duplicates(spark):
    pick = random.Random(9)
    texts = [prose(k, pick.randint(1, 120)) for k in range(60)]
    for k in range(80):  # copies with edits, some of them close to the threshold
        words = texts[pick.randrange(60)].split(" ")
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(len(words))] = pick.choice(WORDS)
        texts.append(" ".join(words))
    for percent, size in ((85, 3), (80, 5)):
        rows = {r["doc_id"]: r for r in neardup.link(frame(spark, texts), size=size, percent=percent).collect()}
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(ASCII))
            sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
        label = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
        assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        missed = sum(rows[i]["component_id"] != label[i] for i in range(len(texts)))
        assert missed == 0


def test_split_group(spark, monkeypatch):
    """A group that is too large for a task is compared block by block, to the same result."""
    texts = [prose(1, 200) + " " + WORDS[k] for k in range(30)]
    whole = {(r["doc_id"], r["component_id"]) for r in neardup.link(frame(spark, texts)).collect()}
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 1000)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.link(frame(spark, texts)).collect()} == whole == {(k, 0) for k in range(30)}


def test_language_model(spark):
    texts = [prose(k, 40 + k) for k in range(60)] + ["", None]
    rows = {r["doc_id"]: r for r in lm.score(frame(spark, texts)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in tokens[i])
    total, kinds = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = rows[i]
        assert r["held_out"] == (i not in train) and r["train_tokens"] == total and r["n_tokens"] == len(w) and r["n_known"] == sum(count[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w))
        assert r["score"] < 0


@pytest.mark.parametrize("frequent", [2.0**-20, 0.008])
def test_class_model(spark, monkeypatch, frequent):
    """The scores that plain counting gives for the words' classes, with and without rare words."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "RANGE_ENTRIES", 50)  # many ranges of words
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)  # and many blocks
    monkeypatch.setattr(lm, "GROUP", 3)
    monkeypatch.setattr(lm, "HEAD", 20)
    monkeypatch.setattr(lm, "CHUNKS", 3)
    texts = [prose(k, 30 + k) for k in range(60)] + ["", None, "words seen nowhere else"]
    df = frame(spark, texts)
    fitted = lm.fit(df)
    kind, neighbour = {}, {}
    for row in lm._classed(fitted).collect():
        words = np.frombuffer(row["words"], np.int64).tolist()
        count, classes, near = lm._word_classes(row.asDict(recursive=True), fitted.model)
        for w, c, k, other in zip(words, count.tolist(), classes.tolist(), near.tolist()):
            assert kind.setdefault(w, (c, k)) == (c, k) and neighbour.setdefault(w, other) == other
    from quern.llm.shingles import hash_words

    tokens = {i: hash_words([(t or "").encode()])[0].view(np.int64).tolist() for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in tokens[i])
    assert all(kind[w][0] == count[w] for t in tokens.values() for w in t)
    assert any(n == lm.RARE for w, n in neighbour.items() if count[w]) == (frequent > 0.001)
    total, vocabulary = sum(count.values()) + len(train), len(count) + 1
    unseen = fitted.model.unseen
    of = lambda w: kind[w][1] if count[w] else unseen
    moves = np.zeros((lm.WIDTH, lm.CLASSES + 1))
    in_class, types = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for i in train:
        before = lm.EDGE
        for w in tokens[i]:
            moves[before, of(w)] += 1
            in_class[of(w)] += 1
            before = neighbour[w]
        moves[before, lm.CLASSES] += 1
    for w in count:
        types[of(w)] += 1
    assert types[unseen] == types.max()
    types[unseen] += 1
    for r in lm.score(df).collect():
        expected, before = 0.0, lm.EDGE
        for w in [*tokens[r["doc_id"]], None]:
            target = lm.CLASSES if w is None else of(w)
            move = (moves[before, target] + lm.TRANSITION) / (moves[before] + lm.TRANSITION).sum()
            inside = 1.0 if w is None else (count[w] + lm.EMISSION) / (in_class[target] + lm.EMISSION * types[target])
            plain = ((len(train) if w is None else count[w]) + 1) / (total + vocabulary + 1)
            expected += math.log10(lm.MIXTURE * move * inside + (1 - lm.MIXTURE) * plain)
            before = lm.EDGE if w is None else neighbour[w]
        assert r["score"] == pytest.approx(expected)


def test_exchange_raises_likelihood():
    """Each round of exchange, one word at a time, raises the likelihood of the class bigrams of a random text."""
    pick = np.random.default_rng(5)
    words = np.concatenate([pick.integers(0, 40, 3000) + 40 * (k % 2) for k in range(2)] * 2)
    classes = np.minimum(np.arange(80), lm.CLASSES - 1)

    def likelihood(classes):
        pairs = Counter(zip(classes[words[:-1]].tolist(), classes[words[1:]].tolist()))
        first, second = Counter(classes[words[:-1]].tolist()), Counter(classes[words[1:]].tolist())
        return sum(n * math.log(n) for n in pairs.values()) - sum(n * math.log(n) for c in (first, second) for n in c.values())

    for _ in range(3):
        counts = np.zeros((2, 80, lm.WIDTH), np.int64)
        np.add.at(counts[0], (words[1:], classes[words[:-1]]), 1)
        np.add.at(counts[1], (words[:-1], classes[words[1:]]), 1)
        new = lm.exchange(counts, classes, lm.class_bigrams(counts, classes), batch=1)
        assert likelihood(new) >= likelihood(classes)
        classes = new
    assert not set(classes[:40]) & set(classes[40:])  # words that never meet have no class in common


def test_classes_help(spark):
    """Two vocabularies that do not mix: the class model tells them apart, the unigram cannot."""
    pick = random.Random(2)
    half = [WORDS[:48], WORDS[48:]]
    texts = [" ".join(pick.choice(half[k % 2]) for _ in range(60)) for k in range(300)]
    held = [r for r in lm.score(frame(spark, texts)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", min_size=12, max_size=40), st.text("abcd ", max_size=60), st.integers(0, 5))
def test_banded_distance(pattern, text, most):
    """A band over all diagonals gives the edit distance to the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (text[j - 1] != c)))
        row = new
    assert decontam.banded_distance(pattern, text, -len(pattern), len(text), most) == min(min(row), most + 1)


def test_decontamination(spark):
    pick = random.Random(4)
    items = [prose(1000 + k, pick.choice((6, 20, 45))) for k in range(12)]
    texts, expected = [], set()
    for k in range(60):
        host = prose(k, 100)
        if k % 3 == 0:
            item = pick.randrange(12)
            leak = list(decontam.normal(items[item]))
            for _ in range(int(0.02 * len(leak))):
                leak[pick.randrange(len(leak))] = "q"
            host = host[:150] + "\n" + "".join(leak).upper() + "  \n" + host[150:]
            expected.add((k, item))
        texts.append(host)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert found == expected


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [prose(k, random.Random(k).randint(0, 1500)) for k in range(120)] + ["don't <|endoftext|> \u00c9cole \u4e2d\u6587 x\u0301 \x85a", "a" * 50_000]
    rows = packing.pack(frame(spark, texts), pieces_per_partition=40).collect()
    tokenizer = Tokenizer.from_file(packing._tokenizer_path(None))
    pieces = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            pieces[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([p[1] for p in pieces.values()], minlength=2049)
    assert packing.lower_bound(counts, 2048) <= len(sequences) <= packing.lower_bound(counts, 2048) + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound(sizes):
    """No bound exceeds what best-fit decreasing reaches, nor does it fall under the volume."""
    bins, _, free = packing.best_fit_decreasing(np.array(sizes), 20)
    bound = packing.lower_bound(np.bincount(sizes, minlength=21), 20)
    assert -(-sum(sizes) // 20) <= bound <= len(free)
    loads = np.bincount(bins, sizes)
    assert (loads <= 20).all() and (loads == 20 - free).all()


def test_media_round_trip():
    pick = np.random.default_rng(1)
    image = pick.integers(0, 256, (21, 40), np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    plain = b"P2 # a comment\n3 2\n255\n1 2 3\n4 5 6\n"
    assert media.decode(plain).tolist() == [[1, 2, 3], [4, 5, 6]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    colour = pick.integers(0, 256, (3, 2, 3), np.uint8)
    assert (media.decode(b"P6\n2 3\n255\n" + colour.tobytes()) == colour).all()
    rows = b"".join(colour[y, :, ::-1].tobytes().ljust(8, b"\0") for y in (2, 1, 0))
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (3).to_bytes(4, "little")
    bmp = head + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows
    assert (media.decode(bmp) == colour).all()
    assert media.decode(b"nothing") is None and media.decode(b"P5\n9 9\n255\nxx") is None
    small = media.area_resize(image, 3, 4)
    exact = np.array([[image[7 * y : 7 * y + 7, 10 * x : 10 * x + 10].mean() for x in range(4)] for y in range(3)])
    assert np.allclose(small, exact)
    assert np.isclose(media.area_resize(image, 8, 9).mean(), image.mean())


def test_media_tiles(spark):
    image = np.arange(70 * 40, dtype=np.int64).reshape(70, 40).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(image))), (2, None), (3, bytearray(b"no image"))], "id long, media binary")
    tiles = media.tiles(df, "id", "media").collect()
    assert {(r["doc_id"], r["tile_row"], r["tile_col"]) for r in tiles} == {(1, y, x) for y in range(3) for x in range(2)}
    import io

    for r in tiles:
        assert (np.load(io.BytesIO(r["npy"])) == image[32 * r["tile_row"] :, 32 * r["tile_col"] :][:32, :32]).all()


def test_media_query_payload(spark):
    texts = ["", "abc", "é" * 100, prose(1, 400)]
    for r in media.digest(media.store_texts(frame(spark, texts))).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_quality_held_out(spark):
    pick = random.Random(1)
    texts, labels = [], []
    for k in range(400):
        good = pick.random() < 0.7
        text = prose(k, 80)
        texts.append(text if good else text.upper().replace(" ", "!! "))
        labels.append((k, int(good), 0))
    docs = frame(spark, texts)
    rows = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) / len(held) > 0.97


def test_extraction_held_out():
    chain = html.trained_chain()
    maker = html.PageMaker(12345)
    right = total = 0
    for _ in range(150):
        blocks, truth = html.labelled(maker.page())
        right += sum(a == b for a, b in zip(truth, chain.decode(blocks)))
        total += len(blocks)
    assert right / total > 0.97


def test_viterbi_is_best():
    """The decoded path has the highest score of all paths."""
    chain = html.trained_chain()
    blocks = html.labelled(html.PageMaker(77).page())[0][:10]
    own = list(html.features(blocks))
    emission = [chain.emission(b, f) for b, f in zip(blocks, own)]
    score = lambda path: sum(e for e, s in zip(emission, path) if s) + sum(chain.moves[a][b] for a, b in zip(path, path[1:]))
    best = max((tuple(n >> k & 1 for k in range(len(blocks))) for n in range(1 << len(blocks))), key=score)
    assert score(chain.decode(blocks)) == pytest.approx(score(best))


def test_extraction_text():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
            "<div class='ad'>Buy now, it is cheap.</div><article><h1>A  title</h1><p>One &amp; two\n three.<br><p>Second <b>bold</b> text, long enough to be one.</p>"
            "<script>x='</p>'</script><aside><p>Related stories you may like to read.</p></aside><p>Last&nbsp;one of the article.</p></article>"
            "<section class='comments'><p>First! I do not agree with this at all.</p></section><footer>&copy; someone</footer></body></html>")
    assert html.main_text(page, html.trained_chain()) == "A title\nOne & two three.\nSecond bold text, long enough to be one.\nLast one of the article."


def test_url_tree(spark):
    """The templates and verdicts that a plain walk over the same counts gives."""
    pick = random.Random(6)
    hosts = ["a.example.com", "www.example.com", "b.net", "c.org"]
    given = [f"https://{pick.choice(hosts)}/{pick.choice(('en', 'es', 'fr', 'x'))}/{pick.choice(('', pick.choice(WORDS), str(pick.randint(1, 99))))}" for _ in range(600)]
    rows = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()}
    counts = {}
    for i, u in enumerate(given):
        host, path = re.match(r"https://([^/]*)(.*)", u).groups()
        fits = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[1]), default=None)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule[1])
        form = tuple(re.sub("[0-9]+", "{n}", path)[1:].split("/"))
        c = counts.setdefault((host, form), [0, 0, 0])
        c[0] += 1
        c[1 if rule and rule[0] == "allow" else 2] += bool(rule)
    place = {k: () for k in counts}
    for d in range(2):
        nodes = {}
        for (host, form), t in place.items():
            branch = nodes.setdefault((host, t), {}).setdefault(form[d], [0, 0, 0])
            for j in range(3):
                branch[j] += counts[host, form][j]
        merged = set()
        for node, branches in nodes.items():
            n, good, bad = (sum(b[j] for b in branches.values()) for j in range(3))
            for seg, b in branches.items():
                mine, other = b[1] + b[2], good + bad - b[1] - b[2]
                m = math.log(2 / urls.CONFIDENCE) / 2
                similar = min(mine, other) >= urls.LEAST_LABELLED and abs(b[2] / mine - (bad - b[2]) / other) <= math.sqrt(m / mine) + math.sqrt(m / other)
                if similar or len(branches) > urls.BRANCHES and len(branches) > urls.VARIETY * n:
                    merged.add((*node, seg))
        place = {(h, f): (*t, "*" if (h, t, f[d]) in merged else f[d]) for (h, f), t in place.items()}
    def share(h, t):
        """A template's bad share, smoothed towards the one above it."""
        inside = [counts[k] for k, own in place.items() if k[0] == h and own[: len(t)] == t]
        above = share(h, t[:-1]) if t else urls.PRIOR
        return (sum(c[2] for c in inside) + urls.PSEUDO * above) / (sum(c[1] + c[2] for c in inside) + urls.PSEUDO)

    for r in rows.values():
        t = place[r["host"], tuple(re.sub("[0-9]+", "{n}", r["path"])[1:].split("/"))]
        assert r["template"] == "/" + "/".join(t) and r["bad_share"] == pytest.approx(share(r["host"], t))
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["bad_share"] >= urls.REJECT else "allow")
