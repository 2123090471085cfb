"""Cases of the reviewer's findings, against brute force."""

import random
import textwrap

import numpy as np
import pytest

from quern.llm import licenses, neardup


def group_components(sets, percent):
    """Component labels by comparing every pair, and by the operator's group comparison."""
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    found = list(range(len(sets)))
    flat = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    everything = np.ones(len(sets), bool)
    for name, root in neardup.link_group(np.arange(len(sets)), everything, flat, sizes, percent):
        found[name] = root
    return label, found


def test_links_of_overtaken_components():
    """Links 0-1, 1-3, 2-3 and 2-4: the component of 2 overtakes that of 0 before 1-3 is seen."""
    version = lambda k: set(range(10 * k, 10 * k + 100))
    label, found = group_components([version(k) for k in (0, 1, 3, 2, 4)], 80)
    assert found == label == [0] * 5


def test_chains_of_versions():
    """Versions linked with the next only, in random order, some chains apart from each other."""
    pick = random.Random(1)
    for _ in range(400):
        sets = []
        for chain in range(pick.randint(1, 3)):
            sets += [set(range(1000 * chain + 10 * k, 1000 * chain + 10 * k + 100)) for k in range(pick.randint(2, 12))]
        pick.shuffle(sets)
        label, found = group_components(sets, 80)
        assert found == label


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(spark, mark):
    """Every notice, set at any width, with or without comment marks, is found."""
    texts, labels = [], []
    for label, notice in licenses.TEMPLATES:
        for width in (16, 30, 45):
            lines = textwrap.wrap(notice, width)
            assert len(lines) > 1 or len(notice) <= width
            texts.append("Some words before\n\n" + "\n".join(mark + x for x in lines) + "\n\nand some after")
            labels.append(label)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [i for i, label in enumerate(labels) if label not in rows[i]["labels"].split(",")] == []


def test_scattered_words(spark):
    """Words of a notice that stand far from each other, on lines of their own, are no notice."""
    words = licenses.words_of("Licensed under the GNU Lesser General Public License")
    text = "\n".join(w + " other" * 20 for w in words)
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "" and row["score"] == 0


def chain_texts(pick, chains, length):
    """Texts of which each is linked with the next of its chain only, in random order, and each one's chain."""
    texts = []
    for c in range(chains):
        words = [f"w{c}x{k}" for k in range(102 + 6 * length)]
        texts += [(" ".join(words[6 * k : 6 * k + 102]), c) for k in range(length)]
    pick.shuffle(texts)
    return texts


@pytest.mark.parametrize("bounds", [(128, 512), (3, 2)])
def test_chains_end_to_end(spark, monkeypatch, bounds):
    """One component for each chain, with groups in one block, in many, and dealt anew."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", bounds[0])
    monkeypatch.setattr(neardup, "OTHER_ROWS", bounds[1])
    texts = chain_texts(random.Random(bounds[0]), 40, 9)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    rows = neardup.link(df, size=3, percent=85).collect()
    least = {}
    for k, (_, c) in enumerate(texts):
        least.setdefault(c, k)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: least[c] for k, (_, c) in enumerate(texts)}


def test_crowd_in_blocks(spark, monkeypatch):
    """A crowd of near copies, some of them only linked by way of others, over many small blocks."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", 8)
    monkeypatch.setattr(neardup, "OTHER_ROWS", 8)
    pick = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for i in range(pick.randint(0, 6)):
            words[pick.randrange(len(words))] = f"y{k}z{i}"
        texts.append(words)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.link(df, size=3, percent=85).collect()}
    assert len(set(label)) > 1 and [found[k] for k in range(len(texts))] == label


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_missed_pairs(percent):
    """The number of half keys keeps the probability of a miss just at the similarity within bounds."""
    h = neardup.halves(percent)
    miss = 1 - (1 - (1 - (percent / 100) ** neardup.WIDTH) ** h) ** 2
    assert miss <= neardup.MISS * 1.01
