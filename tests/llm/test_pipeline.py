"""The pipeline, stage by stage, against brute force on a small corpus."""

import random
import re

import corpus_pipeline
import pytest

from quern.llm import decontam, packing, quality, registry
from tests.llm.conftest import WORDS, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """200 documents: junk, near copies, leaks, secrets; labels of three in four."""
    pick = random.Random(8)
    texts = [prose(k, pick.randint(30, 200)) for k in range(140)]
    items = [prose(5000 + k, 40) for k in range(6)]
    for k in range(20):
        words = texts[pick.randrange(100)].split(" ")
        words[pick.randrange(len(words))] = pick.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(900 + k, 60) + "\n" + items[k % 6] + "\n" + prose(950 + k, 60) for k in range(10)]
    texts += [prose(700 + k, 60) + ' token = "0123456789abcdef0123456789abcdef" and more' for k in range(10)]
    texts += [prose(800 + k, 60).upper().replace(" ", "!! ") for k in range(60)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    labels = [(k, int(k < 180), 0) for k in range(len(texts)) if k % 4]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, items


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, corpus):
    path, texts, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet")) if "quality" in name else None
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        found = {r["doc_id"]: r["text"] for r in docs.collect()}
        if "quality" in name:
            kept = {k: t for k, t in kept.items() if model.score([t.encode()])[0] >= 0.5}
            assert not any(k >= 180 for k in kept) and all(k in kept for k in range(180))  # junk goes, clean documents stay
        elif "near" in name:
            sets = {k: shingles(t) for k, t in kept.items()}
            label = {k: k for k in kept}
            for a in kept:
                for b in kept:
                    both = len(sets[a] & sets[b])
                    if b < a and both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                        low, high = sorted((label[a], label[b]))
                        label = {k: low if x == high else x for k, x in label.items()}
            kept = {k: t for k, t in kept.items() if label[k] == k}
        elif "contamination" in name:
            kept = {k: t for k, t in kept.items() if not any(decontam.normal(i) in decontam.normal(t) for i in items)}
        else:
            kept = {k: re.sub(r'token = "[0-9a-f]{32}', "[assign]", t) for k, t in kept.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        assert found == kept, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in pieces} == set(kept) and all(r["offset"] + r["length"] <= packing.MAX_TOKENS for r in pieces)


def test_run(spark, corpus):
    path, _, _ = corpus
    rows = corpus_pipeline.run(spark, path).collect()
    assert len({r["doc_id"] for r in rows}) > 100 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert registry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in registry.oracle_sql()
