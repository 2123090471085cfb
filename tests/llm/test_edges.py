"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import pytest

from quern.llm import decontam, html, licenses, lm, media, neardup, packing, quality, secrets, urls
from tests.llm.conftest import EDGE_TEXTS

PER_ROW = {
    "secrets": secrets.scan, "licenses": licenses.scan, "media": lambda d: media.digest(media.store_texts(d)), "lm": lm.score, "neardup": neardup.link,
    "quality": lambda d: quality.score(d, quality.fit_texts([b"good text"] * 9, [b"BAD!! BAD!!"] * 9)),
}


def key(rows):
    return sorted(map(str, (r["doc_id"] for r in rows)))


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(edge_docs, no_docs, name):
    rows = PER_ROW[name](edge_docs).collect()
    assert key(rows) == sorted(str(i) for i, _ in EDGE_TEXTS)
    by = {}
    for r in rows:  # repeated rows have repeated results
        if r["doc_id"] in (1, 7):
            assert by.setdefault(r["doc_id"], r) == r
    assert PER_ROW[name](no_docs).collect() == []


def test_secrets(edge_docs):
    rows = {r["doc_id"]: r for r in secrets.scan(edge_docs).collect()}
    assert rows[None]["n_assign"] in (0, 1) and rows[9]["n_access"] == 1 and rows[5]["spans"] == ""
    redacted = {(r["doc_id"], r["text"]) for r in secrets.redact(edge_docs).collect()}
    assert (None, "[assign]") in redacted and (2, None) in redacted and (6, "word " * 60_000) in redacted
    assert secrets.redact(edge_docs).columns == edge_docs.columns


def test_media(edge_docs):
    for r in media.digest(media.store_texts(edge_docs)).collect():
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"]) and r["media_bytes"] > r["payload_bytes"]


def test_packing(edge_docs, no_docs):
    pieces = packing.pack(edge_docs).collect()
    assert {str(r["doc_id"]) for r in pieces} == {str(i) for i, _ in EDGE_TEXTS}
    long = sorted((r["piece"], r["start"], r["length"]) for r in pieces if r["doc_id"] == 6)
    assert [s for _, s, _ in long] == [2048 * k for k in range(len(long))] and sum(n for *_, n in long) == 60_001
    assert packing.pack(no_docs).collect() == []


def test_decontam(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, EDGE_TEXTS[9][1][:300]), (2, None), (None, "x" * 5), (3, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(edge_docs, bench).collect()}
    assert found == {(7, 1), (8, 1)}
    assert decontam.clean(edge_docs, bench).count() == len(EDGE_TEXTS) - 3
    assert decontam.clean(edge_docs, bench).columns == edge_docs.columns
    assert decontam.leaks(no_docs, bench).collect() == [] and decontam.leaks(edge_docs, bench.where("false")).collect() == []


def test_neardup(edge_docs):
    rows = neardup.link(edge_docs).collect()
    of = {r["doc_id"]: r for r in rows}
    assert of[8]["component_id"] == 7 and not of[8]["kept"] and of[7]["kept"] and of[1]["n_shingles"] == 0 and of[1]["component_id"] == 1
    assert key(neardup.keep_first(edge_docs).collect()) == sorted(str(i) for i, _ in EDGE_TEXTS if i != 8)


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "<p>x<p", "c"), (2, "u", "<p>x<p", "c"), (3, "u", "<div>" * 3000 + "deep", "d")],
                                  "page_id long, url string, html string, text string")
    rows = html.extract(pages).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html.extract(pages.where("false")).collect() == []


def test_urls(spark):
    given = [(1, None), (None, "no scheme"), (2, "://"), (3, "http://A.COM"), (3, "http://A.COM"), (4, "http://x.net/es/" + "a/" * 500), (5, "http://x.net/es/1?q#f"), (6, "a://b://c/d")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in given], "page_id long, url string, host string, path string")
    rows = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[None]["host"], rows[2]["host"]) == ("", "", "", "")
    assert rows[3]["host"] == "a.com" and rows[3]["path"] == "" and rows[3]["rule"] is None
    assert rows[4]["verdict"] == "block" and rows[5]["path"] == "/es/1" and (rows[6]["host"], rows[6]["path"]) == ("b:", "//c/d")
    assert urls.judge(pages).count() == len(given) and urls.judge(pages.where("false")).collect() == []


def test_quality_without_labels(spark, edge_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score(edge_docs, quality.fit(edge_docs, labels)).collect()
    assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    assert quality.accepted(edge_docs, quality.Model()).columns == edge_docs.columns
