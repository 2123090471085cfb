import random

import pytest

WORDS = [a + b + c for a in ("ka", "mo", "ri", "te", "su", "ba") for b in ("ran", "lo", "ti", "men") for c in ("", "s", "do", "ver")]


def prose(seed, n):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        w = pick.choice(WORDS) + pick.choice(("", "", "", ",", "."))
        out.append(w.capitalize() if pick.random() < 0.1 else w)
        if pick.random() < 0.05:
            out[-1] += "\n"
    return " ".join(out)


EDGE_TEXTS = [(None, None), (None, "token = abcdefgh"), (1, ""), (1, ""), (2, None), (3, "x"), (4, "  \n\t "), (5, "\x01\x02 \u00e9\u4e2d\U0001f600 \x00 end"),
              (6, "word " * 60_000), (7, prose(1, 300)), (7, prose(1, 300)), (8, prose(1, 300)), (9, "cc by All rights reserved AKIA" + "A" * 20)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators might use."""
    rows = [(i, t, "e", 1, 2, 3, "r", 4.0) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, row_id int, class int, row string, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
