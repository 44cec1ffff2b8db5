"""Small tables with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rest string, `kept` string, `n_tokens` string, ids string"
LONG = " ".join(f"word{i} of a long text" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD_TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (3, None),
    (4, ""),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (5, None),
    (6, "one"),
    (7, LONG),
    (8, LONG + " end"),
    (9, PASSAGE + " first of two"),
    (10, "second of two " + PASSAGE.upper()),
    (11, "x" * 70_000),
    (12, "line\n" * 50),
    (13, "Été déjà vu, 中文 𝟘 ok"),
]


def odd_docs(spark, texts=ODD_TEXTS):
    rows = [(i, t, "en", None, len(t or ""), "r", "k", "n", "i") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
