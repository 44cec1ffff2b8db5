import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.llm import suffix_dedup as sd
from sessionmill.llm.suffix_array import common_prefixes, suffix_array


def brute(rows, length=sd.LENGTH):
    seen, raws = Counter(), [(t or "").encode() for _, t in rows]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    return sorted([tuple(r) for r in sd.repeat_digests(docs).collect()], key=str)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    for k, h in enumerate(common_prefixes(text, order)):
        if k:
            a, b = text[order[k - 1] :], text[order[k] :]
            assert a[:h] == b[:h] and (h == min(len(a), len(b)) or a[h] != b[h])


@pytest.mark.parametrize("text", [[1] * 2000, [1, 2] * 1000, list(range(500)), list(range(500, 0, -1)), [int(c) for c in bin(3**400)[2:]]])
def test_suffix_array_of_long_patterns(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(n)) for n in (30, 45, 60, 100)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(40)
            parts += [p[a : len(p) - rng.randrange(40)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 300), (101, "x" * 199), (102, "x" * 200), (103, "x" * 201), (104, shared[3]), (104, shared[3]), (105, "é" * 150 + shared[2])]
    return rows


@pytest.mark.parametrize("group", [sd.GROUP, 2])
@pytest.mark.parametrize("limit", [sd.BROADCAST_LIMIT, -1])
def test_passages(spark, monkeypatch, group, limit):
    monkeypatch.setattr(sd, "GROUP", group)  # small: windows are counted instead of sorted
    monkeypatch.setattr(sd, "BROADCAST_LIMIT", limit)  # -1: texts are joined by a shuffle
    rows = made(group)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark, [(1, None), (2, ""), (None, "y" * 250), (None, "y" * 250), (3, "short"), (4, "z" * 10_000), (5, "q" * 199 + "w" * 199)])
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs.where("false")) == []


def test_segments_of_a_long_text(monkeypatch):
    raw = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    whole = sd.anchors(raw)
    monkeypatch.setattr(sd, "_SEGMENT", 1024)
    monkeypatch.setattr(sd, "_PLACE", np.uint64(1023))
    parts = sd.anchors(raw)
    for found in (whole, parts):  # the windows of all anchors are all windows, each once
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(found[1], found[2])])
        assert np.array_equal(covered, np.arange(5000 - sd.LENGTH + 1))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
