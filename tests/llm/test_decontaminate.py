import random
import time

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, odd_docs, words
from pyspark.sql import functions as F

from sessionmill.llm import decontaminate as dc


def greedy(doc, item):
    """Tiles by the definition: the longest free common run, again and again."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for t in range(len(item)):
                n = 0
                while p + n < len(doc) and t + n < len(item) and doc[p + n] == item[t + n] and p + n not in used_d and t + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < 5:
            return total / len(item)
        used_d.update(range(p, p + n))
        used_i.update(range(t, t + n))
        total += n


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if len(w) >= 5:
                part = greedy(words(text), w)
                if part >= dc.COVERAGE:
                    out.add((d, i, round(part, 9)))
    return out


def found(docs, items, **more):
    return {(r.doc_id, r.item_id, round(r.coverage, 9)) for r in dc.contaminated(docs, items, **more).collect()}


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 100])
def test_random_passages(spark, block):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(12)}" for _ in range(rng.randrange(3, 24)))) for i in range(25)]
    docs = []
    for d in range(60):
        w = [f"t{rng.randrange(12)}" for _ in range(30)]
        parts = items[rng.randrange(25)][1].split()
        cut = rng.randrange(len(parts))
        w[rng.randrange(30) : 5] = parts[cut:] + (["gap"] if d % 2 else []) + parts[:cut]  # reordered
        docs.append((d, " ".join(w)))
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    want = brute(docs, items)
    assert want and got == want


def test_reordered_passage_is_caught_and_clean_text_kept(spark):
    a, b = " ".join(f"left{i}" for i in range(12)), " ".join(f"right{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"{a} {b}"), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    docs = odd_docs(spark, [(1, f"So. {b.upper()}! then {a}."), (2, f"only {a}"), (3, None), (4, ""), (None, f"{a}, {b}"), (None, f"{a}, {b}")])
    assert found(docs, items) == {(1, 1, 1.0), (None, 1, 1.0)}
    out = dc.clean(docs, items)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]


def test_empty_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert found(docs.where("false"), items) == set() and found(docs, items.where("false")) == set()
    assert dc.clean(docs, items.where("false")).count() == docs.count() and dc.clean(docs.where("false"), items).count() == 0


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 1500][:60]
    got = {f for f in found(docs, items) if f[0] in {d for d, _ in short}}
    assert got == brute(short, [(r.item_id, r.text) for r in items.collect()])


def test_item_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, "clean")], "doc_id long, text string")
    for kind in ("double", "string", "int", "date", "decimal(10,2)"):
        items = spark.createDataFrame([(1, text)], "n long, text string").selectExpr(
            f"cast({'current_date()' if kind == 'date' else 'n'} AS {kind}) AS item_id", "text"
        )
        (row,) = dc.contaminated(docs, items).collect()
        assert (row.doc_id, row.item_id) == (1, items.first().item_id)


def test_blocks_give_what_one_block_gives(spark):
    """A benchmark of many blocks, met by suspects only, finds and drops the same rows."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumnRenamed("lang", "dotted.name").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    docs = docs.union(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    size = items.selectExpr("sum(octet_length(text))").first()[0]
    whole, parts = (sorted(found(docs, items, block_bytes=b), key=str) for b in (dc.BLOCK_BYTES, size // 5))
    assert whole and whole == parts
    rows = [sorted(map(str, dc.clean(docs, items, block_bytes=b).collect())) for b in (dc.BLOCK_BYTES, size // 5)]
    assert rows[0] == rows[1] and 0 < len(rows[0]) < docs.count()


def test_tiles_against_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(400):
        vocabulary = rng.integers(0, 2**64, rng.integers(1, 6), dtype=np.uint64)
        doc, item = (vocabulary[rng.integers(0, len(vocabulary), rng.integers(1, n))] for n in (70, 45))
        got = dc.tiles(doc, item)
        assert sum(n for _, _, n in got) / len(item) == greedy(doc.tolist(), item.tolist())
        assert all((doc[p : p + n] == item[t : t + n]).all() for p, t, n in got)


def test_repeated_words_cost_their_length():
    index = dc.SeedIndex(pa.array([1]), pa.array(["same " * 800]))
    start = time.perf_counter()
    ((_, _, coverage, marked),) = index.matches(pa.array(["same " * 200_000]))
    assert coverage == 1 and marked == [(0, 0, 800)] and time.perf_counter() - start < 10


def test_suspects_miss_no_covered_text(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "short one")], "item_id long, text string")
    table, least = dc._seed_filter(items)
    assert least == 20
    texts = ["", None, "w1 w2 w3 w4", " ".join(f"w{i}" for i in range(16)), "x " * 500 + " ".join(f"w{i}" for i in range(4, 20)), "clean " * 40]
    assert dc.suspects(pa.array(texts), table, 0.8 * least).tolist() == [False, False, False, True, True, False]
    empty, least = dc._seed_filter(items.where("item_id = 2"))
    assert least == 0 and not dc.suspects(pa.array(texts), empty, 0).any()
