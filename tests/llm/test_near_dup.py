import random

import numpy as np
import pytest
from helpers import odd_docs, shingle_set

from sessionmill.llm import near_dup as nd


def brute(rows):
    """Per row: class id, class size, links, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for a in range(n):
        members = [b for b in range(n) if find(b) == find(a)]
        ids = [rows[b][0] for b in members if rows[b][0] is not None]
        out.append((rows[a][0], min(ids) if ids else None, len(members), links[a]))
    return sorted(out, key=str)


def varied(groups, size, n, edits, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def result(df):
    return sorted([(r.doc_id, r.class_id, r.class_size, r.n_links) for r in df.collect()], key=str)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(nd.near_groups(docs)) == brute(rows)


@pytest.mark.parametrize("blocks", [1024, 7])
def test_groups_of_near_copies(spark, monkeypatch, blocks):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", blocks)  # small ones: groups meet in many pairs of blocks
    rows = varied(12, 8, 60, 4, 1) + [(1000 + i, t) for i, t in varied(1, 90, 120, 5, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_groups(docs)) == brute(rows)


def test_one_of_each_class_stays_with_all_columns(spark):
    docs = odd_docs(spark)
    out = nd.near_dedup(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({c for _, c, *_ in brute(rows)}, key=str)
    assert sorted([r.doc_id for r in out.collect()], key=str) == want


def test_empty_table(spark):
    docs = odd_docs(spark).where("false")
    assert nd.near_groups(docs).collect() == [] and nd.near_dedup(docs).collect() == []


def test_pruning_follows_the_posterior():
    assert nd.posterior(64, 64, 0.8) > 0.99 and nd.posterior(20, 64, 0.8) < 1e-9
    needed = nd.least_matches()
    for n, m in zip(range(nd.STEP, nd.COMPARED + 1, nd.STEP), needed, strict=True):
        assert nd.posterior(m, n, nd.THRESHOLD) >= nd.TOLERANCE and (m == 0 or nd.posterior(m - 1, n, nd.THRESHOLD) < nd.TOLERANCE)


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    equal = np.mean(nd.minhash(values[:1200]) == nd.minhash(values[300:]))
    assert abs(equal - 900 / 1500) < 0.12


@pytest.mark.parametrize("fold", [1 << 17, 40])
def test_components_of_hubs_chains_and_pairs(spark, monkeypatch, fold):
    from sessionmill.llm import common

    monkeypatch.setattr(common, "FOLD", fold)  # small: many forests are left open and closed by rounds
    rng = random.Random(5)
    pairs = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    rng.shuffle(pairs)
    root = {x: x for pair in pairs for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    out = common.components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, out)) == sorted((x, find(x)) for x in linked)
