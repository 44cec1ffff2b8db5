import base64
from collections import defaultdict

import public_tokenizers as P
import tiktoken
from helpers import SF, shingle_set, words
from test_decontaminate import greedy

import corpus_pipeline as cp
from sessionmill.llm import quality as q


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]


def test_rows_against_brute_force(spark):
    docs, items, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in q.judge(docs, q.train(docs, labels)).where("kept").collect()}
    by_text = defaultdict(list)
    for i in good:
        by_text[rows[i] or ""].append(i)
    left = sorted(max(ids) for ids in by_text.values())
    sets, root = {i: shingle_set(rows[i]) for i in left}, {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(left):
        for b in left[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [i for i in left if find(i) == i]
    assert set(got) <= set(left)
    passages = [words(r.text) for r in items.collect()]
    grams = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in passages]
    for i in left:
        w = words(rows[i])
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        hit = any(g & own and greedy(w, p) >= 0.8 for g, p in zip(grams, passages) if len(p) >= 5 and len(g & own) * 5 >= 0.8 * len(p))
        assert (i in got) != hit, i
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        assert r.ids == library.encode_ordinary(rows[i])


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and out.collect() == []
        assert name == "encode" or out.columns == docs.columns


def test_stages_take_columns_of_any_name_and_type(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = docs.selectExpr("*", "map('k', doc_id) AS `a.b`", "array(struct(doc_id AS `x y`)) AS `c d`", "lang AS _0")
    for name, stage in cp.STAGES:
        out = stage(spark, more, SF)
        assert out.columns[: len(more.columns)] == more.columns
        assert out.select("doc_id").union(out.select("doc_id")).count() == 2 * stage(spark, docs, SF).count(), name
        assert all(r["a.b"] == {"k": r.doc_id} for r in out.collect())
