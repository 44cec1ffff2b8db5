import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.llm import quality as q

GOOD = ["The house of the family is in the north of the town, and it was built for them. ", "We went to the river with the dog. ", "Is it the best of all? No. "]


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.3
    accuracy = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < a) == truth, 1, -1)) for a in accuracy], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    bad, rates = q.expectation_maximisation(patterns, counts.astype(float))
    for k, a in enumerate(accuracy):
        assert abs(rates[1, k, 2] / (rates[1, k, 0] + rates[1, k, 2]) - a) < 0.05
    best = np.mean((bad[inverse.ravel()] > 0.5) == truth)
    assert best > np.mean((votes.sum(axis=1) > 0) == truth) - 0.005 and best > 0.9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é中.,#|\n 1", max_size=30)), max_size=6))
def test_measures_follow_their_definition(texts):
    import re

    for low, high, m in q.measured(pa.array(texts, pa.string())):
        for k, text in enumerate(texts[low:high]):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
            assert m.counts["words"][k] == len(words)
            assert m.counts["letters"][k] == sum(map(len, words))
            low_words = [w.lower() for w in words]
            assert m.counts["again"][k] == sum(a == b for a, b in zip(low_words, low_words[1:]))
            assert m.counts["signs"][k] == sum((text or "").count(c) for c in "#|")
            assert m.counts["capital"][k] == sum(w.isupper() and w.isalpha() and len(w) > 1 for w in words)


def corpus():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(GOOD, 8)) + f" number {i}" for i in range(300)]
    junk = [" ".join(f"{w}{rng.choice(['***', '###', '$$$'])}" for w in GOOD[0].split() * 3) for _ in range(40)]
    rude = ["".join(rng.choice(GOOD, 3)) + " you idiot, pathetic scum and clown. " for _ in range(40)]
    return texts, junk, rude


def test_junk_and_abuse_go_and_good_stays(spark):
    texts, junk, rude = corpus()
    docs = spark.createDataFrame(list(enumerate(texts + junk + rude)), "doc_id long, text string")
    model = q.train(docs)
    kept = {r.doc_id for r in q.judge(docs, model).where("kept").collect()}
    assert kept == set(range(300))
    assert {r.doc_id for r in q.keep_good(docs, model).collect()} == kept


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = q.judge(docs, q.train(docs)).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0]
    rude = [r for r in rows if r.quality == 1 and r.toxic == 1]
    # A few per cent of the given labels are turned at random, so no share can reach one.
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.junk > 0.5 for r in bad]) > 0.7
    assert np.mean([r.abuse > 0.5 for r in rude]) > 0.5


def test_odd_rows_empty_table_and_columns(spark):
    docs = odd_docs(spark)
    model = q.train(docs)
    assert q.judge(docs, model).count() == docs.count()
    out = q.keep_good(docs, model)
    assert out.columns == docs.columns
    none = docs.where("false")
    assert q.judge(none, q.train(none)).collect() == [] and q.keep_good(none, model).collect() == []
    empty = odd_docs(spark, [(1, None), (2, "")])
    assert {r.kept for r in q.judge(empty, q.train(empty)).collect()} == {True}


@pytest.mark.parametrize("n", [1, 7])
def test_scores_do_not_depend_on_batches(n):
    texts = pa.array([GOOD[0] * 3, None, "A!! B!! C!!", GOOD[1], "", "x"])
    model = q.Model({"junk": np.random.default_rng(0).normal(size=q.FEATURES + 1)}, {})
    whole = model.scores(texts)["junk"]
    parts = np.concatenate([model.scores(texts.slice(i, n))["junk"] for i in range(0, len(texts), n)])
    assert np.allclose(whole, parts)


def test_abuse_is_found_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels.where("pmod(hash(doc_id), 2) = 0"))
    held_out = labels.where("pmod(hash(doc_id), 2) = 1").join(docs.select("doc_id", "lang"), "doc_id")
    rows = q.judge(docs, model).join(held_out, "doc_id").collect()
    for lang, floor in (("en", 0.85), ("de", 0.6), ("fr", 0.6), ("es", 0.4)):
        toxic = [r.abuse > 0.5 for r in rows if r.lang == lang and r.toxic == 1]
        clean = [r.abuse > 0.5 for r in rows if r.lang == lang and r.toxic == 0]
        assert np.mean(toxic) > floor and np.mean(clean) < 0.05, (lang, np.mean(toxic), np.mean(clean))


def test_labels_of_one_class_or_odd_rows(spark):
    docs = odd_docs(spark)
    for rows in ([], [(1, 1, 0)], [(None, 1, 1), (2, 1, 0), (2, 1, 1), (99, 0, None)]):
        model = q.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert q.judge(docs, model).count() == docs.count()


def test_rare_abuse_is_learnt(spark):
    rng = np.random.default_rng(5)
    sentences = [" ".join(rng.choice(" ".join(GOOD).split(), 12)) + ". " for _ in range(400)]
    texts = ["".join(rng.choice(sentences, 8)) + f" number {i}" for i in range(20_000)]
    rude = ["".join(rng.choice(sentences, 6)) + f" you idiot, pathetic scum and clown {i}. " for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + rude)), "doc_id long, text string").repartition(8)
    rejected = {r.doc_id for r in q.judge(docs, q.train(docs)).where("abuse > 0.5").collect()}
    assert rejected == set(range(20_000, 20_020))


def test_quotas_take_rare_patterns_whole():
    counts = np.array([1e7, 5e5, 40.0, 3.0])
    got = q.quotas(counts, 6000)
    assert abs(got.sum() - 6000) < 1 and list(got[2:]) == [40, 3] and got[0] >= 2800
    assert list(q.quotas(np.array([5.0, 1.0]), 6000)) == [5, 1]
