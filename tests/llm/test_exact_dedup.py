import hashlib
from collections import Counter, defaultdict

import pytest
from helpers import odd_docs

from sessionmill.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
            out[i, keep, len(ids), n == 0, digest] += 1
    return out


@pytest.mark.parametrize("limit", [ed.FILTER_LIMIT, 64])
def test_groups_of_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(ed, "FILTER_LIMIT", limit)  # 64: the filter goes out in several blocks
    docs = odd_docs(spark)
    assert Counter(map(tuple, ed.copy_groups(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_kept_rows_have_all_columns(spark):
    docs = odd_docs(spark)
    out = ed.exact_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter((r.doc_id, r.text or "") for r in rows) == Counter(
        {(i, t): 1 for (i, k, n, kept, d), c in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if kept for t in [next(x.text or "" for x in docs.collect() if hashlib.sha256((x.text or "").encode()).hexdigest() == d)]}
    )


def test_empty_table(spark):
    docs = odd_docs(spark).where("false")
    assert ed.copy_groups(docs).collect() == [] and ed.exact_dedup(docs).collect() == []


def test_unique_rows_are_not_flagged_in_bulk(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id) AS d")
    flagged = ed.possibly_repeated(rows, "d", "again").where("again").count()
    assert flagged < 0.05 * 20_000


def test_no_python_in_the_plan(spark):
    plan = ed.copy_groups(odd_docs(spark).limit(3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
