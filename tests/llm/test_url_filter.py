import duckdb
import pytest
import xxhash

from sessionmill.llm import catalog
from sessionmill.llm import url_filter as uf
from sessionmill.llm.url_filter_queries import RULES

URLS = [
    "http://a.example.org/en/18",
    "https://example.org/es/",
    "HTTP://EXAMPLE.ORG/es/x?y=/de/",
    "http://notexample.org/es/1",
    "http://shop.com/de/1#x",
    "http://com/fr/",
    "http://x.com?/fr/",
    "http://x.com/fr",
    "ftp://É.COM/fr/é",
    "http://a.org",
    "no scheme/de/",
    "",
    None,
    "://",
    "http:///de/",
    "http://" + "a." * 20_000 + "org/x",
    "http://a.com/fr/" + "z" * 100_000,
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else default


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


@pytest.mark.parametrize("shard", [uf.SHARD_BYTES, 20])
def test_odd_urls(spark, shard):
    rules = [*RULES, ("b.example.org", "/", "block"), ("b.example.org", "/", "allow"), (None, "/", "block"), ("xn--a", "", "block")]
    got = uf.judge_urls(frame(spark, URLS), uf.UrlRules(spark, rules, shard)).collect()
    rules = [r for r in rules if r[0]]
    assert [tuple(r)[1:] for r in sorted(got)] == [brute(u, rules) for u in URLS]


def test_check_sql_on_odd_urls(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    got = con.execute(catalog.CHECKS["op2_url_filter"]).fetchall()
    assert [r[1:] for r in sorted(got)] == [brute(u, RULES) for u in URLS]


def test_no_rules_repeated_and_no_rows(spark):
    none = uf.UrlRules(spark, [])
    assert {r.verdict for r in uf.judge_urls(frame(spark, ["http://a.b/c"] * 3), none).collect()} == {"allow"}
    assert uf.judge_urls(frame(spark, ["x"]).where("false"), none).collect() == []


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "a.bin"
    path.write_bytes(uf.DigestArray.pack([("a.org/", True), ("b.org/", False), ("c.org/", True)]))
    import numpy as np

    found = uf.DigestArray(str(path)).find(np.array([7, 7, 7], dtype=np.uint64), ["b.org/", "x.org/", "c.org/"])
    assert found == {0: False, 2: True}
