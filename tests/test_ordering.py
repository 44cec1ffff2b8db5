import random

from pyspark.sql import functions as F

from sessionmill.operators.ordering import carry_forward, first_per_key, ranked, running_sum
from sessionmill.streaming.cooldown import COOLDOWN_MS, started_triggers


def skewed(spark, n=4000, seed=1):
    """A third of the rows on one key, some on a null key."""
    rnd = random.Random(seed)
    rows, line = [], {}
    for i in range(n):
        k = rnd.choice(["hot", "a", "b", None, "hot", f"k{i % 50}"])
        line[k] = line.get(k, -1) + rnd.randint(1, 3)
        rows.append((k, line[k], rnd.choice([None, None, rnd.randint(0, 9)]), i))
    return spark.createDataFrame(rows, "k string, n bigint, v int, id bigint").repartition(6), rows


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_ranked(spark):
    df, rows = skewed(spark)
    want = {}
    for part in by_key([(r[0], (r[2] is None, -(r[2] or 0), r[3]), r[3]) for r in rows]).values():
        want.update({r[2]: i + 1 for i, r in enumerate(part)})
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    assert {r.id: r.rank for r in ranked(df, ["k"], order, "rank").collect()} == want
    everything = ranked(df, [], [F.col("id").asc()], "rank").collect()
    assert all(r["rank"] == r.id + 1 for r in everything)


def test_carry_forward_and_running_sum(spark):
    df, rows = skewed(spark)
    piece = F.floor(F.col("n") / 100)
    now, before, total = {}, {}, {}
    for part in by_key(rows).values():
        last, s = None, 0
        for _, _, v, i in part:
            before[i] = last
            last = v if v is not None else last
            s += v or 0
            now[i], total[i] = last, s
    got = carry_forward(df, ["k"], "n", {"c": F.col("v")}, piece=piece).collect()
    assert {r.id: r.c for r in got} == now
    got = carry_forward(df, ["k"], "n", {"c": F.col("v")}, piece=piece, include_current=False).collect()
    assert {r.id: r.c for r in got} == before
    got = running_sum(df, ["k"], "n", F.coalesce("v", F.lit(0)), "s", piece=piece).collect()
    assert {r.id: r.s for r in got} == total


def test_first_per_key(spark):
    df, rows = skewed(spark)
    want = {}
    for r in rows:
        if r[0] not in want or r[3] < want[r[0]]:
            want[r[0]] = r[3]
    assert {r.k: r.id for r in first_per_key(df, ["k"], F.col("id")).collect()} == want


def brute_starts(times):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= COOLDOWN_MS:
            out.append(t)
            last = t
    return out


def test_cooldown_against_a_plain_walk(spark):
    rnd = random.Random(7)
    rows = []
    for e, (span, n) in {"hot": (40_000_000, 6000), "thin": (900_000_000, 400), "burst": (600_000, 3000), "one": (1, 1)}.items():
        base = rnd.randint(0, 10_000_000)
        rows += [(e, base + rnd.randint(0, span)) for _ in range(n)]
    rows += [("grid", i * 60_000) for i in range(500)] + [("edge", 3_600_000 * k + d) for k in range(6) for d in (-1, 0, 119_999, 120_000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "endpoint string, ts_ms bigint").repartition(7)
    got = {}
    for r in started_triggers(df).collect():
        got.setdefault(r.endpoint, []).append(r.ts_ms)
    for e in {r[0] for r in rows}:
        assert sorted(got[e]) == brute_starts([t for k, t in rows if k == e]), e
