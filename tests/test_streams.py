"""Gates that keep a table from micro-batch to micro-batch, held against plain walks over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from sessionmill.streaming import state as S
from sessionmill.streaming import triggers as T

TRIGGERS = "endpoint string, trigger_id bigint, ts_ms bigint, logged_in boolean, blocked_until_ms bigint, batch int"


def feed(spark, df, tmp_path, batches, gate):
    folder = str(tmp_path / "gate")
    for n in range(batches):
        df.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{folder}/in")
        gate(spark.readStream.schema(df.drop("batch").schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return S.output(spark, folder)


def test_cooldown_state_lives_across_batches(spark, tmp_path):
    times = [0, 60_000, 119_999, 120_000, 130_000, 240_000, 250_000]
    rows = [("e", i, t, True, None, i // 3) for i, t in enumerate(times)] + [("f", 100, 5, False, None, 0), ("f", 101, 6, True, 7, 1), ("f", 102, 8, True, 7, 2)]
    got = feed(spark, spark.createDataFrame(rows, TRIGGERS), tmp_path, 3, T.gate_triggers).where("action = 'spawned'").collect()
    assert sorted((r.endpoint, r.ts_ms) for r in got) == [("e", 0), ("e", 120_000), ("e", 240_000), ("f", 8)]


def test_a_clock_that_was_set_back(spark, tmp_path):
    rows = [("e", 0, 1_000_000, True, None, 0), ("e", 1, 10, True, None, 1), ("e", 2, 100_000, True, None, 1), ("e", 3, 130_010, True, None, 2)]
    got = feed(spark, spark.createDataFrame(rows, TRIGGERS), tmp_path, 3, T.gate_triggers).where("action = 'spawned'").collect()
    assert sorted(r.ts_ms for r in got) == [10, 130_010, 1_000_000]


def test_one_endpoint_with_all_triggers(spark, tmp_path):
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 48 * 3_600_000) for _ in range(20_000))
    rows = [("hot", i, t, True, None, min(3, t // (12 * 3_600_000))) for i, t in enumerate(times)]
    want, last = [], None
    for t in times:
        if last is None or t >= last + 120_000:
            want.append(t)
            last = t
    out = feed(spark, spark.createDataFrame(rows, TRIGGERS), tmp_path, 4, T.gate_triggers)
    assert sorted(r.ts_ms for r in out.where("action = 'spawned'").collect()) == want and out.count() == len(rows)


def test_snapshot_gate(spark, tmp_path):
    rows = [("u", "context_snapshot", None, t, h, b) for t, h, b in [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "b", 1), (5, "b", 2), (6, "a", 2)]]
    rows += [("u", "context_snapshot", "p", t, h, b) for t, h, b in [(1, "b", 1), (2, "b", 2)]]
    df = spark.createDataFrame(rows, "user_id string, kind string, project string, t bigint, content_hash string, batch int")
    df = df.withColumn("captured_at", F.timestamp_seconds("t")).select("user_id", "kind", "project", "captured_at", "content_hash", "batch")
    got = feed(spark, df, tmp_path, 3, T.gate_snapshots).orderBy("project", "captured_at").collect()
    assert [(r.project, r.captured_at.second, r.content_hash) for r in got] == [(None, 1, "a"), (None, 4, "b"), (None, 6, "a"), ("p", 1, "b")]


EVENTS = "endpoint string, ts_ms bigint, is_response boolean, blocked boolean, trigger_id bigint, batch int"
HOUR = 3_600_000


def test_block_verdicts_live_for_twelve_hours(spark, tmp_path):
    rows = [
        ("e", 5, True, True, None, 0), ("e", 5, False, None, 1, 0), ("e", 4, False, None, 2, 0), ("f", 7, True, False, None, 0), ("f", 9, False, None, 3, 0),
        ("e", 5 + 12 * HOUR - 1, False, None, 4, 1), ("e", 5 + 12 * HOUR, False, None, 5, 1), ("g", 13 * HOUR, True, True, None, 1),
        ("g", 14 * HOUR, False, None, 6, 2), ("e", 14 * HOUR, False, None, 7, 2),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    out = feed(spark, df, tmp_path, 3, T.gate_blocked)
    assert {r.trigger_id: r.action for r in out.collect()} == {1: "blocked", 2: "open", 3: "open", 4: "blocked", 5: "open", 6: "blocked", 7: "open"}
    gate = S.Gate(["endpoint"], "endpoint string, blocked_ms bigint", None, None)
    held = {n: [r.endpoint for r in S.read_state(spark, str(tmp_path / "gate"), gate, n).collect()] for n in (1, 2, 3)}
    assert held == {1: ["e"], 2: ["g"], 3: ["g"]}  # the verdict on e has ended


PROGRESS = "manifest_id string, event string, session_id string, expected_sessions bigint, batch int"


def test_finished_manifests_leave_the_state_and_replays_count_once(spark, tmp_path):
    log = [("m", "upload-start", None, 3), ("m", "session-start", "a", None), ("m", "session-acked", "a", None), ("m", "session-failed", "b", None)]
    rest = [("m", "session-acked", "b", None), ("m", "session-skipped", "c", None)]
    other = [("n", "upload-start", None, 2), ("n", "session-acked", "x", None)]
    rows = [(*r, 0) for r in log + other] + [(*r, 1) for r in log] + [(*r, 2) for r in rest] + [(*r, 3) for r in log + rest + other]
    out = feed(spark, spark.createDataFrame(rows, PROGRESS), tmp_path, 4, T.gate_progress)
    got = {(r.manifest_id, r.batch): (r.total, r.done, r.skipped, r.failed, r.finished) for r in out.collect()}
    assert got == {
        ("m", 0): (3, 2, 0, 1, False), ("n", 0): (2, 1, 0, 0, False), ("m", 1): (3, 2, 0, 1, False),
        ("m", 2): (3, 3, 1, 0, True), ("n", 3): (2, 1, 0, 0, False),
    }
    gate = S.Gate(["manifest_id", "session_id"], T._PROGRESS, None, None)
    held = [sorted({r.manifest_id for r in S.read_state(spark, str(tmp_path / "gate"), gate, n).collect()}) for n in range(5)]
    assert held == [[], ["m", "n"], ["m", "n"], ["n"], ["n"]]


@pytest.mark.parametrize("every", [2, 16])
def test_state_is_written_as_a_whole_now_and_then(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(S, "EVERY", every)
    rows = [("u", "k", str(b % 2), b + 1, "ab"[b // 4 % 2], b) for b in range(7)]
    df = spark.createDataFrame(rows, "user_id string, kind string, project string, t bigint, content_hash string, batch int")
    df = df.withColumn("captured_at", F.timestamp_seconds("t")).select("user_id", "kind", "project", "captured_at", "content_hash", "batch")
    got = feed(spark, df, tmp_path, 7, T.gate_snapshots).orderBy("captured_at").collect()
    assert [r.captured_at.second for r in got] == [1, 2, 5, 6]
    assert (tmp_path / "gate" / "whole").exists() == (every == 2)


def test_acks_late_early_repeated_and_never(spark, tmp_path):
    from sessionmill.sources import ledger as L
    from sessionmill.streaming import acks as A

    hour = A.TIMEOUT_MS
    h = {k: k * 64 for k in "abcde"}
    entry = lambda k, t, batch: ("m", k, t, False, h[k], f"/{k}", None, None, batch)
    ack = lambda k, t, status, batch, reason=None: ("m", k, t, True, None, None, status, reason, batch)
    rows = [
        entry("a", 0, 0), ack("a", 5, "acked", 0), ack("b", 1, "acked", 0), entry("c", 0, 0),
        entry("b", 2, 1), entry("d", hour, 1), ack("a", 9, "failed", 1, "again"),
        ack("c", 2 * hour, "acked", 2), ack("d", 2 * hour, "failed", 2, "network"), entry("e", 2 * hour, 2),
        ack("x", A.LATE_MS + 3 * hour, "acked", 3),
    ]
    df = spark.createDataFrame(rows, A.EVENTS + ", batch int")
    ledger = str(tmp_path / "ledger")
    out = feed(spark, df, tmp_path, 4, lambda events, folder: A.settle_entries(events, folder, ledger, "r", "e", "u"))
    got = sorted((r.batch, r.session_id, r.status, r.reason, r.told) for r in out.collect())
    assert got == [
        (0, "a", "acked", None, False), (1, "b", "acked", None, False), (1, "c", "unanswered", None, False),
        (2, "c", "acked", None, True), (2, "d", "failed", "network", False), (3, "e", "unanswered", None, False),
    ]
    assert {r.session_id: r.content_hash for r in L.read_ledger(spark, ledger, "e", "u").collect()} == {k: h[k] for k in "abc"}
    gate = S.Gate(A._KEYS, f"manifest_id string, session_id string, {A._VALUES}", None, None)
    assert [r.session_id for r in S.read_state(spark, str(tmp_path / "gate"), gate, 4).collect()] == ["x"]  # the others have ended
