"""The gates as streams: which triggers start an upload, which are blocked, which snapshots are news, and how far
a batch is. Each keeps a small table from micro-batch to micro-batch (see `state`); a hot key is cut into
pieces as in the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.operators.ordering import carry_forward, durable
from sessionmill.operators.reports import batch_state, session_outcomes
from sessionmill.operators.snapshots import changed_snapshots
from sessionmill.streaming.cooldown import BLOCK_MS, BLOCK_TTL_MS, hook_actions
from sessionmill.streaming.state import Gate, run_gate, same_keys

_SNAPSHOT = ["user_id", "kind", "project"]


def _last_starts(rows: DataFrame, out: DataFrame, state: DataFrame) -> DataFrame:
    last = out.where("action = 'spawned'").groupBy("endpoint").agg(F.max("ts_ms").alias("last_ms"))
    return last.withColumn("gone", F.lit(False))


def gate_triggers(triggers: DataFrame, folder: str) -> StreamingQuery:
    """Action of every trigger; the state is the last start of each endpoint."""
    return run_gate(triggers, folder, Gate(["endpoint"], "endpoint string, last_ms bigint", lambda rows, state, _: hook_actions(rows, state), _last_starts))


def _new_snapshots(rows: DataFrame, state: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """The first snapshot of a key in the batch is held against the state, each other one against the one before."""
    changed = durable(changed_snapshots(rows))
    first = same_keys(changed.where("previous_hash IS NULL"), state.withColumnRenamed("content_hash", "_stored"), _SNAPSHOT, "left")
    news = first.where(~F.col("content_hash").eqNullSafe(F.col("_stored"))).drop("_stored")
    return changed.where("previous_hash IS NOT NULL").unionByName(news).drop("previous_hash")


def _last_snapshots(rows: DataFrame, out: DataFrame, state: DataFrame) -> DataFrame:
    latest = F.max_by("content_hash", F.struct("captured_at", "content_hash")).alias("content_hash")
    return rows.groupBy(*_SNAPSHOT).agg(latest).withColumn("gone", F.lit(False))


def gate_snapshots(snapshots: DataFrame, folder: str) -> StreamingQuery:
    """Snapshots that differ from the one before; the state is the last hash of each user, kind and project."""
    schema = "user_id string, kind string, project string, content_hash string"
    return run_gate(snapshots, folder, Gate(_SNAPSHOT, schema, _new_snapshots, _last_snapshots))


def _verdicts(rows: DataFrame, state: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Triggers with the block verdict that holds for them: the last one before or in the state."""
    said = F.when(F.col("is_response") & F.col("blocked"), F.col("ts_ms"))
    # A response counts for triggers of the same millisecond.
    ordered = rows.withColumn("_order", F.struct("ts_ms", (~F.col("is_response")).alias("later"), "trigger_id"))
    seen = carry_forward(ordered, ["endpoint"], "_order", {"_said": said}, piece=F.floor(F.col("ts_ms") / BLOCK_MS))
    known = seen.where("NOT is_response").join(state, "endpoint", "left")
    until = F.greatest("_said", "blocked_ms") + F.lit(BLOCK_TTL_MS)  # null where nothing is known
    return known.select(
        "endpoint", "trigger_id", "ts_ms", until.alias("blocked_until_ms"),
        F.when(F.coalesce(until > F.col("ts_ms"), F.lit(False)), "blocked").otherwise("open").alias("action"),
    )


def _live_verdicts(rows: DataFrame, out: DataFrame, state: DataFrame) -> DataFrame:
    """The newest verdict of each endpoint; those that the newest event has outlived leave the state."""
    newest = rows.where("is_response AND blocked").groupBy("endpoint").agg(F.max("ts_ms").alias("_said"))
    now = rows.agg(F.max("ts_ms").alias("_now"))  # one row
    both = state.join(newest, "endpoint", "full").crossJoin(F.broadcast(now))
    held = both.select("endpoint", F.greatest("_said", "blocked_ms").alias("blocked_ms"), "_now", F.col("blocked_ms").alias("_before"))
    ended = F.coalesce(F.col("blocked_ms") + F.lit(BLOCK_TTL_MS) <= F.col("_now"), F.lit(False))
    moved = ended | ~F.col("blocked_ms").eqNullSafe(F.col("_before"))
    return held.where(moved).select("endpoint", "blocked_ms", ended.alias("gone"))


def gate_blocked(events: DataFrame, folder: str) -> StreamingQuery:
    """Responses and triggers as one stream (endpoint, ts_ms, is_response, blocked, trigger_id): whether each trigger is
    blocked. A verdict lives for `BLOCK_TTL_MS` of event time and then leaves the state."""
    return run_gate(events, folder, Gate(["endpoint"], "endpoint string, blocked_ms bigint", _verdicts, _live_verdicts))


_PROGRESS = "manifest_id string, session_id string, event string, expected_sessions bigint"


def gate_progress(events: DataFrame, folder: str) -> StreamingQuery:
    """Live counters of the manifests that a batch touches, and whether they are finished.

    The state is one row per session of an open manifest, so an event that comes again counts once. When
    a manifest has as many outcomes as sessions its rows leave the state; what comes for it afterwards is a
    replay, told from the output, and ignored. Of several outcomes of one session the one of the later
    micro-batch counts, and in one batch the first in the order acked, failed, skipped.
    """

    def emit(rows: DataFrame, state: DataFrame, earlier: DataFrame | None) -> DataFrame:
        if earlier is not None:
            rows = rows.join(earlier.where("finished").select("manifest_id").distinct(), "manifest_id", "left_anti")
        new = session_outcomes(rows).withColumn("_new", F.lit(1))
        old = state.join(new.select("manifest_id").distinct(), "manifest_id", "left_semi").withColumn("_new", F.lit(0))
        value = F.max_by(F.struct("event", "expected_sessions"), "_new").alias("_v")
        merged = new.unionByName(old).groupBy("manifest_id", "session_id").agg(value).select("manifest_id", "session_id", "_v.*")
        return batch_state(merged).withColumn("finished", F.coalesce(F.col("done") >= F.col("total"), F.lit(False)))

    def keep(rows: DataFrame, out: DataFrame, state: DataFrame) -> DataFrame:
        ended = out.select("manifest_id", "finished")
        every = session_outcomes(rows).join(ended, "manifest_id").where("NOT finished").select("manifest_id", "session_id", "event", "expected_sessions")
        left = state.join(ended.where("finished"), "manifest_id", "left_semi")
        return every.withColumn("gone", F.lit(False)).unionByName(left.withColumn("gone", F.lit(True)))

    return run_gate(events, folder, Gate(["manifest_id", "session_id"], _PROGRESS, emit, keep))
