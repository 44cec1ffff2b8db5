"""Answers to sent entries as a stream: what they settle moves the ledger, what stays without one is told.

Entries and acks come in any order on one stream. The state holds entries that wait for their ack and acks that
wait for their entry, one row per session of a manifest. An entry without an ack after `TIMEOUT_MS` of event time
comes out once as unanswered; a late ack still settles it, until `LATE_MS` have passed and the row leaves
the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.sources import ledger as L
from sessionmill.streaming.state import Gate, run_gate

TIMEOUT_MS = 60 * 60 * 1000
LATE_MS = 7 * 24 * 60 * 60 * 1000

_KEYS = ["manifest_id", "session_id"]
_VALUES = "entry_ms bigint, content_hash string, path string, ack_ms bigint, status string, reason string, told boolean"
EVENTS = "manifest_id string, session_id string, ts_ms bigint, is_ack boolean, content_hash string, path string, status string, reason string"


def _merged(rows: DataFrame, state: DataFrame) -> DataFrame:
    """State and batch in one row per session. Of several acks the first counts, of equal times acked before failed."""
    ack = F.col("is_ack")
    new = rows.select(
        *_KEYS, F.when(~ack, F.col("ts_ms")).alias("entry_ms"), "content_hash", "path",
        F.when(ack, F.col("ts_ms")).alias("ack_ms"), "status", "reason", F.lit(False).alias("told"),
    )
    answer = F.min(F.when(F.col("ack_ms").isNotNull(), F.struct("ack_ms", "status", "reason"))).alias("_a")
    return new.unionByName(state).groupBy(*_KEYS).agg(
        F.min("entry_ms").alias("entry_ms"), F.max("content_hash").alias("content_hash"), F.max("path").alias("path"), answer, F.max("told").alias("told")
    ).select(*_KEYS, "entry_ms", "content_hash", "path", "_a.ack_ms", "_a.status", "_a.reason", "told")


def _judged(rows: DataFrame, state: DataFrame) -> DataFrame:
    now = rows.agg(F.max("ts_ms").alias("_now"))  # one row
    every = _merged(rows, state).crossJoin(F.broadcast(now))
    settled = F.col("entry_ms").isNotNull() & F.col("ack_ms").isNotNull()
    waits = F.col("entry_ms").isNotNull() & F.col("ack_ms").isNull()
    late = waits & ~F.col("told") & (F.col("entry_ms") + F.lit(TIMEOUT_MS) <= F.col("_now"))
    old = F.coalesce("entry_ms", "ack_ms") + F.lit(LATE_MS) <= F.col("_now")
    return every.withColumns({"_settled": settled, "_unanswered": late, "_old": old})


def _emit(rows: DataFrame, state: DataFrame, earlier: DataFrame | None) -> DataFrame:
    out = _judged(rows, state).where("_settled OR _unanswered")
    return out.select(*_KEYS, "content_hash", "path", F.when(F.col("_settled"), F.col("status")).otherwise("unanswered").alias("status"), "reason", "told")


def _keep(rows: DataFrame, out: DataFrame, state: DataFrame) -> DataFrame:
    judged = _judged(rows, state)
    held = judged.withColumn("told", F.col("told") | F.col("_unanswered")).withColumn("gone", F.col("_settled") | F.col("_old"))
    touched = rows.select(*_KEYS).distinct().withColumn("_touched", F.lit(True))
    return held.join(touched, _KEYS, "left").where("_touched OR _unanswered OR gone")


def settle_entries(events: DataFrame, folder: str, ledger_path: str, name: str, endpoint: str = "", user_id: str = "", uploaded_at: str = "") -> StreamingQuery:
    """Settled and unanswered entries of `events` (see `EVENTS`); the acknowledged ones go into the ledger."""

    def move(out: DataFrame, batch: int) -> None:
        run_id = f"{name}/{batch}"
        if L.is_committed(out.sparkSession, ledger_path, run_id, endpoint, user_id):
            return
        none = {c: F.lit(None).cast(t) for c, t in (("mtime_ms", "double"), ("byte_size_on_disk", "bigint"), ("derivation", "string"))}
        moved = out.where("status = 'acked'").select(
            "session_id", "content_hash", F.lit(uploaded_at).alias("last_uploaded_at"), "manifest_id", F.col("path").alias("source_file_path"),
            *[c.alias(n) for n, c in none.items()], F.lit(POLICY_VERSION).alias("policy_version"),
        )
        L.write_ledger(moved, ledger_path, run_id, endpoint, user_id)

    schema = f"manifest_id string, session_id string, {_VALUES}"
    return run_gate(events, folder, Gate(_KEYS, schema, _emit, _keep, move))
