"""Upload summary, failure report and event sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.failures import FAILURE_INFO
from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.functions.text import iso_millis, short_id
from sessionmill.operators.ordering import ranked


def upload_summary(
    classified: DataFrame, will_upload: DataFrame, limit: int | None = None
) -> DataFrame:
    """One row: bucket counts over everything, sizes and dates over what will be sent."""
    kind = F.col("kind")
    found = classified.agg(
        F.count("*").alias("discovered"),
        F.count_if(kind == "unchanged").alias("unchanged"),
        F.count_if(kind == "new").alias("new"),
        F.count_if(kind == "updated").alias("updated"),
    )
    sent = will_upload.agg(
        F.count("*").alias("will_upload"),
        F.coalesce(F.sum(F.when(kind != "unchanged", F.col("byte_size"))), F.lit(0)).alias(
            "estimated_bytes"
        ),
        F.min("mtime_ms").alias("_from"),
        F.max("mtime_ms").alias("_to"),
    )
    # Two one-row aggregates side by side: joined on a constant key.
    one = found.withColumn("_k", F.lit(1)).join(F.broadcast(sent.withColumn("_k", F.lit(1))), "_k")
    return one.select(
        "discovered", "unchanged", "new", "updated", "will_upload", "estimated_bytes",
        F.lit(POLICY_VERSION).alias("policy_version"),
        iso_millis(F.col("_from")).alias("date_from"),
        iso_millis(F.col("_to")).alias("date_to"),
        F.lit(limit is not None).alias("limited"),
        F.lit(limit).cast("bigint").alias("limit_rows"),
        (F.col("new") + F.col("updated")).alias("candidates"),
    )


def failure_info(spark: SparkSession) -> DataFrame:
    """Six rows: cause and remedy per failure reason, in report order."""
    return spark.createDataFrame(
        [(r, o, s, t) for r, o, s, t in FAILURE_INFO],
        "reason string, reason_order int, summary string, remedy string",
    )


def report_counts(entries: DataFrame) -> DataFrame:
    acked = F.col("status") == "acked"
    return entries.groupBy("manifest_id").agg(
        F.count_if(acked).alias("uploaded"),
        F.count_if(F.col("failure_reason").isNotNull() & ~acked).alias("failed"),
        F.count_if(F.col("skipped_reason").isNotNull() & ~acked).alias("skipped"),
        F.count("*").alias("total"),
    )


def failed_entries(entries: DataFrame) -> DataFrame:
    """Entries that failed and were not acked since; an ack clears an old failure."""
    return entries.where("failure_reason IS NOT NULL AND status <> 'acked'").withColumn(
        "short_id", short_id(F.col("session_id"))
    )


def failure_groups(entries: DataFrame) -> DataFrame:
    """Failures per manifest and reason; the remedy names the first session of the group."""
    failed = failed_entries(entries)
    groups = failed.groupBy("manifest_id", F.col("failure_reason").alias("reason")).agg(
        F.count("*").alias("sessions"),
        F.min_by("short_id", F.struct("entry_no", "session_id")).alias("_first"),
    )
    head = F.substring_index("_first", "…", 1)
    return groups.join(F.broadcast(failure_info(entries.sparkSession)), "reason").select(
        "manifest_id", "reason", "reason_order", "summary",
        F.replace("remedy", F.lit("{id}"), head).alias("remedy"), "sessions",
    )


def in_report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("manifest_id", "reason_order")


def skipped_entries(entries: DataFrame) -> DataFrame:
    return entries.where("skipped_reason IS NOT NULL AND status <> 'acked'").select(
        "manifest_id", "session_id", short_id(F.col("session_id")).alias("short_id"),
        F.col("skipped_reason").alias("reason"),
    )


def with_sequence(events: DataFrame, order: list[str]) -> DataFrame:
    """Gapless sequence number per manifest, from 0."""
    numbered = ranked(events, ["manifest_id"], [F.col(c).asc() for c in order], "_n")
    return numbered.select(*events.columns, (F.col("_n") - 1).alias("seq"))


# Events that end a session.
OUTCOMES = ["session-acked", "session-failed", "session-skipped"]
_START = "\0start"


def session_outcomes(events: DataFrame) -> DataFrame:
    """One row per session of a manifest that has ended, and one for the manifest's start: manifest_id, session_id,
    event, expected_sessions. An event that is logged again changes nothing."""
    starts = F.col("event") == "upload-start"
    named = events.where(starts | F.col("event").isin(OUTCOMES)).select(
        "manifest_id", F.when(starts, _START).otherwise(F.col("session_id")).alias("session_id"), "event",
        F.when(starts, F.col("expected_sessions")).alias("expected_sessions"),
    )
    return named.groupBy("manifest_id", "session_id").agg(F.min("event").alias("event"), F.max("expected_sessions").alias("expected_sessions"))


def batch_state(events: DataFrame) -> DataFrame:
    """Counters of each batch by sessions; `streaming.triggers.gate_progress` keeps them live."""
    event = F.col("event")
    return session_outcomes(events).groupBy("manifest_id").agg(
        F.max("expected_sessions").alias("total"),
        F.count_if(event.isin(OUTCOMES)).alias("done"),
        F.count_if(event == "session-skipped").alias("skipped"),
        F.count_if(event == "session-failed").alias("failed"),
    )
