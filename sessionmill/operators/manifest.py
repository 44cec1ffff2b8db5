"""Upload jobs, manifests, and the state of their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.functions.paths import worktree_path
from sessionmill.functions.pricing import MIN_FULL_UPLOAD_USD, tier
from sessionmill.operators.ordering import latest_per_key
from sessionmill.sources.providers import by_source_kind

UNFINISHED = ["pending", "in-flight"]
_METRICS = [
    "total_tokens", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
    "turn_count", "started_at", "ended_at", "primary_model", "model_provider",
]


def upload_jobs(
    will_upload: DataFrame,
    metrics: DataFrame,
    raw_hashes: DataFrame,
    contexts: DataFrame | None = None,
    min_usd: float = MIN_FULL_UPLOAD_USD,
) -> DataFrame:
    """One row per session to send. Metrics ride along for the metadata tier only."""
    session = ["source_kind", "path"]
    jobs = (
        will_upload.where("kind <> 'unchanged'")
        .join(metrics.select(*session, "total_cost_usd", *_METRICS), session)
        .join(raw_hashes, "path")
        .withColumn("tier", tier(F.col("total_cost_usd"), min_usd))
        .where("tier <> 'excluded'")
    )
    if contexts is not None:
        ctx = contexts.where("reason IS NULL").select(
            "path", F.struct("host", "owner", "name", "branch", "commit_sha").alias("git_context")
        )
        jobs = jobs.join(ctx, "path", "left")
    else:
        jobs = jobs.withColumn("git_context", F.lit(None).cast("string"))
    is_meta = F.col("tier") == "metadata"
    return jobs.select(
        *will_upload.columns,
        by_source_kind(lambda s: F.lit(s.format_version)).alias("format_version"),
        "raw_hash", "tier", "git_context",
        worktree_path(F.col("path")).alias("worktree_path"),
        *[F.when(is_meta, F.col(c)).alias(c) for c in _METRICS],
        F.when(is_meta, F.col("total_cost_usd")).alias("total_cost_usd"),
    )


def body_bytes(records: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the NDJSON body per session: the records plus one newline between two of them."""
    return records.groupBy(*keys).agg(
        (F.sum(F.octet_length("raw")) + F.count("*") - 1).cast("bigint").alias("body_bytes")
    )


def manifest_entries(jobs: DataFrame, sizes: DataFrame, manifest_id: Column) -> DataFrame:
    """Entries of the manifests, one manifest per source. Metadata entries announce no bytes."""
    return jobs.join(sizes, ["source_kind", "path"], "left").select(
        manifest_id.alias("manifest_id"),
        *jobs.columns,
        F.when(F.col("tier") == "metadata", F.lit(0))
        .otherwise(F.coalesce("body_bytes", F.lit(0)))
        .cast("bigint")
        .alias("expected_bytes"),
        F.lit("pending").alias("status"),
    )


def manifest_headers(entries: DataFrame) -> DataFrame:
    """One small row per manifest. The entries stay rows of their own, as there may be any number."""
    return entries.groupBy("manifest_id", "source_kind").agg(
        F.count("*").alias("expected_session_count"),
        F.sum("expected_bytes").alias("expected_bytes"),
        F.count_if(F.col("tier") == "metadata").alias("metadata_sessions"),
        F.lit(POLICY_VERSION).alias("policy_version"),
    )


def entry_states(entries: DataFrame, acks: DataFrame) -> DataFrame:
    """State of every entry after a delivery; an entry without an answer stays pending."""
    told = latest_per_key(acks.select("session_id", "status", "reason"), ["session_id"], F.struct("status", "reason"))
    return (
        entries.select("manifest_id", "session_id", "tier", "expected_bytes")
        .join(told, "session_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    )


def batch_events(states: DataFrame, ts: str) -> DataFrame:
    """The event log of a batch: its start, one event per answered entry, and its end if none is open."""
    done = states.where(~F.col("status").isin(UNFINISHED)).select(
        "manifest_id", F.concat(F.lit("session-"), "status").alias("event"), "session_id", "reason"
    )
    none = F.lit(None).cast("string")
    starts = states.groupBy("manifest_id").agg(F.count("*").alias("expected_sessions")).select(
        "manifest_id", F.lit("upload-start").alias("event"), none.alias("session_id"), none.alias("reason"), "expected_sessions"
    )
    ends = finished_manifests(states).select(
        "manifest_id", F.lit("upload-complete").alias("event"), none.alias("session_id"), none.alias("reason")
    )
    events = starts.unionByName(done.unionByName(ends), allowMissingColumns=True)
    return events.withColumn("ts", F.lit(ts))


def latest_entries(updates: DataFrame) -> DataFrame:
    """Current state of every entry out of its update log; equal seq is settled by the status."""
    return latest_per_key(updates, ["manifest_id", "session_id"], F.struct("seq", "status"))


def resumable(entries: DataFrame, jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """Per saved manifest: may this batch resume it?

    `entries` carries the manifest's source, endpoint and user; `batch` has one row per manifest id
    with those of the run; `jobs` has (manifest_id, session_id). A manifest is resumable if the
    three agree, every job has an entry and every unfinished entry has a job.
    """
    # One union and one count per entry, of numbers only, so that both groups are hashed and never sorted.
    saved = entries.select(
        "manifest_id", "session_id", F.lit(1).alias("saved"), F.col("status").isin(UNFINISHED).cast("int").alias("open"), F.lit(0).alias("job")
    )
    wanted = jobs.select("manifest_id", "session_id", F.lit(0).alias("saved"), F.lit(0).alias("open"), F.lit(1).alias("job"))
    per_entry = saved.unionByName(wanted).groupBy("manifest_id", "session_id").agg(
        F.sum("saved").alias("saved"), F.sum("open").alias("open"), F.sum("job").alias("job")
    )
    owner = ["source_kind", "endpoint", "user_id"]
    owners = entries.select("manifest_id", *owner).distinct().groupBy("manifest_id").agg(*[F.min(c).alias(c) for c in owner])
    counted = per_entry.groupBy("manifest_id").agg(
        F.sum("saved").alias("saved"),
        F.sum(F.when(F.col("saved") == 0, F.col("job")).otherwise(0)).alias("unknown_jobs"),
        F.sum(F.when(F.col("job") == 0, F.col("open")).otherwise(0)).alias("orphan_entries"),
    )
    same = (
        (F.col("source_kind") == F.col("run_source_kind"))
        & (F.col("endpoint") == F.col("run_endpoint"))
        & (F.col("user_id") == F.col("run_user_id"))
    )
    return (
        counted.where("saved > 0")
        .join(owners, "manifest_id")
        .join(batch, "manifest_id")
        .select(
            "manifest_id",
            "unknown_jobs",
            "orphan_entries",
            (same & (F.col("unknown_jobs") == 0) & (F.col("orphan_entries") == 0)).alias("resume"),
        )
    )


def recheck_entries(entries: DataFrame, current: DataFrame) -> DataFrame:
    """`skip_reason` of entries to resume: their file is missing, modified, or (null) as it was."""
    now = current.select("path", F.col("raw_hash").alias("_now"))
    return entries.join(now, "path", "left").select(
        *entries.columns,
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_now") != F.col("raw_hash"), "modified")
        .alias("skip_reason"),
    )


def batch_outcome(outcomes: DataFrame) -> DataFrame:
    """Counts per manifest and the class of failure that decides its exit."""
    failed = F.col("outcome") == "failed"
    local = F.col("reason").isin("parse", "anonymization")
    n = outcomes.groupBy("manifest_id").agg(
        F.count_if(F.col("outcome") == "acked").alias("acked"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("reason") == "anonymization")).alias("_redaction"),
        F.count_if(failed & local).alias("_local"),
    )
    failure = (
        F.when(F.col("failed") == 0, "none")
        .when(F.col("_redaction") == F.col("failed"), "anonymization")
        .when(F.col("_local") == F.col("failed"), "local")
        .otherwise("wire")
    )
    return n.select("manifest_id", "acked", "skipped", "failed", failure.alias("failure_class"))


def finished_manifests(entries: DataFrame) -> DataFrame:
    """Manifests without unfinished entries: these are completed and their state is dropped."""
    n = entries.groupBy("manifest_id").agg(
        F.count_if(F.col("status").isin(UNFINISHED)).alias("unfinished"), F.count("*").alias("entries")
    )
    return n.where("unfinished = 0").select("manifest_id", "entries")
