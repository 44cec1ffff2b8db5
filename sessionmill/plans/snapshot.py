"""Snapshot runs: redact captured text, parse it, and drop what has not changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.operators import snapshots as N
from sessionmill.operators.redact import RedactionContext, redaction_counts, positive_counts


def context_snapshot(docs: DataFrame, context: RedactionContext) -> tuple[DataFrame, DataFrame]:
    """Redacted breakdowns with their counts, and the skill scopes read from the redacted text.

    `docs` has doc_id, user_id, project, captured_at and text.
    """
    clean = N.redact_snapshots(docs, context)
    clean = clean.withColumns(
        {
            "kind": F.lit("context_snapshot"),
            "content_hash": N.snapshot_key(["text"]),
            "redactions": positive_counts(redaction_counts(clean)),
        }
    ).select("doc_id", "user_id", "kind", "project", "captured_at", "content_hash", "text", "redactions")
    return N.changed_snapshots(clean), N.skill_scopes(clean.select("doc_id", "text"))


def mcp_snapshot(docs: DataFrame, context: RedactionContext) -> DataFrame:
    """Server inventory with redacted targets, plus the parse status of each document."""
    servers = N.mcp_servers(docs).withColumnRenamed("target", "text")
    clean = N.redact_snapshots(servers, context).select(
        "doc_id", "line_no", "name", "transport", F.col("text").alias("target"), "status"
    )
    return clean.join(N.mcp_parse_status(docs), "doc_id")
