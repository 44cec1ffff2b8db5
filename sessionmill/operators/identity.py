"""Session identity and metadata per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.hashing import is_uuid, session_uuid
from sessionmill.operators.ordering import first_per_key
from sessionmill.sources.providers import by_source_kind

SESSION = ["source_kind", "path"]


def first_non_empty(c: Column, line_no: str = "line_no") -> Column:
    """Aggregate: the first non-empty value in line order."""
    return F.min_by(c, F.when(c.isNotNull() & (c != ""), F.col(line_no)))


def session_facts(records: DataFrame) -> DataFrame:
    """What identity and metadata need from the records: first-record fields and first-seen ones."""

    def of_first(name: str) -> Column:
        return F.min_by(name, "line_no")

    return records.groupBy(*SESSION).agg(
        of_first("native_id").alias("first_native_id"),
        of_first("meta_id").alias("first_meta_id"),
        of_first("meta_cwd").alias("first_meta_cwd"),
        of_first("meta_branch").alias("first_meta_branch"),
        of_first("project_hash").alias("project_hash"),
        first_non_empty(F.col("cwd")).alias("any_cwd"),
        first_non_empty(F.col("git_branch")).alias("any_branch"),
        F.count("*").alias("record_count"),
    )


def resolve_identity(facts: DataFrame, fold_case: bool = False) -> DataFrame:
    """session_id is always a UUID: the native one where it may be reused, else one of the path."""
    if "registry_cwd" not in facts.columns:
        facts = facts.withColumn("registry_cwd", F.lit(None).cast("string"))
    native = by_source_kind(lambda s: s.native_id)
    reuse = by_source_kind(lambda s: s.reuse_native)
    with_native = facts.withColumn("native_session_id", F.when(native != "", native))
    usable = F.coalesce(reuse & is_uuid(F.col("native_session_id")), F.lit(False))
    return with_native.withColumns(
        {
            "session_id": F.when(usable, F.col("native_session_id")).otherwise(
                session_uuid(F.col("path"), fold_case)
            ),
            "derivation": F.when(usable, "native").otherwise("path-hash"),
            "session_cwd": by_source_kind(lambda s: s.cwd),
            "recorded_branch": by_source_kind(lambda s: s.branch),
        }
    )


def newest_per_session(sessions: DataFrame) -> DataFrame:
    """One row per session id within a source: the newest file, ties by path."""
    return first_per_key(
        sessions, ["source_kind", "session_id"], F.struct(-F.col("mtime_ms"), F.col("path"))
    )
