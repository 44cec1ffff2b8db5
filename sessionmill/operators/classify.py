"""New, updated or unchanged: sessions against the ledger of past uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.operators.identity import newest_per_session
from sessionmill.operators.ordering import latest_per_key


def stat_check(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with `stat_hit`: same path, size, time and policy as at their last upload.

    Only rows without a hit need to be read. The ledger side has one row per path.
    """
    known = latest_per_key(
        ledger.where("source_file_path IS NOT NULL").select(
            F.col("source_file_path").alias("path"),
            F.col("mtime_ms").alias("l_mtime_ms"),
            F.col("byte_size_on_disk").alias("l_size"),
            F.col("derivation").alias("l_derivation"),
            F.col("policy_version").alias("l_policy"),
            F.col("session_id").alias("l_session_id"),
            "last_uploaded_at",
        ),
        ["path"],
        F.struct("last_uploaded_at", "l_session_id"),
    )
    hit = (
        F.col("l_derivation").isNotNull()
        & (F.col("l_mtime_ms") == F.col("mtime_ms"))
        & (F.col("l_size") == F.col("size_bytes"))
        & (F.col("l_policy") == POLICY_VERSION)
    )
    return files.join(known, "path", "left").select(
        *[files[c] if c == "path" else F.col(c) for c in files.columns],
        F.coalesce(hit, F.lit(False)).alias("stat_hit"),
        F.when(hit, F.col("l_session_id")).alias("ledger_session_id"),
        F.when(hit, F.col("l_derivation")).alias("ledger_derivation"),
    )


def content_check(sessions: DataFrame, ledger: DataFrame) -> DataFrame:
    """`kind` of read sessions by their content hash."""
    known = ledger.select("session_id", F.col("content_hash").alias("previous_hash"))
    return sessions.join(known, "session_id", "left").withColumn(
        "kind",
        F.when(F.col("previous_hash").isNull(), "new")
        .when(F.col("previous_hash") == F.col("content_hash"), "unchanged")
        .otherwise("updated"),
    )


def classify(checked: DataFrame, sessions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Union of the two checks, one row per session id.

    `checked` is the output of `stat_check`; `sessions` holds identity and content hash of the
    files it could not vouch for. Files that vanished in between have no session row and drop out.
    """
    cols = ["source_kind", "path", "size_bytes", "mtime_ms"]
    by_stat = checked.where("stat_hit").select(
        *cols,
        F.col("ledger_session_id").alias("session_id"),
        F.col("ledger_derivation").alias("derivation"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit("unchanged").alias("kind"),
    )
    to_read = checked.where(~F.col("stat_hit")).select(*cols)
    read = content_check(
        to_read.join(
            sessions.select("source_kind", "path", "session_id", "derivation", "content_hash"),
            ["source_kind", "path"],
        ),
        ledger,
    ).select(*cols, "session_id", "derivation", "content_hash", "kind")
    return newest_per_session(by_stat.unionByName(read))


def bucket_counts(classified: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return classified.agg(
        F.count("*").alias("discovered"),
        F.count_if(kind == "unchanged").alias("unchanged"),
        F.count_if(kind == "new").alias("new"),
        F.count_if(kind == "updated").alias("updated"),
    )


def only_selected(classified: DataFrame, selected: DataFrame) -> DataFrame:
    return classified.join(selected.select("path"), "path", "left_semi")


def newest_first(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Report order; with a limit Spark keeps only the top rows of each partition."""
    ordered = sessions.orderBy(F.col("mtime_ms").desc(), F.col("path").asc())
    return ordered if limit is None else ordered.limit(limit)
