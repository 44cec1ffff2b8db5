"""Cost, tokens and metrics per session.

Input is the typed record table of `sources.records.typed_records`. All session level results are
aggregates with map-side combine, so a session that owns a third of all records costs no more than
its partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.pricing import (
    EXCLUDE_FLOOR_USD,
    MIN_FULL_UPLOAD_USD,
    model_vendor,
    tier,
    token_cost,
)
from sessionmill.operators.ordering import carry_forward

SESSION = ["source_kind", "path"]
METRICS = [
    "total_cost_usd", "total_tokens", "input_tokens", "output_tokens",
    "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens",
    "turn_count", "started_at", "ended_at", "primary_model", "model_provider",
]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def record_cost(records: DataFrame) -> Column:
    """USD of one record; only assistant records with a usage block cost anything."""
    priced = (F.col("role") == "assistant") & F.col("has_usage")
    cost = token_cost(
        F.col("model"), F.col("input_tokens"), F.col("cache_creation_tokens"),
        F.col("cache_read_tokens"), F.col("output_tokens"),
    )
    return F.when(priced, cost).otherwise(0.0)


def _by_model(records: DataFrame) -> DataFrame:
    """One row per session and model; the row without a model carries the other record facts."""
    used = F.coalesce((F.col("role") == "assistant") & F.col("has_usage"), F.lit(False))
    label = F.when(used, F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("unknown")))

    def total(name: str) -> Column:
        return F.sum(F.when(used, _zero(F.col(name))).otherwise(0.0)).alias(name)

    return (
        records.withColumn("used_model", label)
        .groupBy(*SESSION, "used_model")
        .agg(
            total("input_tokens"), total("output_tokens"),
            total("cache_creation_tokens"), total("cache_read_tokens"),
            F.sum(record_cost(records)).alias("cost_usd"),
            F.min("line_no").alias("first_line"),
            F.count_if(F.col("role") == "user").alias("turns"),
            F.min("ts").alias("min_ts"),
            F.max("ts").alias("max_ts"),
            F.bool_or(F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("answered"),
        )
    )


def message_model_usage(records: DataFrame) -> DataFrame:
    return (
        _by_model(records)
        .where("used_model IS NOT NULL")
        .select(
            *SESSION, F.col("used_model").alias("model"), "input_tokens", "output_tokens",
            "cache_creation_tokens", "cache_read_tokens",
            F.lit(None).cast("double").alias("reasoning_tokens"), "cost_usd",
        )
    )


def message_metrics(records: DataFrame) -> DataFrame:
    """Session totals of the tools that log one usage block per answer."""
    m = _by_model(records)
    tokens = (
        F.col("input_tokens") + F.col("output_tokens")
        + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    )
    rank = F.when(F.col("used_model").isNotNull(), F.struct(tokens, -F.col("first_line")))
    out = m.groupBy(*SESSION).agg(
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum(tokens).alias("total_tokens"),
        *[
            F.sum(c).alias(c)
            for c in ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
        ],
        F.lit(None).cast("double").alias("reasoning_tokens"),
        F.sum("turns").alias("turn_count"),
        F.min("min_ts").alias("started_at"),
        F.max("max_ts").alias("ended_at"),
        F.max_by("used_model", rank).alias("primary_model"),
        F.bool_or("answered").alias("has_answer"),
    )
    return out.withColumn("model_provider", model_vendor(F.col("primary_model"))).select(
        *SESSION, *METRICS, "has_answer"
    )


def _codex_totals(records: DataFrame) -> DataFrame:
    """Cumulative counters: the last valid value of each field in line order."""
    counted = (F.col("event_type") == "token_count") & F.col("has_total_usage")

    def last_valid(name: str) -> Column:
        v = F.col(name)
        valid = counted & (v >= 0) & (v < float("inf")) & ~F.isnan(v)
        return _zero(F.max_by(v, F.when(valid, F.col("line_no"))))

    model = F.min_by("context_model", F.when(F.col("context_model").isNotNull(), F.col("line_no")))
    raw = records.groupBy(*SESSION).agg(
        F.coalesce(F.bool_or(counted), F.lit(False)).alias("observed"),
        last_valid("total_input_tokens").alias("all_input"),
        last_valid("total_cached_tokens").alias("cached"),
        last_valid("total_output_tokens").alias("output"),
        last_valid("total_reasoning_tokens").alias("reasoning"),
        last_valid("total_tokens").alias("total"),
        F.coalesce(model, F.lit("unknown")).alias("model"),
        F.count_if(F.col("event_type") == "user_message").alias("turn_count"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.bool_or(
            F.coalesce(
                (F.col("event_type") == "agent_message") | (F.col("role") == "assistant"),
                F.lit(False),
            )
        ).alias("has_answer"),
    )
    fresh = F.greatest(F.lit(0.0), F.col("all_input") - F.col("cached"))
    counted_total = F.coalesce(
        F.when(F.col("total") != 0, F.col("total")), fresh + F.col("cached") + F.col("output")
    )
    cost = token_cost(F.col("model"), fresh, F.lit(0.0), F.col("cached"), F.col("output"))
    zero = F.lit(0.0)
    seen = F.col("observed")
    return raw.select(
        *SESSION, "observed",
        F.when(seen, cost).otherwise(zero).alias("total_cost_usd"),
        F.when(seen, counted_total).otherwise(zero).alias("total_tokens"),
        F.when(seen, fresh).otherwise(zero).alias("input_tokens"),
        F.when(seen, F.col("output")).otherwise(zero).alias("output_tokens"),
        zero.alias("cache_creation_tokens"),
        F.when(seen, F.col("cached")).otherwise(zero).alias("cache_read_tokens"),
        F.when(seen, F.col("reasoning")).otherwise(zero).alias("reasoning_tokens"),
        "turn_count", "started_at", "ended_at",
        F.when(seen, F.col("model")).alias("primary_model"),
        F.when(seen, model_vendor(F.col("model"))).alias("model_provider"),
        "has_answer",
    )


def codex_metrics(records: DataFrame) -> DataFrame:
    return _codex_totals(records).select(*SESSION, *METRICS, "has_answer")


def codex_model_usage(records: DataFrame) -> DataFrame:
    return (
        _codex_totals(records)
        .where("observed")
        .select(
            *SESSION, F.col("primary_model").alias("model"), "input_tokens", "output_tokens",
            "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens",
            F.col("total_cost_usd").alias("cost_usd"),
        )
    )


def session_metrics(records: DataFrame) -> DataFrame:
    """Metrics of all sessions; the source kind picks the way usage is read."""
    is_codex = F.col("source_kind") == "codex"
    return message_metrics(records.where(~is_codex)).unionByName(
        codex_metrics(records.where(is_codex))
    )


def session_model_usage(records: DataFrame) -> DataFrame:
    is_codex = F.col("source_kind") == "codex"
    return message_model_usage(records.where(~is_codex)).unionByName(
        codex_model_usage(records.where(is_codex))
    )


def session_cost(records: DataFrame) -> DataFrame:
    """Cost only, in one shuffle for the tools with per-answer usage."""
    is_codex = F.col("source_kind") == "codex"
    messages = records.where(~is_codex).groupBy(*SESSION).agg(
        F.sum(record_cost(records)).alias("total_cost_usd")
    )
    codex = codex_metrics(records.where(is_codex)).select(*SESSION, "total_cost_usd")
    return messages.unionByName(codex)


def with_tier(metrics: DataFrame, min_usd: float = MIN_FULL_UPLOAD_USD) -> DataFrame:
    return metrics.withColumn("tier", tier(F.col("total_cost_usd"), min_usd))


def drop_trivial(sessions: DataFrame, strict: bool = True) -> DataFrame:
    """Keep sessions with an answer; unchanged ones always stay.

    By default only answers in the two known message shapes count. strict=False also keeps
    sources whose answers have another shape.
    """
    unchanged = F.col("kind") == "unchanged"
    keep = unchanged | F.coalesce(F.col("has_answer"), F.lit(False))
    if not strict:
        keep = keep | F.col("source_kind").isin("cursor", "gemini")
    return sessions.where(keep)


def drop_cheap(sessions: DataFrame, min_usd: float = EXCLUDE_FLOOR_USD) -> DataFrame:
    return sessions.where((F.col("kind") == "unchanged") | (F.col("total_cost_usd") >= min_usd))


def running_totals(records: DataFrame, columns: list[str]) -> DataFrame:
    """Cumulative counters as they stood after each record: the last valid value so far."""
    counted = (F.col("event_type") == "token_count") & F.col("has_total_usage")

    def valid(name: str) -> Column:
        v = F.col(name)
        return F.when(counted & (v >= 0) & (v < float("inf")) & ~F.isnan(v), v)

    return carry_forward(
        records, SESSION, "line_no", {f"running_{c}": valid(c) for c in columns}
    )
