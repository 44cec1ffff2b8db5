"""Ranking and impact of cost-saving recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.operators.ordering import ranked

SNOOZE_DAYS = 30


def ranked_by_savings(recs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """#1..n by savings, ties by id; per key (an org, a user) or over everything."""
    order = [F.col("estimated_savings_usd").desc(), F.col("id").asc()]
    return ranked(recs, keys or [], order, "rank")


def savings_totals(recs: DataFrame) -> DataFrame:
    return recs.groupBy("status").agg(
        F.count("*").alias("recommendations"), F.sum("estimated_savings_usd").alias("total_usd")
    )


def impact(recs: DataFrame) -> DataFrame:
    """Measured effect of each applied recommendation; impact is a struct or null."""
    im = F.col("impact")
    available = F.coalesce(im["measurement_status"] == "available", F.lit(False))
    realized = F.when(available, F.coalesce(im["realized_savings_usd"], F.lit(0.0)))
    base = im["baseline_cost_usd"]
    return recs.select(
        *recs.columns,
        F.when(im.isNull(), "not-started")
        .when(available, "available")
        .otherwise("measuring")
        .alias("measurement"),
        realized.alias("realized_usd"),
        F.when(available, F.when(base > 0, realized / base).otherwise(0.0)).alias("realized_share"),
    )


def impact_totals(recs: DataFrame) -> DataFrame:
    m = impact(recs)
    return m.agg(
        F.coalesce(F.sum("realized_usd"), F.lit(0.0)).alias("realized_usd"),
        F.count_if(F.col("measurement") == "measuring").alias("measuring"),
        F.count_if(F.col("measurement") == "available").alias("available"),
        F.count_if(F.col("measurement") == "not-started").alias("not_started"),
    )


def dismissed_until(dismissed_at: Column) -> Column:
    return dismissed_at + F.make_dt_interval(F.lit(SNOOZE_DAYS))


def visible(recs: DataFrame, now: Column) -> DataFrame:
    """Recommendations without those still snoozed."""
    until = dismissed_until(F.col("dismissed_at"))
    return recs.where(~F.coalesce((F.col("status") == "dismissed") & (until > now), F.lit(False)))
