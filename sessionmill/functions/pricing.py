"""Token prices, cost tiers and model vendors as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price rules in match order, USD per million tokens.
# (match kind, pattern, input, cache write, cache read, output)
PRICE_RULES = [
    ("family", "gpt-4o-mini", 0.15, 0.0, 0.075, 0.6),
    ("family", "gpt-4o", 2.5, 0.0, 1.25, 10.0),
    ("family", "gpt-5", 12.0, 0.0, 3.0, 48.0),
    ("family", "o3-mini", 1.1, 0.0, 0.55, 4.4),
    ("family", "o4-mini", 1.1, 0.0, 0.275, 4.4),
    ("family", "o1", 15.0, 0.0, 7.5, 60.0),
    ("family", "o3", 10.0, 0.0, 2.5, 40.0),
    ("contains", "opus", 15.0, 18.75, 1.5, 75.0),
    ("contains", "haiku", 0.8, 1.0, 0.08, 4.0),
    ("default", "", 3.0, 3.75, 0.3, 15.0),
]
EXCLUDE_FLOOR_USD = 0.01
MIN_FULL_UPLOAD_USD = 10.0


def price_rule(model: Column) -> Column:
    """Position of the price rule that applies to a model name."""
    m = F.lower(F.coalesce(model, F.lit("")))
    case = None
    for pos, (kind, pattern, *_rates) in enumerate(PRICE_RULES):
        if kind == "default":
            return case.otherwise(F.lit(pos))
        hit = F.contains(m, F.lit(pattern))
        if kind == "family":
            hit = (m == pattern) | F.startswith(m, F.lit(pattern + "-"))
        case = F.when(hit, F.lit(pos)) if case is None else case.when(hit, F.lit(pos))
    raise ValueError("price rules need a default")


def token_cost(
    model: Column, input_: Column, cache_write: Column, cache_read: Column, output: Column
) -> Column:
    """USD for one row of token counts; missing counts are 0."""
    counts = [F.coalesce(c, F.lit(0.0)) for c in (input_, cache_write, cache_read, output)]
    rule = price_rule(model)

    def rate(slot: int) -> Column:
        table = F.array(*[F.lit(float(r[2 + slot])) for r in PRICE_RULES])
        return F.get(table, rule)

    return reduce(lambda a, b: a + b, [c * rate(i) for i, c in enumerate(counts)]) / 1_000_000


def model_vendor(model: Column) -> Column:
    m = F.lower(model)
    return (
        F.when(F.contains(m, F.lit("claude")), "anthropic")
        .when(
            F.contains(m, F.lit("gpt")) | F.startswith(m, F.lit("o1")) | F.startswith(m, F.lit("o3")),
            "openai",
        )
        .when(F.contains(m, F.lit("gemini")), "google")
    )


def tier(cost_usd: Column, min_usd: float = MIN_FULL_UPLOAD_USD) -> Column:
    return (
        F.when(cost_usd < EXCLUDE_FLOOR_USD, "excluded")
        .when(cost_usd < min_usd, "metadata")
        .otherwise("full")
    )
