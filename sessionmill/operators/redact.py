"""Redaction over DataFrames: flat text, nested JSON records, audit and batch totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.functions.json_text import STRING_LITERAL, json_string
from sessionmill.functions.redaction_rules import (
    CATEGORIES,
    EMAIL_CATEGORY,
    PATH_CATEGORIES,
    Rule,
    standard_rules,
)
from sessionmill.functions.sql_text import literal


@dataclass(frozen=True)
class RedactionContext:
    """What one batch needs. The upload id is the pseudonym key and must not be written out.

    Owner and homes are texts; where they differ by row, name the columns that hold them instead.
    """

    upload_id: str
    owner_email: str = ""
    homes: tuple[str, ...] = ()
    owner_column: str | None = None
    home_columns: tuple[str, ...] = ()

    def rules(self) -> list[Rule]:
        if not self.upload_id:
            raise ValueError("redaction needs an upload id")
        missing = "redaction needs the owner''s e-mail"
        if self.owner_column:
            # A row without an owner aborts the job instead of passing through half redacted.
            c = f"`{self.owner_column}`"
            owner = f"CASE WHEN coalesce({c}, '') <> '' THEN {c} ELSE raise_error('{missing}') END"
        elif self.owner_email:
            owner = literal(self.owner_email)
        else:
            raise ValueError(missing.replace("''", "'"))
        homes = [literal(h) for h in dict.fromkeys(self.homes) if h]
        return standard_rules(self.upload_id, owner, homes + [f"`{c}`" for c in self.home_columns])


def count_column(category: str) -> str:
    return "n_" + category.replace("-", "_")


def _zero_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    names = dict.fromkeys(c for r in rules for c in r.categories)
    return df.withColumns({count_column(c): F.lit(0).cast("bigint") for c in names})


def redact_text(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """Rewrite a text column in place and add one counter column per category.

    One narrow projection per step, no shuffle. A null text stays null.
    """
    df = _zero_counts(df, rules)
    name = f"`{column}`"
    for rule in rules:
        for step in rule.steps:
            out = {
                count_column(cat): F.expr(f"{count_column(cat)} + {step.count(i, '_found')}")
                for i, cat in enumerate(step.categories)
            }
            out[column] = F.expr(step.text(name, "_found"))
            df = df.withColumn("_found", F.expr(step.found(name))).withColumns(out)
    return df.drop("_found")


def redact_json(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """Rewrite every string value and object key of a JSON text column, at any depth.

    The text is cut at its string literals; the literals are decoded, run through the rules with
    `transform`, encoded again and put back. Numbers, booleans and array order stay as they are.
    """
    df = _zero_counts(df, rules)
    # Escaped solidus and \u escapes are decoded by parsing all literals as one JSON array.
    found = F.regexp_extract_all(F.col(column), F.lit(STRING_LITERAL), F.lit(0))
    strings = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    gaps = F.transform(
        F.split(F.col(column), STRING_LITERAL, -1), lambda g: F.regexp_replace(g, r"\s+", "")
    )
    df = df.withColumns({"_gaps": gaps, "_strings": strings})
    for rule in rules:
        for step in rule.steps:
            out = {}
            for i, cat in enumerate(step.categories):
                total = f"aggregate(transform(_found, f -> {step.count(i, 'f')}), 0L, (a, n) -> a + n)"
                out[count_column(cat)] = F.expr(f"{count_column(cat)} + coalesce({total}, 0L)")
            out["_strings"] = F.expr(f"zip_with(_strings, _found, (s, f) -> {step.text('s', 'f')})")
            df = df.withColumn("_found", F.expr(f"transform(_strings, s -> {step.found('s')})")).withColumns(out)
    encoded = F.transform("_strings", json_string)
    rebuilt = F.array_join(
        F.zip_with("_gaps", encoded, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""
    )
    return df.withColumn(column, rebuilt).drop("_gaps", "_strings", "_found")


def with_payload_digest(df: DataFrame, column: str) -> DataFrame:
    """Hash and size of the redacted payload, and the policy that made it."""
    return df.withColumns(
        {
            "redacted_hash": F.sha2(F.col(column), 256),
            "byte_size": F.octet_length(F.col(column)).cast("bigint"),
            "policy_version": F.lit(POLICY_VERSION),
        }
    )


def redaction_counts(df: DataFrame) -> Column:
    """The counters of a row as one map, categories in policy order."""
    present = [c for c in CATEGORIES if count_column(c) in df.columns]
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in present]),
        F.array(*[F.col(count_column(c)) for c in present]),
    )


def positive_counts(counts: Column) -> Column:
    return F.map_filter(counts, lambda _k, n: n > 0)


def batch_totals(df: DataFrame) -> DataFrame:
    """One row per category with its total over the batch: sums first, then a 16-row unpivot."""
    names = [c for c in CATEGORIES if count_column(c) in df.columns]
    sums = df.agg(*[F.coalesce(F.sum(count_column(c)), F.lit(0)).alias(c) for c in names])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("total")) for c in names]
    )
    return sums.select(F.inline(pairs))


def leak_audit(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """What the rules would still find in already redacted text, one row per category.

    Every total must be 0; `assert_no_leak` turns that into a job failure.
    """
    return batch_totals(redact_text(df.select(column), column, rules))


def assert_no_leak(df: DataFrame, column: str, rules: list[Rule], audit: DataFrame | None = None) -> None:
    """`audit` is what `leak_audit` found in this text, where that is at hand already; else it is run here."""
    audit = leak_audit(df, column, rules) if audit is None else audit
    left = audit.where("total > 0").limit(len(CATEGORIES)).collect()
    if left:
        raise ValueError(f"redaction left matches: {[(r.category, r.total) for r in left]}")


def assert_no_leak_json(df: DataFrame, column: str, rules: list[Rule]) -> None:
    """The audit for redacted JSON text: a second pass over its strings must find nothing."""
    totals = batch_totals(redact_json(df.select(column), column, rules))
    left = totals.where("total > 0").limit(len(CATEGORIES)).collect()
    if left:
        raise ValueError(f"redaction left matches: {[(r.category, r.total) for r in left]}")


__all__ = [
    "EMAIL_CATEGORY",
    "PATH_CATEGORIES",
    "RedactionContext",
    "assert_no_leak",
    "assert_no_leak_json",
    "batch_totals",
    "leak_audit",
    "positive_counts",
    "redact_json",
    "redact_text",
    "redaction_counts",
    "with_payload_digest",
]
