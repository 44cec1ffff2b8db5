"""The main scalars as temporary SQL functions, for use in spark.sql(...)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sessionmill.functions import sql_text as Q
from sessionmill.functions.redaction_rules import (
    ENTROPY_BITS,
    HEX_ENTROPY_BITS,
    HEX_MIN_LENGTH,
    Rule,
    emails_rule,
    entropy_rule,
)


def _rewrite(rule: Rule, s: str) -> str:
    """The text behind a rule of one step, as one expression."""
    step = rule.steps[0]
    found = f"array({step.found(s)})"
    return f"transform({found}, f -> {step.text(s, 'f')})[0]"


def register_sql_functions(spark: SparkSession, upload_id: str, owner_email: str) -> list[str]:
    """Create the functions and return their names. They are SQL, so no Python runs per row.

    The upload id is bound here and is not an argument, which keeps the key out of query text.
    """
    definitions = {
        "shannon_entropy(s STRING) RETURNS DOUBLE": Q.shannon_entropy("s"),
        "is_high_entropy(s STRING) RETURNS BOOLEAN": Q.is_high_entropy(
            "s", ENTROPY_BITS, HEX_MIN_LENGTH, HEX_ENTROPY_BITS
        ),
        "session_uuid(path STRING) RETURNS STRING": Q.session_uuid("path"),
        "pseudonym(category STRING, value STRING) RETURNS STRING": Q.any_pseudonym(
            "category", "value", upload_id
        ),
        "redact_emails(s STRING) RETURNS STRING": _rewrite(
            emails_rule(Q.literal(owner_email), upload_id), "s"
        ),
        "redact_entropy(s STRING) RETURNS STRING": _rewrite(entropy_rule(), "s"),
    }
    for signature, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in definitions]
