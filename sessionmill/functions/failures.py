"""Why a session upload failed, and whether a request is worth a retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionmill.functions.text import ASCII_BOUNDARY

# Our report: place, cause and remedy of each failure reason ({id} is the short id).
FAILURE_INFO = [
    ("parse", 0, "malformed log", "Fix the source file or exclude {id} and run again."),
    ("conflict", 1, "already uploaded (HTTP 409)", "Safe to ignore; clears on the next run."),
    ("presign-expired", 2, "upload URL expired (HTTP 403)", "Transient; the next run asks for a new URL."),
    ("network", 3, "server error or timeout", "Transient; the next run tries again."),
    ("anonymization", 4, "redaction failed, nothing was sent", "Inspect the source of {id}."),
    ("unknown", 5, "unexpected error", "Run again; report it if it stays."),
]


def failure_reason(error_class: Column, status: Column, message: Column) -> Column:
    """Typed errors first, then parse wording, then the HTTP status."""
    words = rf"(?i){ASCII_BOUNDARY}(?:parse|malformed|unexpected token){ASCII_BOUNDARY}"
    parse_like = (error_class == "SyntaxError") | (
        error_class.isNotNull() & (error_class != "NetworkError") & message.rlike(words)
    )
    return (
        F.when(error_class == "AnonymizationError", "anonymization")
        .when(error_class == "PresignExpiredError", "presign-expired")
        .when(F.coalesce(parse_like, F.lit(False)), "parse")
        .when(status == 409, "conflict")
        .when(status == 403, "presign-expired")
        .when(status.isNotNull() | error_class.isNotNull(), "network")
        .otherwise("unknown")
    )


def failure_message(error_class: Column, status: Column, message: Column) -> Column:
    reason = failure_reason(error_class, status, message)
    from_status = reason.isin("conflict", "network", "presign-expired") & status.isNotNull()
    return F.when(
        from_status & ~F.coalesce(error_class == "PresignExpiredError", F.lit(False)),
        F.concat(F.lit("HTTP "), status.cast("string")),
    ).when(error_class.isNotNull(), message)


def should_retry(status: Column) -> Column:
    return F.when(status.isNull(), True).otherwise(
        (status == 429) | status.between(500, 599)
    )
