"""String expressions shared by the operators. Every helper maps Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JavaScript trim() removes, written for a Java character class.
UNICODE_BLANKS = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Java's \b is Unicode aware; this is the ASCII word boundary.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def trim_blank(c: Column) -> Column:
    """Strip Unicode blanks and the BOM on both sides (Spark's trim only strips spaces).

    One match from the begin to the last character that is no blank, so that what lies between is not tested against
    the class. Before a next-line character at the end (a line break to Java, but no blank) blanks go as well.
    """
    kept = F.regexp_extract(c, rf"(?s)\A[{UNICODE_BLANKS}]*+(.*[^{UNICODE_BLANKS}])?", 1)
    return F.when(F.endswith(c, F.lit("\u0085")), F.regexp_replace(c, f"^[{UNICODE_BLANKS}]+|[{UNICODE_BLANKS}]+$", "")).otherwise(kept)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, the unit in which the logs' own tools count."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def shannon_entropy(c: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    chars = F.array_distinct(F.split(c, "", -1))
    total = F.length(c).cast("double")

    def share(ch: Column) -> Column:
        return (F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double") / total

    shares = F.transform(F.filter(chars, lambda ch: ch != ""), share)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def scrub_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\u0000-\u001f\u007f-\u009f]", " ")


def short_id(c: Column) -> Column:
    """Head and tail of a long session id."""
    return F.when(
        F.length(c) > 16, F.concat(F.substring(c, 1, 9), F.lit("…"), F.right(c, F.lit(4)))
    ).otherwise(c)


def human_bytes(n: Column) -> Column:
    kib, mib, gib = 1024, 1024**2, 1024**3

    def scaled(unit: int, suffix: str) -> Column:
        return F.concat(F.format_string("%.1f", n / F.lit(float(unit))), F.lit(suffix))

    return (
        F.when(n < kib, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < mib, scaled(kib, " KB"))
        .when(n < gib, scaled(mib, " MB"))
        .otherwise(scaled(gib, " GB"))
    )


def human_savings(usd: Column) -> Column:
    return F.when(usd < 0.01, F.lit("<$0.01")).otherwise(
        F.concat(F.lit("$"), F.format_string("%.2f", usd))
    )


def human_category(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[_-]+", " ")))


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds of an ISO instant with an offset; null when it does not parse."""
    is_instant = c.rlike(
        r"^[+-]?\d{4,6}-\d\d-\d\d[Tt ]\d\d(?::?\d\d(?::?\d\d(?:[.,]\d{1,9})?)?)?(?:[Zz]|[+-]\d\d(?::?\d\d)?)$"
    )
    return F.when(is_instant, F.unix_millis(F.try_to_timestamp(c)))


def iso_millis(ms: Column) -> Column:
    """ISO instant with three fraction digits, from epoch milliseconds (fractions cut off)."""
    stamp = F.timestamp_millis(ms.cast("bigint"))
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def report_date(c: Column) -> Column:
    """'May 26, 14:08' in UTC; text that is no instant is passed through."""
    ms = epoch_ms(c)
    stamp = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.coalesce(F.date_format(stamp, "MMM d, HH:mm"), c)
