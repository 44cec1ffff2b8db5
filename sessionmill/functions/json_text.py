"""Strict JSON checks and typed access that tells strings from other JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One JSON string literal. Possessive, so Java matches long literals without recursion.
STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


_END = "end of the line"


def is_json(line: Column) -> Column:
    """True for text that is exactly one JSON value.

    The parser stops behind the first value it can close. So the line is put into an array with a
    marker behind it: only if the line is one value does the marker come out as second element.
    A line that holds the marker itself is tried inside an array and an object; no text but a
    single value closes both. Lines that cannot begin a value are not parsed at all.
    """
    first = F.substring(line, 1, 1)
    may_be = first.isin(*'{["-0123456789tfn')
    marked = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f', "{_END}"]')))
    by_marker = F.try_variant_get(marked, "$[1]", "string") == _END
    in_array = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"k":'), line, F.lit("}")))
    # VARIANT refuses repeated keys, which are valid JSON. The other parser takes them, but also
    # single quotes and raw control characters, so those are ruled out by hand.
    text = F.concat(F.lit("["), line, F.lit(f', "{_END}"]'))
    outside = F.regexp_replace(line, STRING_LITERAL, "")
    repeated_keys = (
        F.contains(outside, F.lit("{"))
        & ~F.contains(outside, F.lit("'"))
        & ~line.rlike(r"[\x00-\x1f]")
        & (F.json_array_length(text) == 2)
        & (F.get_json_object(text, "$[1]") == _END)
    )
    has_marker = F.contains(line, F.lit(_END))
    return (
        F.when(~may_be, False)
        .when(has_marker, in_array.isNotNull() & in_object.isNotNull())
        .when(F.coalesce(by_marker, F.lit(False)), True)
        .otherwise(F.coalesce(repeated_keys, F.lit(False)))
    )


def string_or_null(v: Column) -> Column:
    """The text of a VARIANT that holds a non-empty JSON string; anything else is null."""
    text = F.try_variant_get(v, "$", "string")
    return F.when((F.schema_of_variant(v) == "STRING") & (text != ""), text)


def json_string(c: Column) -> Column:
    """JSON literal of a string."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
