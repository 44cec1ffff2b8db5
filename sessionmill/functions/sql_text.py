"""Expressions as SQL text.

The redaction rules are made of several hundred function calls. As text each step reaches Spark in
one call, where Column objects would need a call to the JVM per function. `c`, `s` and the like
stand for SQL: a column name or a lambda variable.
"""

from __future__ import annotations

import hashlib

from sessionmill.functions.hashing import PSEUDONYM_PREFIX, SESSION_NAMESPACE


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(c: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {literal(m)})" for m in markers) + ")"


def shannon_entropy(s: str) -> str:
    share = f"CAST(length({s}) - length(replace({s}, ch, '')) AS DOUBLE) / length({s})"
    return (
        f"aggregate(transform(filter(array_distinct(split({s}, '', -1)), ch -> ch <> ''), ch -> {share}), "
        "0D, (acc, p) -> acc - p * log2(p))"
    )


def is_high_entropy(s: str, bits: float, hex_length: int, hex_bits: float) -> str:
    entropy = shannon_entropy(s)
    return (
        f"CASE WHEN {s} RLIKE '^[0-9a-fA-F]+$' THEN length({s}) >= {hex_length} AND {entropy} >= {hex_bits}D "
        f"ELSE length({s}) >= 20 AND {entropy} >= {bits}D END"
    )


def hmac_sha256(message: str, key: str) -> str:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()
    return (
        f"sha2(unhex('{outer}') || unhex(sha2(unhex('{inner}') || encode({message}, 'UTF-8'), 256)), 256)"
    )


def pseudonym(category: str, value: str, key: str) -> str:
    """`category` is plain text here, `value` is SQL."""
    prefix = PSEUDONYM_PREFIX.get(category)
    if prefix is None:
        prefix = "".join(ch for ch in category if ch.isalnum()) + "_"
    message = f"{literal(category + ' ')} || {value}"
    return f"({literal(prefix)} || substr({hmac_sha256(message, key)}, 1, 10))"


def any_pseudonym(category: str, value: str, key: str) -> str:
    """The same with `category` as SQL."""
    cases = " ".join(f"WHEN {literal(c)} THEN {literal(p)}" for c, p in PSEUDONYM_PREFIX.items())
    message = f"{category} || ' ' || {value}"
    return (
        f"CASE {category} {cases} ELSE regexp_replace({category}, '[^A-Za-z0-9]', '') || '_' END || "
        f"substr({hmac_sha256(message, key)}, 1, 10)"
    )


def session_uuid(path: str) -> str:
    h = f"sha1(unhex('{SESSION_NAMESPACE.replace('-', '')}') || encode({path}, 'UTF-8'))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', CAST(conv(substr({h}, 17, 1), 16, 10) AS INT) % 4 + 1, 1) || substr({h}, 18, 3) "
        f"|| '-' || substr({h}, 21, 12)"
    )


def token_pairs(c: str, pattern: str, replaced: str) -> str:
    """ARRAY<STRUCT<was, now>> of the matches; `replaced` is SQL over the match `m`."""
    return f"transform(regexp_extract_all({c}, {pattern}, 0), m -> named_struct('was', m, 'now', {replaced}))"


def put_back(c: str, pattern: str, pairs: str) -> str:
    """The text with each match exchanged for its `now`."""
    return (
        f"array_join(zip_with(split({c}, {pattern}, -1), {pairs}, "
        "(a, b) -> a || coalesce(b.now, '')), '')"
    )
