"""Keyed pseudonyms, name-based UUIDs and digests as plain Spark expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policy version, UUID namespace and pseudonym prefixes that stored ids depend on.
POLICY_VERSION = "v0.2"
SESSION_NAMESPACE = "6e1f93b2-5a0e-5c3a-9b7e-2f0a8c4d6e10"
PSEUDONYM_PREFIX = {
    "project-name": "proj_",
    "third-party-email": "user_",
    "home-path": "path_",
}
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def hmac_sha256(message: Column, key: str) -> Column:
    """RFC 2104 HMAC. The padded keys are constants, so each row costs two sha2 calls."""
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in raw).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in raw).hex()))
    digest = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def pseudonym(category: str, value: Column, upload_id: str) -> Column:
    prefix = PSEUDONYM_PREFIX.get(category)
    if prefix is None:
        prefix = "".join(ch for ch in category if ch.isalnum()) + "_"
    digest = hmac_sha256(F.concat(F.lit(category + " "), value), upload_id)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 10))


def uuid5(name: Column, namespace: str = SESSION_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(x) for x in "89ab"]),
        F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1,
    )
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID_PATTERN)


def session_uuid(path: Column, fold_case: bool = False) -> Column:
    """Id of a session file from its absolute path; fold_case for case-insensitive file systems."""
    return uuid5(F.lower(path) if fold_case else path)
