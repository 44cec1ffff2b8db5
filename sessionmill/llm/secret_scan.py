"""Secrets in texts, and credentials in parts that give each other away, in DataFrame functions only.

Base spans (assign, access, hex) are secrets by themselves. Beside them there are weak candidates: identifiers
(`id`), short or bare secrets (`key`) and addresses of services (`endpoint`). One of these alone says
little, so it is reported only if a complementary part is near: an identifier or an endpoint needs a secret,
a weak secret needs an identifier or an endpoint. Base `access` spans count as identifiers and base
`assign` spans as secrets. Near means in the same scope (a paragraph: what lies between blank lines) and
with a gap of at most `REACH` characters.

Parts meet by an interval join within scopes: every part covers bins of `BIN` characters, and each side of the
join has one row per bin and role, the extent of all parts of this role there. As an interval widened by
`REACH` on both sides is never shorter than a bin, the extent decides exactly, and no row per pair is made.

Positions come from the lengths of matches and of what lies between them, added up in blocks of `_BLOCK`
so that a text of very many matches costs no quadratic time. Only documents that mention an identifier or an
endpoint look for parts, and only the parts shuffle, never a text.

Defined cases: a null text counts as empty and has no spans. Rows with null or equal ids all come out; rows equal
in id and text share one linking. An empty table gives an empty result. Other columns are not read. Letters
in any case are ASCII letters. Texts are searched as a whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionmill.llm.common import checkpointed, plain_columns, row_keys, text_or_empty

KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
REACH = 400
BIN = 512  # at most 2 * REACH
_BLOCK = 256
_SPAN = "array<struct<start:int,rank:int,end:int>>"

# The patterns of the base spans.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # later starts in a run that is too short are shorter still
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
BREAK = r"\n[\x20\t\r]*\n"
URL = r"""(?i:https?|s?ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20"'<>]+"""
ID = r"(?i:access_?key_?id|client_?id|user_?name|user|login|account)" + _SIGN + r"[A-Za-z0-9_.@-]{3,}|A[KS]IA[A-Z0-9]{8,}"
HOST = r"(?i:host|hostname|endpoint|server)" + _SIGN + r"[A-Za-z0-9.:/_-]{3,}"
NAMED_KEY = r"(?i:(?:secret|private|auth|access|api)_?(?:access_?)?key|client_?secret|password|passwd|pwd|secret|token)" + _SIGN + r"[A-Za-z0-9+/_.=-]{4,}"
BARE_KEY = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PARTS = "|".join([BREAK, URL, ID, HOST, NAMED_KEY, BARE_KEY])
_MENTIONS = ["://", "user", "login", "account", "host", "endpoint", "server", "key", "client", "akia", "asia"]
_ASSIGNING = ["passw", "secret", "token", "api"]

_ID, _SECRET, _ENDPOINT = 1, 2, 4
#: Role of each kind, and the roles of which a weak one needs one near.
_ROLE = {"assign": _SECRET, "access": _ID, "id": _ID, "key": _SECRET, "endpoint": _ENDPOINT}
_NEEDS = {"id": _SECRET, "key": _ID | _ENDPOINT, "endpoint": _SECRET}


def located(text: Column, pattern: str) -> Column:
    """All matches in order: array of (start, end, hit) in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(one)).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    block = "array<struct<at:int,out:array<struct<start:int,end:int,hit:string>>>>"

    def per_block(held: Column, some: Column) -> Column:
        at = F.coalesce(F.try_element_at(held, F.lit(-1))["at"], F.lit(0))
        return F.concat(held, F.array(F.aggregate(some, F.struct(at.alias("at"), empty.alias("out")), step)))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(_BLOCK)), lambda k: F.slice(all_, k, _BLOCK))

    # `found` is bound once, so that no pattern runs again for every block.
    blocks = F.flatten(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, cut(f)).otherwise(F.array().cast("array<array<struct<gap:int,hit:string>>>"))))
    return F.flatten(F.transform(F.aggregate(blocks, F.array().cast(block), per_block), lambda b: b["out"]))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))


def _part_rank(hit: Column) -> Column:
    """What a match of PARTS is: a rank of KINDS, -1 for a blank line, null for a bare run that looks like no secret."""
    is_ = lambda pattern: hit.rlike(f"^(?:{pattern})")
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]") & (F.length(hit) <= 100)
    kind = (
        F.when(hit.startswith("\n"), -1)
        .when(is_(URL), KINDS.index("endpoint"))
        .when(is_(ID), KINDS.index("id"))
        .when(is_(HOST), KINDS.index("endpoint"))
        .when(is_(NAMED_KEY) | mixed, KINDS.index("key"))
    )
    return kind


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keys of the row, base spans in order, and its possible parts (null: none can be linked)."""
    k1, k2 = row_keys()
    rows = plain_columns(docs, "doc_id", "text").select("doc_id", k1.alias("k1"), k2.alias("k2"), text_or_empty().alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    text, low, none = F.col("text"), F.col("low"), F.array().cast(_SPAN)

    def says(words: list[str]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.contains(low, F.lit(word))
        return out

    long_enough = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGNED
    base = rows.select(
        "doc_id",
        "k1",
        "k2",
        F.when(says(_ASSIGNING), _spans(F.filter(located(text, ASSIGN), long_enough), "assign")).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _spans(located(text, ACCESS), "access")).otherwise(none).alias("access"),
        F.when(text.rlike("[0-9a-f]{16}"), _spans(located(text, HEX), "hex")).otherwise(none).alias("hex"),
        F.when(says(_MENTIONS) & text.rlike("|".join([URL, ID, HOST])), located(text, PARTS)).alias("parts"),
    )
    ranked = F.transform("parts", lambda x: F.struct(x["start"].alias("start"), _part_rank(x["hit"]).alias("rank"), x["end"].alias("end")))
    parts = F.filter(ranked, lambda x: x["rank"].isNotNull())
    named = base.select(
        "doc_id", "k1", "k2", "assign", "access", "hex", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), parts.alias("parts")
    )
    roles = lambda kind: F.exists("parts", lambda x: x["rank"] == KINDS.index(kind))
    secret = roles("key") | (F.size("assign") > 0)
    other = roles("id") | roles("endpoint") | (F.size("access") > 0)
    return named.withColumn("parts", F.when(secret & other, F.col("parts")))


def _looked_up(column: Column, values: dict[str, int]) -> Column:
    out = F.lit(0)
    for kind, value in values.items():
        out = F.when(column == KINDS.index(kind), value).otherwise(out)
    return out


def linked(scanned: DataFrame) -> DataFrame:
    """k1, k2, added: the weak spans of a row that have a complementary part near."""
    once = scanned.where("parts is not null").select("k1", "k2", F.concat("base", "parts").alias("all")).dropDuplicates(["k1", "k2"])
    parts = once.select("k1", "k2", F.explode("all").alias("x")).select("k1", "k2", "x.*")
    order = Window.partitionBy("k1", "k2").orderBy("start")
    till, since = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    strong = F.col("rank").between(0, 2)
    placed = parts.select(
        "*",
        F.sum((F.col("rank") == -1).cast("int")).over(till).alias("scope"),
        F.max(F.when(strong, F.col("end"))).over(till).alias("covered"),
        F.min(F.when(strong, F.col("start"))).over(since).alias("next"),
    )
    inside = F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    kept = placed.where((F.col("rank") >= 0) & (strong | ~inside)).select(
        "k1", "k2", "scope", "start", "end", "rank", _looked_up(F.col("rank"), _ROLE).alias("role"), _looked_up(F.col("rank"), _NEEDS).alias("needs")
    )
    bins = lambda start, end: F.explode(F.sequence(F.floor(start / BIN), F.floor((end - 1) / BIN)))
    extents = (
        kept.where("role > 0")
        .select("k1", "k2", "scope", "role", "start", "end", bins(F.col("start"), F.col("end")).alias("bin"))
        .groupBy("k1", "k2", "scope", "bin", "role")
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
        .withColumnRenamed("role", "other")
    )
    wide = kept.where("needs > 0").withColumns({"low": F.col("start") - REACH, "high": F.col("end") + REACH})
    wide = wide.withColumn("bin", bins(F.greatest("low", F.lit(0)), F.col("high")))
    near = (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")) & (F.col("needs").bitwiseAND(F.col("other")) > 0)
    met = wide.join(extents, ["k1", "k2", "scope", "bin"]).where(near).select("k1", "k2", "start", "rank", "end").distinct()
    return met.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))


def _line(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    scanned = checkpointed(scan(docs))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    plain = ["doc_id", "k1", "k2", "base", *counts, F.sha2(_line(F.col("base")), 256).alias("base_sha256")]
    alone = scanned.where("parts is null").select(*plain).withColumn("added", F.array().cast(_SPAN))
    rest = scanned.where("parts is not null").select(*plain).join(linked(scanned), ["k1", "k2"], "left")
    rows = alone.unionByName(rest.withColumn("added", F.coalesce("added", F.array().cast(_SPAN))))
    return rows.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS[:3]],
        "base_sha256",
        _line(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"),
    )
