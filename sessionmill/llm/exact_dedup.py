"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for every text hash, two cells out of a number that grows with the row count, and
keeps the cells that were set twice or more. Pass two probes each row: unless both of its cells
are kept, no other row has this text, and it passes straight through. The rest, repeated rows
and few false positives, shuffles by text hash for the exact answer.

Defined cases: a null text counts as empty. Of equal texts the row with the largest doc_id stays; a
null doc_id is smaller than any other. Of rows equal in both, one stays (in `exact_dedup` the largest
by the JSON of its remaining columns, which may be of any type). An empty table gives an empty result. Other columns are carried along and
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, free_name, text_or_empty

CELLS_PER_ROW = 16
#: The filter is broadcast in blocks of at most this many bytes, one probe each, so no row shuffles for it.
FILTER_LIMIT = 64 << 20
SALTS = 32
_WORD_ROW = 32  # bytes that one word of the filter takes at most in a broadcast


def _cells(digest: Column, cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(cells)) for seed in (1, 2)]


def repeated_cells(digests: DataFrame, cells: int) -> DataFrame:
    """Words (word, bits) of the filter: bit 1 for cells that two or more rows set."""
    cell = digests.select(F.explode(F.array(*_cells(F.col("digest"), cells))).alias("cell"))
    twice = cell.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("cell div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 AS int))")).alias("bits")
    )


def possibly_repeated(rows: DataFrame, digest: str, flag: str) -> DataFrame:
    """Add a boolean column: False only if no other row has the same digest."""
    hashes = rows.select(F.col(f"`{digest}`").alias("digest"))
    cells = max(64, CELLS_PER_ROW * hashes.count())
    found = checkpointed(repeated_cells(hashes, cells))
    blocks = max(1, -(-found.count() * _WORD_ROW // FILTER_LIMIT))
    out, hits = rows, []
    for i, cell in enumerate(_cells(F.col(f"`{digest}`"), cells)):
        at = free_name(rows, f"_at{i}")
        out, hit = out.withColumn(at, cell), F.lit(False)
        for k in range(blocks):
            word, bits = (free_name(rows, f"_{name}{i}_{k}") for name in ("word", "bits"))
            block = found.where(F.col("word") % blocks == k).select(F.col("word").alias(word), F.col("bits").alias(bits))
            out = out.join(F.broadcast(block), F.expr(f"`{at}` div 64 = `{word}`"), "left")
            hit = hit | F.coalesce(F.getbit(F.col(bits), (F.col(at) % 64).cast("int")) == 1, F.lit(False))
        hits.append(hit)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (hits[0] & hits[1]).alias(flag))


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("text_sha256"))
    flagged = possibly_repeated(rows, "text_sha256", "again")
    alone = flagged.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # Counts per (text, id) first: a large group of copies shrinks before and after the shuffle alike.
    per_id = flagged.where("again").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = per_id.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # The copies of a text spread over salts, so that a large group meets its answer in many tasks.
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = per_id.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = spread.join(salted, ["text_sha256", "salt"]).select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return alone.union(copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    digest, again, rest = (free_name(docs, name) for name in ("_digest", "_again", "_rest"))
    flagged = possibly_repeated(docs.withColumn(digest, F.sha2(text_or_empty(), 256)), digest, again)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = flagged.where(f"not `{again}`").select(*columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    kept = (
        flagged.where(f"`{again}`")
        .groupBy(digest)
        .agg(F.max_by(F.struct(*columns), F.struct("doc_id", F.to_json(F.struct(F.lit(1), *others)))).alias(rest))
        .select(*[F.col(rest).getField(c).alias(c) for c in docs.columns])
    )
    return alone.union(kept)
