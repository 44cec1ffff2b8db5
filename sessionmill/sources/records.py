"""NDJSON session files to records, and records to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionmill.functions.hashing import POLICY_VERSION
from sessionmill.functions.json_text import is_json, string_or_null
from sessionmill.functions.rows import unnest
from sessionmill.functions.text import lines, trim_blank
from sessionmill.sources.blocks import block_hash_of, block_hashes, file_blocks
from sessionmill.sources.files import existing, few_listing_tasks, scanned_path

#: Larger files are read in splits. Lines, numbers and hashes are the same either way.
WHOLE_FILE_LIMIT = 32 * 1024 * 1024
CHUNK_LINES = 65_536

RECORD_ROWS = (
    "source_kind string, path string, line_no bigint, raw string, is_malformed boolean, file_hash string, "
    "raw_hash string, is_split boolean"
)
# Text fields are VARIANT so that a number or object in their place can be told from a string.
RECORD_SCHEMA = """
  type STRING, role STRING, timestamp VARIANT, sessionId VARIANT, cwd VARIANT, gitBranch VARIANT,
  projectHash VARIANT,
  message STRUCT<role: STRING, model: VARIANT, usage: STRUCT<
    input_tokens: DOUBLE, output_tokens: DOUBLE,
    cache_creation_input_tokens: DOUBLE, cache_read_input_tokens: DOUBLE>>,
  payload STRUCT<id: VARIANT, cwd: VARIANT, model: VARIANT, type: STRING,
    git: STRUCT<branch: VARIANT>,
    info: STRUCT<total_token_usage: STRUCT<
      input_tokens: DOUBLE, cached_input_tokens: DOUBLE, output_tokens: DOUBLE,
      reasoning_output_tokens: DOUBLE, total_tokens: DOUBLE>>>
"""


def _record(line: Column, ok: Column) -> dict[str, Column]:
    """A line that is no JSON value is kept as {"_raw": line}."""
    return {
        "raw": F.when(ok, line).otherwise(F.to_json(F.struct(line.alias("_raw")))),
        "is_malformed": ~ok,
    }


def _text_records(text: Column) -> Column:
    """ARRAY<STRUCT<line_no, raw, is_malformed>> of a whole text, blank lines left out."""
    numbered = F.transform(
        lines(text),
        lambda s, i: F.struct(i.cast("bigint").alias("line_no"), trim_blank(s).alias("line")),
    )
    # The check is a step of its own, so each line is parsed once.
    checked = F.transform(
        F.filter(numbered, lambda x: x["line"] != ""),
        lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), is_json(x["line"]).alias("ok")),
    )
    return F.transform(
        checked,
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            *[c.alias(n) for n, c in _record(x["line"], x["ok"]).items()],
        ),
    )


def _chunk_digest(raws: Column) -> Column:
    return F.sha2(F.concat(F.lit(POLICY_VERSION + "\n["), F.array_join(raws, ","), F.lit("]")), 256)


def _hash_of_digests(digests: Column) -> Column:
    """The content hash: policy and the digests of all chunks, for sessions of any length."""
    return F.sha2(F.concat(F.lit(POLICY_VERSION + "/chunks\n"), F.array_join(digests, "")), 256)


def _hash_of(records: Column) -> Column:
    """Content hash of an array of records that stand in line order."""
    last = F.coalesce(F.try_element_at(F.transform(records, lambda x: x["line_no"]), F.lit(-1)), F.lit(0))
    chunks = F.transform(
        F.sequence(F.lit(0), (last / CHUNK_LINES).cast("int")),
        lambda c: F.transform(
            F.filter(records, lambda x: F.floor(x["line_no"] / CHUNK_LINES) == c), lambda x: x["raw"]
        ),
    )
    full = F.filter(chunks, lambda raws: F.size(raws) > 0)  # a chunk of blank lines has no digest
    return _hash_of_digests(F.transform(full, _chunk_digest))


def explode_ndjson(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per non-blank line of a whole-file text column. No shuffle.

    The first row of a file also carries the content hash of the file. It is made here, where the
    whole text is at hand; if nobody reads it, it is not computed.
    """
    keep = [c for c in texts.columns if c != column]
    rows = texts.select(*keep, _text_records(F.col(column)).alias("_records"))
    file_hash = _hash_of(F.col("_records"))
    exploded = unnest(rows.withColumn("_hash", file_hash), [*keep, "_hash"], "_records", "_r")
    return exploded.select(
        *keep, "_r.line_no", "_r.raw", "_r.is_malformed",
        F.when(F.col("_pos") == 0, F.col("_hash")).alias("file_hash"),
    )


def explode_json_array(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per element of a JSON array file; a file that is no array gives no rows."""
    keep = [c for c in texts.columns if c != column]
    text = F.col(column)
    items = F.when(is_json(text), F.from_json(text, "array<variant>"))
    return unnest(texts, keep, items, "_item", "line_no").select(
        *keep,
        F.col("line_no").cast("bigint").alias("line_no"),
        F.to_json("_item").alias("raw"),
        F.lit(False).alias("is_malformed"),
    )


def whole_records(texts: DataFrame) -> DataFrame:
    """Records of files (source_kind, path, value) that stand in a row each."""
    whole = texts.withColumn("raw_hash", block_hash_of(F.col("value")))
    return explode_ndjson(whole, "value").select(
        "source_kind", "path", "line_no", "raw", "is_malformed", "file_hash",
        F.when(F.col("file_hash").isNotNull(), F.col("raw_hash")).alias("raw_hash"),
        F.lit(False).alias("is_split"),
    )


def open_ndjson(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """The files of a glob as whole texts, listed once; None if there is no such root."""
    with few_listing_tasks(spark):
        return existing(lambda: spark.read.option("ignoreMissingFiles", True).text(paths, wholetext=True))


def read_ndjson(
    spark: SparkSession,
    paths: str | list[str],
    source_kind: str,
    whole_limit: int | None = WHOLE_FILE_LIMIT,
    only: DataFrame | None = None,
    since_ms: float | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """Records of NDJSON files below a glob. Small files are read whole, large ones in splits.

    The split branch never holds a file in one row: a line's number is its place in its block plus
    the lines of the file's earlier blocks, which come from one row per block. So both branches
    number lines alike, however the splits fall. `only` (path) and `since_ms` choose files before
    anything is parsed; the time bound also prunes the listing. Names are never taken as patterns,
    and a chosen file that is gone is just not there. A missing root gives no records. `found` is the glob
    opened before (`open_ndjson`), which spares listing it again. Without a `whole_limit` all files are read whole,
    and the glob is not opened a second time for splits.
    """
    found = open_ndjson(spark, paths) if found is None else found
    if found is None:
        return spark.createDataFrame([], RECORD_ROWS)
    path = scanned_path(F.col("_metadata.file_path"))
    size = F.col("_metadata.file_size")

    def chosen(files: DataFrame, fits: Column, *more: Column) -> DataFrame:
        files = files.where(fits)
        if since_ms is not None:
            bound = F.timestamp_millis(F.lit(int(since_ms)))
            files = files.where(F.col("_metadata.file_modification_time") >= bound)
        files = files.select(F.lit(source_kind).alias("source_kind"), path.alias("path"), "value", *more)
        return files if only is None else files.join(only.select("path"), "path", "left_semi")

    small = whole_records(chosen(found, F.lit(True) if whole_limit is None else size <= whole_limit))
    if whole_limit is None:
        return small
    with few_listing_tasks(spark):
        opened = spark.read.option("ignoreMissingFiles", True).option("lineSep", "\n").text(paths)
    split = chosen(
        opened,
        size > whole_limit,
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = split.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    line = trim_blank(F.col("value"))
    large = (
        split.join(blocks, ["path", "_block"])
        .select(
            "source_kind", "path",
            (F.col("_base") + F.col("_row") - F.col("_first")).alias("line_no"),
            line.alias("_line"),
        )
        .where("_line <> ''")
    )
    large = large.withColumn("_ok", is_json(F.col("_line"))).select(
        "source_kind", "path", "line_no",
        *[c.alias(n) for n, c in _record(F.col("_line"), F.col("_ok")).items()],
        F.lit(None).cast("string").alias("file_hash"),
        F.lit(None).cast("string").alias("raw_hash"),
        F.lit(True).alias("is_split"),
    )
    return small.unionByName(large)


def typed_records(records: DataFrame) -> DataFrame:
    """Typed columns of the record fields the operators use; `raw` stays next to them."""
    r = records.withColumn("_r", F.from_json("raw", RECORD_SCHEMA))
    usage, total = "_r.message.usage", "_r.payload.info.total_token_usage"
    is_event = F.col("_r.type") == "event_msg"
    is_meta = F.col("_r.type") == "session_meta"
    out = {
        "type": F.col("_r.type"),
        "role": F.col("_r.message.role"),
        "ts": string_or_null(F.col("_r.timestamp")),
        "native_id": string_or_null(F.col("_r.sessionId")),
        "cwd": string_or_null(F.col("_r.cwd")),
        "git_branch": string_or_null(F.col("_r.gitBranch")),
        "project_hash": string_or_null(F.col("_r.projectHash")),
        "model": string_or_null(F.col("_r.message.model")),
        "has_usage": F.col(usage).isNotNull(),
        "input_tokens": F.col(f"{usage}.input_tokens"),
        "output_tokens": F.col(f"{usage}.output_tokens"),
        "cache_creation_tokens": F.col(f"{usage}.cache_creation_input_tokens"),
        "cache_read_tokens": F.col(f"{usage}.cache_read_input_tokens"),
        "event_type": F.when(is_event, F.col("_r.payload.type")),
        "context_model": F.when(
            F.col("_r.type") == "turn_context", string_or_null(F.col("_r.payload.model"))
        ),
        "meta_id": F.when(is_meta, string_or_null(F.col("_r.payload.id"))),
        "meta_cwd": F.when(is_meta, string_or_null(F.col("_r.payload.cwd"))),
        "meta_branch": F.when(is_meta, string_or_null(F.col("_r.payload.git.branch"))),
        "has_total_usage": F.col(total).isNotNull(),
        "total_input_tokens": F.col(f"{total}.input_tokens"),
        "total_cached_tokens": F.col(f"{total}.cached_input_tokens"),
        "total_output_tokens": F.col(f"{total}.output_tokens"),
        "total_reasoning_tokens": F.col(f"{total}.reasoning_output_tokens"),
        "total_tokens": F.col(f"{total}.total_tokens"),
    }
    return r.select(*records.columns, *[c.alias(n) for n, c in out.items()])


def content_hash_of_text(text: Column) -> Column:
    """Change-detection hash of a whole NDJSON text.

    Works inside one row, so hashing files read whole needs no shuffle.
    """
    return _hash_of(_text_records(text))


def content_hash(records: DataFrame, keys: list[str], chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The same hash for sessions held as record rows.

    Lines are gathered per chunk of line numbers, never per session: a digest over each chunk's
    records, then one over the digests in order. One formula, whatever the length.
    """
    chunk = F.floor(F.col("line_no") / chunk_lines)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    digest = _chunk_digest(F.transform(ordered, lambda x: x["raw"]))
    chunks = records.groupBy(*keys, chunk.alias("_chunk")).agg(digest.alias("_digest"), F.count("*").alias("_n"))
    digests = F.array_sort(F.collect_list(F.struct("_chunk", "_digest")))
    return chunks.groupBy(*keys).agg(
        _hash_of_digests(F.transform(digests, lambda x: x["_digest"])).alias("content_hash"),
        F.sum("_n").alias("record_count"),
    )


def file_hashes(
    records: DataFrame, appended: DataFrame | None = None, texts: DataFrame | None = None, files: DataFrame | None = None
) -> DataFrame:
    """Content and raw hash per (source_kind, path).

    Files read whole carry both. Only files read in splits, and files with `appended` records (their
    sidecars), are hashed over their rows, found by a mark and not by a join. `texts` has the rows
    with `raw`, where `records` is a table that no longer holds it. The raw hash is that of the file's blocks,
    whole or split; for split files it is read from `files` (path, size_bytes), without which it is null.
    """
    keys = ["source_kind", "path"]
    texts = records if texts is None else texts
    carried = records.where("NOT is_split AND file_hash IS NOT NULL").select(
        *keys, F.col("file_hash").alias("content_hash"), "raw_hash"
    )
    again = texts.where("is_split").select(*keys, "line_no", "raw")
    if appended is not None:
        changed = appended.select(*keys).distinct()
        rows = texts.where("NOT is_split").select(*keys, "line_no", "raw").join(changed, keys, "left_semi")
        again = again.unionByName(rows).unionByName(appended.select(*keys, "line_no", "raw"))
    rehashed = content_hash(again, keys).select(*keys, F.col("content_hash").alias("_again"))
    joined = carried.join(rehashed, keys, "full")
    if files is not None:
        split = files.join(records.where("is_split").select("path").distinct(), "path", "left_semi")
        read = block_hashes(file_blocks(split)).withColumnRenamed("raw_hash", "_read")
        joined = joined.join(read, "path", "left").withColumn("raw_hash", F.coalesce("raw_hash", "_read"))
    return joined.select(*keys, F.coalesce("_again", "content_hash").alias("content_hash"), "raw_hash")
