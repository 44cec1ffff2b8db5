"""File listings, raw hashes and size-only sidecar records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.paths import file_name, physical_path
from sessionmill.functions.text import utf16_length
from sessionmill.operators.ordering import durable
from sessionmill.sources.blocks import block_hash_of, block_hashes, file_blocks

# Shape of a sidecar record.
SIDECAR_TYPE = "tool_result_file"
SIDECAR_SCHEMA = 1

LISTING = "machine_id string, source_kind string, path string, size_bytes bigint, mtime_ms double"


def local_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def scanned_path(c: Column) -> Column:
    """Plain path out of _metadata.file_path, which is percent-encoded (a plus stands for itself)."""
    return local_path(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def existing(load: Callable[[], DataFrame]) -> DataFrame | None:
    """The result of a read, or None if its root or glob leads to no file."""
    try:
        return load()
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


#: Spark lists many paths by a job of one task per path, up to 10,000. This many per core suffice.
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS_PER_CORE = 4


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_listing_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it a glob is listed in tasks of many paths each. A smaller number that is set holds."""
    most = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return _with_setting(spark, _LISTING_TASKS, str(min(int(spark.conf.get(_LISTING_TASKS)), most)))


def list_files(
    spark: SparkSession, paths: str | list[str], source_kind: str, machine_id: str = ""
) -> DataFrame:
    """One row per file of a glob. File contents are not read.

    A missing root is an empty listing. Spark leaves out files of zero bytes; they hold no session.
    """
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    with few_listing_tasks(spark):
        found = existing(lambda: reader.load(paths))
    if found is None:
        return spark.createDataFrame([], LISTING)
    return found.select(
        F.lit(machine_id).alias("machine_id"),
        F.lit(source_kind).alias("source_kind"),
        local_path(F.col("path")).alias("path"),
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"),
    )


#: Spark counts 4 MB per file when it deals files to tasks, so 32 to a task; a listing reads none of them.
_FILE_COST = "spark.sql.files.openCostInBytes"
LISTED_FILE_COST = 32 * 1024


def kept_listing(spark: SparkSession, paths: str | list[str], source_kind: str) -> DataFrame:
    """The listing of a glob, made once, by tasks of some thousand files each."""
    with _with_setting(spark, _FILE_COST, str(LISTED_FILE_COST)):
        return durable(list_files(spark, paths, source_kind))


def raw_hashes(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """Raw hash of each ref's physical file; refs into one store share a single pass.

    `contents` has path and content (binary), or path and size_bytes, and then the files are read block by
    block, so that a store may have any size. Returns the ref's path and raw_hash.
    """
    wanted = refs.select("path", physical_path(F.col("path")).alias("_file")).distinct()
    files = wanted.select("_file").distinct()
    named = contents.join(files, contents["path"] == files["_file"], "left_semi")
    if "content" in contents.columns:
        hashed = named.select("path", block_hash_of(F.col("content")).alias("raw_hash"))
    else:
        hashed = block_hashes(file_blocks(named))
    hashed = hashed.withColumnRenamed("path", "_file")
    return wanted.join(hashed, "_file").select("path", "raw_hash")


def sidecar_records(contents: DataFrame) -> DataFrame:
    """Size records of `<dir>/<session>/tool-results/<id>.txt`, attached to `<dir>/<session>.jsonl`.

    Only the byte and character counts leave the file. line_no continues behind any transcript
    line, in name order: an index inside the session, offset by 2^62.
    """
    path = F.col("path")
    is_sidecar = path.rlike(r"/[^/]+/tool-results/[^/]+\.txt$")
    rows = contents.where(is_sidecar).select(
        F.concat(F.regexp_extract(path, r"^(.*)/tool-results/[^/]+$", 1), F.lit(".jsonl")).alias(
            "path"
        ),
        F.regexp_replace(file_name(path), r"\.txt$", "").alias("file_id"),
        F.octet_length("content").cast("bigint").alias("bytes"),
        utf16_length(F.decode(F.col("content"), "UTF-8")).alias("chars"),
    )
    return rows.select(
        "path",
        F.lit(SIDECAR_TYPE).alias("type"),
        F.lit(SIDECAR_SCHEMA).alias("schema"),
        "file_id",
        "bytes",
        "chars",
    )


def sidecars_as_records(sidecars: DataFrame, source_kind: str = "claude-code") -> DataFrame:
    """Sidecar sizes as record rows that follow the transcript lines in name order."""
    from sessionmill.operators.ordering import ranked

    numbered = ranked(sidecars, ["path"], [F.col("file_id").asc()], "_n")
    raw = F.to_json(F.struct("type", "schema", "file_id", "bytes", "chars"))
    return numbered.select(
        F.lit(source_kind).alias("source_kind"),
        "path",
        (F.lit(2**62) + F.col("_n")).alias("line_no"),
        raw.alias("raw"),
        F.lit(False).alias("is_malformed"),
    )
