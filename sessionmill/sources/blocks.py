"""Files as fixed blocks of bytes: one raw hash for files of any size, and what has changed in a file.

A file is cut into blocks of `BLOCK` bytes, which tasks read by themselves through a file system handle, so no
row holds more than a block. The raw hash is a tree: digests of blocks, digests of `FAN` of those, and one over
the size and these. It depends on the bytes alone, neither on splits nor on who computes it: content that is at
hand in a row gives the same value by `block_hash_of`.

The digests of a file's blocks, kept from one run to the next, tell how it has changed: a log that only grew keeps
all its blocks, and the last one as a beginning of the new one. Then only what follows is parsed, from the line
in which the first new byte lies.

A file that vanished has no blocks. A file of no bytes has a hash and no blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4 * 1024 * 1024
FAN = 4096
READING_TASKS_PER_CORE = 2

_READ = pa.schema(
    [
        ("path", pa.string()), ("size_bytes", pa.int64()), ("block", pa.int64()), ("digest", pa.string()),
        ("newlines", pa.int64()), ("last_newline", pa.int64()),
        ("prefix_digest", pa.string()), ("prefix_newlines", pa.int64()), ("prefix_last", pa.int64()),
    ]
)
BLOCKS = (
    "path string, size_bytes bigint, block bigint, digest string, newlines bigint, last_newline bigint, "
    "prefix_digest string, prefix_newlines bigint, prefix_last bigint"
)


def _root(size: Column, groups: Column) -> Column:
    return F.sha2(F.concat(F.lit("v1/blocks\n"), size.cast("string"), F.lit("\n"), F.array_join(groups, "")), 256)


def block_hash_of(content: Column, block: int = BLOCK, fan: int = FAN) -> Column:
    """The raw hash of a binary or text value."""
    data = content.cast("binary")
    size = F.octet_length(data)

    def steps(n: Column, width: int) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))

    leaves = F.transform(steps(size, block), lambda i: F.sha2(F.substring(data, i * block + 1, F.lit(block)), 256))
    groups = F.transform(
        steps(F.size(leaves), fan), lambda i: F.sha2(F.array_join(F.slice(leaves, i * fan + 1, F.lit(fan)), ""), 256)
    )
    return _root(size, groups)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a plain path or URI, of any kind Arrow knows, and the path inside it."""
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/?=&%@+"))
    return store, inside


def _open(path: str) -> pa.NativeFile:
    store, inside = store_of(path)
    return store.open_input_file(inside)


def _facts(data: bytes, begin: int) -> tuple[str, int, int | None]:
    last = data.rfind(b"\n")
    return hashlib.sha256(data).hexdigest(), data.count(b"\n"), begin + last if last >= 0 else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            begin, known = row["block"] * width, row["known_size"]
            try:
                with _open(row["path"]) as file:
                    data = file.read_at(width, begin)
            except FileNotFoundError:
                continue
            inside = known is not None and begin < known < begin + width
            prefix = _facts(data[: known - begin], begin) if inside else (None, None, None)
            rows.append((row["path"], row["size_bytes"], row["block"], *_facts(data, begin), *prefix))
        yield _batch(rows, _READ)


_TEXT = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            try:
                with _open(path) as file:
                    data = file.read()
            except (FileNotFoundError, NotADirectoryError, PermissionError):  # what a scan takes for a missing file
                continue
            held.append((path, data))
            size += len(data)
            if size >= BLOCK:
                yield _batch(held, _TEXT)
                held, size = [], 0
    yield _batch(held, _TEXT)


def whole_files(files: DataFrame, tasks: int) -> DataFrame:
    """path, content (binary) of files (path) that fit a row each. A file that is gone gives no row."""
    return files.select("path").repartition(tasks, "path").mapInArrow(_read_whole, "path string, content binary")


def reading_tasks(spark: SparkSession) -> int:
    """Tasks for rows that only name what is read: their number must not follow from the size of these rows."""
    return max(READING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_blocks(files: DataFrame, known: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per block of the listed files (path, size_bytes), see `BLOCKS`.

    With `known`, blocks from an earlier run, the block in which a file ended then also has the facts of its
    beginning up to there.
    """
    wanted = files.select("path", "size_bytes").distinct()
    if known is None:
        wanted = wanted.withColumn("known_size", F.lit(None).cast("long"))
    else:
        sizes = known.groupBy("path").agg(F.max("size_bytes").alias("known_size"))
        wanted = wanted.join(sizes, "path", "left")
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size_bytes") - 1) / block))
    places = wanted.where("size_bytes > 0").select("*", F.explode(numbers).alias("block")).repartition(reading_tasks(files.sparkSession), "path", "block")
    return places.mapInArrow(lambda batches: _read_blocks(batches, block), BLOCKS)


def block_hashes(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """path, raw_hash of files whose blocks are all there. Groups hold `fan` digests, the last step one per group."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    groups = blocks.groupBy("path", "size_bytes", F.floor(F.col("block") / fan).alias("group")).agg(
        F.sha2(F.array_join(ordered("block", "digest"), ""), 256).alias("part")
    )
    return groups.groupBy("path").agg(_root(F.max("size_bytes"), ordered("group", "part")).alias("raw_hash"))


def growth(files: DataFrame, blocks: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """What became of each listed file since `known`: path, status, from_byte, from_line, line_start.

    status: new, same, grown (only bytes were added), rewritten (a known block differs or is gone). from_byte is
    the first byte that may be new, from_line the number of the line it lies in and line_start where that
    line begins. Rewritten files go back to the begin of the first block that differs.
    """
    old = known.select("path", "block", F.col("digest").alias("_was"), F.col("size_bytes").alias("_then"))
    partial = F.col("_then") < (F.col("block") + 1) * block
    now = F.when(partial, F.coalesce("prefix_digest", F.when(F.col("_then") == F.col("size_bytes"), F.col("digest")))).otherwise(F.col("digest"))
    compared = old.join(blocks, ["path", "block"], "left").withColumn("_same", F.coalesce(now == F.col("_was"), F.lit(False)))
    before = compared.groupBy("path").agg(
        F.max("_then").alias("_then"), F.min(F.when(~F.col("_same"), F.col("block"))).alias("_differs")
    )
    status = (
        F.when(F.col("_then").isNull(), "new")
        .when(F.col("_differs").isNotNull(), "rewritten")
        .when(F.col("_then") == F.col("size_bytes"), "same")
        .otherwise("grown")
    )
    begins = (
        F.when(F.col("status") == "new", F.lit(0))
        .when(F.col("status") == "rewritten", F.least(F.col("_differs") * block, F.col("size_bytes")))
        .when(F.col("status") == "grown", F.col("_then"))
    )
    stated = files.select("path", "size_bytes").distinct().join(before, "path", "left").withColumn("status", status)
    stated = stated.withColumn("from_byte", begins)
    behind = F.col("from_byte") >= (F.col("block") + 1) * block  # blocks that lie whole before it
    cut = (F.col("from_byte") > F.col("block") * block) & ~behind
    lines = (
        blocks.join(stated.where("from_byte > 0").select("path", "from_byte"), "path")
        .groupBy("path")
        .agg(
            F.sum(F.when(behind, F.col("newlines")).when(cut, F.col("prefix_newlines"))).alias("_lines"),
            F.max(F.when(behind, F.col("last_newline")).when(cut, F.col("prefix_last"))).alias("_last"),
        )
    )
    moved = F.col("from_byte").isNotNull()
    return stated.join(lines, "path", "left").select(
        "path",
        "status",
        "from_byte",
        F.when(moved, F.coalesce("_lines", F.lit(0))).alias("from_line"),
        F.when(moved, F.coalesce(F.col("_last") + 1, F.lit(0))).alias("line_start"),
    )


_LINES = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("raw", pa.string())])


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that begin in each range; the last one is read to its end. A range inside a file starts one byte
    early, at what may be the line break before its first line."""
    for batch in batches:
        for row in batch.to_pylist():
            begin, stop, number = row["begin"], row["stop"], row["number"]
            try:
                with _open(row["path"]) as file:
                    data = file.read_at(stop - begin, begin)
                    if row["inside"]:  # up to the first line break it is a line of an earlier range
                        at = data.find(b"\n", 0, stop - begin - 1)
                        if at < 0:
                            continue
                        data, number, begin = data[at + 1 :], number + (at > 0), begin + at + 1
                    while data and not data.endswith(b"\n"):
                        more = file.read_at(1 << 16, begin + len(data))
                        end = more.find(b"\n")
                        data += more if end < 0 else more[: end + 1]
                        if not more:
                            break
            except FileNotFoundError:
                continue
            lines = data.split(b"\n")
            lines = lines[:-1] if lines[-1] == b"" else lines
            if lines:
                texts = [line.decode("utf-8", "replace") for line in lines]
                numbers = range(number, number + len(lines))
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(lines)), pa.array(numbers, pa.int64()), pa.array(texts)], schema=_LINES)


def tail_lines(blocks: DataFrame, grown: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, line_no, raw of every line from `from_line` on, blank ones too. Blocks before it are not read.

    Every block of the rest is a range of its own, whose line numbers come from the line breaks of the blocks
    before it.
    """
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumn("_before", F.coalesce(F.sum("newlines").over(order), F.lit(0)))
    rest = numbered.join(grown.where("from_byte is not null"), "path").where((F.col("block") + 1) * block > F.col("from_byte"))
    first = F.col("block") == F.floor(F.col("from_byte") / block)
    begin = F.col("block") * block
    ranges = rest.select(
        "path",
        F.when(first, F.col("line_start")).otherwise(begin - 1).alias("begin"),
        F.least(begin + block, F.col("size_bytes")).alias("stop"),
        F.when(first, F.col("from_line")).otherwise(F.col("_before")).alias("number"),
        (~first).alias("inside"),
    )
    return ranges.repartition("path", "begin").mapInArrow(_read_lines, "path string, line_no bigint, raw string")
