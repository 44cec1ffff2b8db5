"""Payload, manifest and event sinks.

Every sink writes to a folder named after the batch and overwrites it as a whole, so a batch that is
run again leaves no second copy.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.operators.ordering import LINES_PER_PIECE, durable
from sessionmill.sources.blocks import store_of

COPY_BYTES = 4 << 20
MOVE_TASKS_PER_CORE = 2
BODY_FILE = "part-0.txt"
_PIECES = "_pieces"
_PIECE = pa.schema(
    [("manifest_id", pa.string()), ("body", pa.string()), ("piece", pa.int64()), ("name", pa.string()), ("size_bytes", pa.int64())]
)


def write_payloads(records: DataFrame, out: str) -> None:
    """Payload records of a batch as a table: manifest_id=/ folders of large files.

    Rows are range partitioned by session and line, so a session of any length is shared by
    several tasks, a reader of one session skips all but its row groups, and the number of files
    depends on the data and not on the number of sessions.
    """
    order = ["manifest_id", "session_id", "line_no"]
    (
        records.select(*order, "raw")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("manifest_id")
        .parquet(out)
    )


def _folder_name(column: str, value: str | None) -> str:
    """The folder of a partition value, spelled as Spark spells it and reads it back."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def _write_pieces(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Lines sorted by session and number -> one file per piece of a session, under a name of its own; tells of each."""
    store, root = store_of(out)
    own = uuid.uuid4().hex  # a folder for each task, as many files of one folder are created one after another
    store.create_dir(f"{root}/{own}", recursive=True)
    key = name = sink = None
    told: list[tuple] = []

    def close() -> None:
        if sink is not None:
            size = sink.tell()
            sink.close()
            told.append((*key, name, size))

    for batch in batches:
        manifest, body, piece, raw = (batch[c].to_pylist() for c in ("manifest_id", "body", "piece", "raw"))
        for now, run in groupby(range(batch.num_rows), lambda i: (manifest[i], body[i], piece[i])):
            if now != key:
                close()
                key, name = now, f"{own}/{uuid.uuid4().hex}"
                sink = store.open_output_stream(f"{root}/{name}")
            sink.write("".join(f"{raw[i] or ''}\n" for i in run).encode())
    close()
    columns = list(zip(*told, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def _join_pieces(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a session -> its body. A single piece is moved, several are copied one after another in order."""
    store, root = store_of(out)
    for batch in batches:
        for row in batch.to_pylist():
            folder = f"{root}/{_folder_name('manifest_id', row['manifest_id'])}/{_folder_name('body', row['body'])}"
            pieces = [f"{root}/{_PIECES}/{p['name']}" for p in row["pieces"]]
            whole = pieces[0]
            store.create_dir(folder, recursive=True)
            if len(pieces) > 1:
                whole = f"{root}/{_PIECES}/{uuid.uuid4().hex}"
                with store.open_output_stream(whole) as sink:
                    for piece in pieces:
                        with store.open_input_stream(piece) as source:
                            while data := source.read(COPY_BYTES):
                                sink.write(data)
            try:
                store.move(whole, f"{folder}/{BODY_FILE}")
            except FileNotFoundError:  # an attempt before this one has moved it
                if store.get_file_info(f"{folder}/{BODY_FILE}").size != row["size_bytes"]:
                    raise
        yield batch.select(["manifest_id", "body", "size_bytes"])


def write_bodies(records: DataFrame, out: str, lines: int = LINES_PER_PIECE) -> DataFrame:
    """NDJSON bodies of sessions of any length, one file each: manifest_id=/body=/part-0.txt, in line order.

    A long session is written by several tasks, in pieces of `lines` lines. What a task has written counts only
    by the row it returns, so pieces of an attempt that died are never met. Then one task per session moves its
    piece into place, or puts the pieces together by copying a few megabytes at a time. Returns manifest_id, body and
    size_bytes of what was written.
    """
    store, root = store_of(out)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
    rows = records.select(
        F.col("manifest_id").cast("string").alias("manifest_id"), F.col("session_id").cast("string").alias("body"),
        F.floor(F.col("line_no") / lines).cast("long").alias("piece"), "line_no", "raw",
    )
    key = ["manifest_id", "body", "piece"]
    pieces = rows.repartition(*key).sortWithinPartitions(*key, "line_no").drop("line_no").mapInArrow(
        lambda batches: _write_pieces(batches, f"{out}/{_PIECES}"),
        "manifest_id string, body string, piece bigint, name string, size_bytes bigint",
    )
    bodies = durable(pieces).groupBy("manifest_id", "body").agg(
        F.array_sort(F.collect_list(F.struct("piece", "name"))).alias("pieces"), F.sum("size_bytes").alias("size_bytes")
    )
    # The rows are small and the moves are not: their number of tasks must not follow from the size of the rows.
    tasks = MOVE_TASKS_PER_CORE * records.sparkSession.sparkContext.defaultParallelism
    done = durable(
        bodies.repartition(tasks, "manifest_id", "body").mapInArrow(
            lambda batches: _join_pieces(batches, out), "manifest_id string, body string, size_bytes bigint"
        )
    )
    if store.get_file_info(f"{root}/{_PIECES}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{_PIECES}")
    return done


def write_manifests(headers: DataFrame, entries: DataFrame, out: str) -> None:
    """Header and entries side by side; entries are rows, so a manifest may have any number."""
    headers.write.mode("overwrite").partitionBy("source_kind").json(f"{out}/headers")
    entries.write.mode("overwrite").partitionBy("source_kind").json(f"{out}/entries")


def write_events(events: DataFrame, out: str) -> None:
    """Event log as NDJSON, one folder per manifest."""
    events.write.mode("overwrite").partitionBy("manifest_id").json(out)
