"""Streams whose state is a table.

Every micro-batch is a batch job over its rows and the state that the batches before it left. So it may use every
batch operator, among them those that cut a hot key into pieces, which a stateful operator that gets all rows of
a key in one task cannot.

A batch writes its output and the state rows it has changed to folders named after its id. One that is tried
again reads the same state and writes over its own folders. After every `EVERY` batches the state is written as a
whole, so that a read goes through a bounded number of changes and writes follow the batches, not the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.sources.files import existing

EVERY = 16


@dataclass(frozen=True)
class Gate:
    """What a stream does with a batch.

    `emit(rows, state, earlier)` gives the output rows; `earlier` is the output of the batches before, or None.
    `keep(rows, output, state)` gives the state rows that have
    changed, with a boolean column `gone` for keys that leave the state. `after(output, batch)` does what follows
    from the output elsewhere; as a batch may be tried again, it must be able to run twice.
    """

    keys: list[str]
    schema: str
    emit: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]
    keep: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    after: Callable[[DataFrame, int], None] | None = None


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null meets null; `right` must have no other column of the same name."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def read_state(spark: SparkSession, folder: str, gate: Gate, batch: int) -> DataFrame:
    """The state that holds when this batch begins: the last whole one, and the changes since."""
    whole = (batch - 1) // EVERY * EVERY if batch else 0
    parts = []
    if whole:
        full = spark.read.schema(gate.schema).parquet(f"{folder}/whole/batch={whole}")
        parts.append(full.withColumns({"gone": F.lit(False), "_batch": F.lit(-1)}))
    for n in range(whole, batch):
        part = spark.read.schema(f"{gate.schema}, gone boolean").parquet(f"{folder}/changes/batch={n}")
        parts.append(part.withColumn("_batch", F.lit(n)))
    if not parts:
        return spark.createDataFrame([], gate.schema)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    values = [c for c in every.columns if c not in (*gate.keys, "_batch")]
    latest = every.groupBy(*gate.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_s"))
    return latest.where("NOT _s.gone").select(*gate.keys, *[f"_s.{v}" for v in values if v != "gone"])


def run_gate(stream: DataFrame, folder: str, gate: Gate) -> StreamingQuery:
    """Start the gate on what the stream has now; output lies in `folder`/rows, state beside it."""

    def one(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        state = read_state(spark, folder, gate, batch)
        if batch and batch % EVERY == 0:
            state.write.mode("overwrite").parquet(f"{folder}/whole/batch={batch}")
        earlier = existing(lambda: output(spark, folder).where(F.col("batch") < batch))
        out = f"{folder}/rows/batch={batch}"
        gate.emit(rows, state, earlier).write.mode("overwrite").parquet(out)
        changed = gate.keep(rows, spark.read.parquet(out), state)
        columns = [c.split()[0] for c in gate.schema.split(", ")] + ["gone"]
        changed.select(*columns).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
        if gate.after:
            gate.after(spark.read.parquet(out), batch)
        rows.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()
    )


def output(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")
