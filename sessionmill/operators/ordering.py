"""Ordered operators that hold when one key owns a third of the rows.

A plain window puts all rows of a key into one task. Here a key is cut into pieces first, the
pieces are summarised, and only the summaries go through a window per key.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES_PER_PIECE = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="sessionmill-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the cluster."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """row_number() within `keys` by `order` (a total order), without one task per key.

    Rows are range partitioned by (keys, order), so a hot key spans many partitions. Positions
    inside a partition come from the row id, partition offsets from a window over one summary row
    per (partition, key). The sorted rows are checkpointed because both uses must see the very
    same partitions.
    """
    exprs = [F.col(k).asc() for k in keys] + order
    rows = (
        df.repartitionByRange(*exprs)
        .sortWithinPartitions(*exprs)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33))
    )
    rows = durable(rows)
    runs = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*(keys or [F.lit(1)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    on = F.col("a._part") == F.col("b._part")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return (
        rows.alias("a")
        .join(offsets.alias("b"), on)
        .select(
            *[F.col(f"a.{c}") for c in df.columns],
            (F.col("b._offset") + F.col("a._row") - F.col("b._first") + 1).alias(out),
        )
    )


def _join_pieces(rows: DataFrame, entry: DataFrame, keys: list[str]) -> DataFrame:
    """Join on (keys, _piece) where null keys meet null keys."""
    on = F.col("a._piece").eqNullSafe(F.col("b._piece"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [F.col(f"b.{c}") for c in entry.columns if c not in (*keys, "_piece")]
    return rows.alias("a").join(entry.alias("b"), on).select("a.*", *extra)


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    *,
    piece: Column | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null value of each expression up to the current row, in `order` within `keys`.

    `piece` cuts a key into consecutive ranges of bounded size; by default ranges of an integer
    `order` column. Values enter a range through a window over one row per range.
    """
    piece = F.floor(F.col(order) / LINES_PER_PIECE) if piece is None else piece
    rows = df.withColumns({"_piece": piece, **{f"_v_{n}": e for n, e in values.items()}})
    last = {
        n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) for n in values
    }
    sums = rows.groupBy(*keys, "_piece").agg(*[e.alias(f"_l_{n}") for n, e in last.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    entry = sums.select(
        *keys,
        "_piece",
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_e_{n}") for n in values],
    )
    end = Window.currentRow if include_current else -1
    inside = (
        Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    )
    joined = _join_pieces(rows, entry, keys)
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_e_{n}")).alias(n)
            for n in values
        ],
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, *, piece: Column | None = None
) -> DataFrame:
    """Running sum in `order` within `keys`, cut into ranges like `carry_forward`."""
    piece = F.floor(F.col(order) / LINES_PER_PIECE) if piece is None else piece
    rows = df.withColumns({"_piece": piece, "_v": value})
    sums = rows.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_s"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    entry = sums.select(*keys, "_piece", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_e"))
    inside = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _join_pieces(rows, entry, keys)
    return joined.select(*df.columns, (F.col("_e") + F.sum("_v").over(inside)).alias(out))


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest `order` per key, as an aggregate: copies of a hot key are combined
    before the shuffle, which a row_number() window would not do."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), order).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, "_r.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), order).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, "_r.*").select(*df.columns)
