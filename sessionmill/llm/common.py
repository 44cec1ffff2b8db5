"""Helpers shared by the operators: checkpoints, row keys, sizes, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Links that one task folds to a forest: some 16 MB.
FOLD = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by the cluster in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder or tempfile.mkdtemp(prefix="sessionmill-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use, whatever extra columns it has."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that name a row by its id and whole text. Rows equal in both are interchangeable."""
    body = text_or_empty(text)
    return F.xxhash64(F.col(doc_id), body), F.xxhash64(body, F.lit("row"), F.col(doc_id))


def plain_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, under these names; other columns cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def map_rows(docs: DataFrame, run: Callable, added: StructType | None = None) -> DataFrame:
    """docs.mapInArrow(run) for docs with columns of any name; `added` are the columns that run puts behind them."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    added = added or StructType([])
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)] + added.fields)
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, *added.names)


def small(df: DataFrame, size: Column, limit: int) -> bool:
    """Whether the summed size of all rows stays below the limit in bytes: the check before a broadcast."""
    total = df.agg(F.sum(size).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def join_counted(rows: DataFrame, one: DataFrame, keys: list[str], count: str, total: int, most: int = 10_000) -> DataFrame:
    """rows joined with `one`, which has one row per key and in `count` the number of rows with that key.

    Of `total` rows at most `most` keys can hold more than a share of total / most each. Those meet their
    row by a broadcast of that proven size, where the rows are; only the others are shuffled.
    """
    often = F.col(count) > max(1, total // most)
    hot = F.broadcast(one.where(often))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(one.where(~often), keys)
    return rows.join(hot, keys).unionByName(rest)


def join_salted(
    rows: DataFrame, one: DataFrame, keys: list[str], count: str, total: int, by: Column, most: int = 10_000, salts: int = 64
) -> DataFrame:
    """The same result for rows that are dear to make: they are read once.

    The keys of many rows, at most `most`, are broadcast by themselves; rows of such a key go to `salts` parts
    by the hash of `by`, and the key's one row goes to each of them.
    """
    often = F.col(count) > max(1, total // most)
    hot = F.broadcast(one.where(often).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    spread = F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return left.join(one.withColumn("_salt", spread), [*keys, "_salt"]).drop("_salt")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition -> one row (hi, lo) for every linked node but the least one of its component there."""
    parts = [np.stack([batch["a"].to_numpy(), batch["b"].to_numpy()]) for batch in batches]
    ids, ends = np.unique(np.concatenate([np.zeros((2, 0), dtype=np.int64), *parts], axis=1), return_inverse=True)
    left, right = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]])], ["hi", "lo"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs: one row (node, root) per linked node; root is the least node.

    First the links are dealt to partitions of at most about FOLD, and each is folded to a forest. What several
    forests leave open is closed by alternating large-star and small-star steps; each joins the edges with one
    row per node, so the neighbours of a node are never gathered. A checkpoint per round keeps the plan short.
    """
    links = checkpointed(links.where("a != b").select("a", "b"))
    parts = max(1, -(-links.count() // FOLD))
    pairs = checkpointed(links.repartition(parts).mapInArrow(_forest, "hi long, lo long"))
    state = None
    while parts > 1:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = pairs.union(pairs.select("lo", "hi")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("m"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = checkpointed(moved.union(least).distinct())
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
