"""The prefix trie of conversations.

Every conversation becomes the sequence of keys of its prefixes (128 bits: sums of hashes that hold the
place of each turn). Long ones are cut into segments of `SEGMENT` turns, always at the same depths, so that a
segment is a bounded sequence below a known prefix. Segments are dealt by ranges of their first turns: those
that share a beginning meet in a task, and a very common first turn goes on to its second and third turns, then to
single conversations, over as many tasks as it needs. Each task inserts its segments in batches into z-fast
tries (`zfast_trie`), counts there, and expands the edges into nodes; nodes of the same key from different
tasks add up. A task that holds `HELD` turns gives its nodes out and begins anew.

What a node needs from its subtree (leaves, saved tokens) goes up by pointer doubling: after k rounds every
node has the sums of the 2^k levels below it, so depth d takes log2(d) rounds and shrinking tables.

The digest of the conversations that end at a node is a hash over their ids in order, which only one task can
compute; it streams over sorted rows and holds one id.

Defined cases: rows without conv_id belong to no conversation. Null turns come first; equal turns are ordered by
the hash of role and text. Null roles and texts become empty. Ids are whole numbers (`c - c % 5` has the sign
rules of SQL). Without conversations there is no root and the result is empty. Other columns are not
read; a text of any length only enters as hash and size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionmill.llm.common import checkpointed, join_counted, plain_columns, shared_folder
from sessionmill.llm.zfast_trie import ZFastTrie
from sessionmill.operators.ordering import ranked

SEGMENT = 4096
HELD = 1 << 18
GROUP, HEADS = 5, 9
_MASK = (1 << 64) - 1
_NODE = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "p1", "p2", "depth", "size", "n", "least")])
_END = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int64())])
_DIGEST = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
_SQL = {pa.int64(): "long", pa.string(): "string"}
_KEY, _PARENT = ["h1", "h2"], ["p1", "p2"]


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def own_turns(conversations: DataFrame) -> DataFrame:
    """c, pos (from 1), hashes a and b of role and text, size of the text in bytes."""
    role, text = (F.coalesce(x, F.lit("")) for x in ("role", "text"))
    rows = plain_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit("turn"), role).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return ranked(rows, ["c"], [F.asc_nulls_first("turn"), F.asc("a"), F.asc("b")], "pos").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: c, length; their turns: c, length, depth, a, b, size) after the heads are exchanged."""
    lengths = turns.groupBy("c").agg(F.max("pos").alias("own"))
    head = F.crc32(F.col("c").cast("string")) % HEADS
    first = F.col("c") - F.col("c") % GROUP
    named = lengths.select("c", "own", head.alias("h"), first.alias("first"))
    base = lengths.select(F.col("c").alias("first"), F.col("own").alias("lent"))
    plan = named.join(base, "first", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    plan = checkpointed(plan.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    lent = turns.where(f"pos < {HEADS} and c % {GROUP} = 0").withColumnRenamed("c", "first")
    heads = plan.select("c", "first", "taken", "length").join(lent, "first").where("pos <= taken")
    tails = join_counted(turns, plan.select("c", "own", "h", "taken", "length"), ["c"], "own", turns.count()).where("pos > h")
    columns = ["c", "length", "depth", "a", "b", "size"]
    both = heads.withColumn("depth", F.col("pos")).select(*columns).union(tails.withColumn("depth", F.expr("taken + pos - h")).select(*columns))
    return plan.select("c", "length"), both


def segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and SEGMENT turns: c, length, block, sums s1 and s2 before it, items (depth, q1, q2, size)."""
    placed = turns.select(
        "c",
        "length",
        F.floor((F.col("depth") - 1) / SEGMENT).alias("block"),
        F.struct("depth", F.xxhash64("depth", "a", "b").alias("q1"), F.xxhash64("b", "a", "depth").alias("q2"), "size").alias("item"),
    )
    whole = placed.groupBy("c", "length", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sums = [F.sum(F.col(f"item.{q}").cast("decimal(20,0)")).alias(q) for q in ("q1", "q2")]
    long_ = placed.where(F.col("length") > SEGMENT).groupBy("c", "block").agg(*sums)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = long_.select("c", "block", *[F.sum(q).over(before).cast("string").alias(f"s{q[1]}") for q in ("q1", "q2")])
    return whole.join(begins, ["c", "block"], "left")


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes], list[int], int]]:
    """(depth before, key before, prefix keys, sizes, c) of each segment."""
    items = batch["items"]
    flat = items.flatten()
    begins = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))])
    sizes = flat.field("size").to_pylist()
    sums = []
    for q in ("q1", "q2"):
        values = flat.field(q).to_numpy(zero_copy_only=False).view(np.uint64)
        sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values)]))
    for i, (c, block) in enumerate(zip(batch["c"].to_pylist(), batch["block"].to_pylist(), strict=True)):
        at, end = begins[i], begins[i + 1]
        start = [np.uint64(int(batch[s][i].as_py() or 0) & _MASK) for s in ("s1", "s2")]
        both = np.stack([x[at : end + 1] - x[at] + s for x, s in zip(sums, start, strict=True)], axis=1).astype(">u8").tobytes()
        keys = [both[k : k + 16] for k in range(0, len(both), 16)]
        yield block * SEGMENT, keys[0], keys[1:], sizes[at:end], c


def _rows(tries: list[ZFastTrie]) -> Iterator[pa.RecordBatch]:
    nodes = (x for trie in tries for x in trie.expand())
    for part in iter(lambda: list(islice(nodes, 1 << 16)), []):
        key, parent, *rest = zip(*part, strict=True)
        halves = [np.frombuffer(b"".join(k), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2) for k in (key, parent)]
        columns = [h[:, j] for h in halves for j in (0, 1)] + [np.array(c, dtype=np.int64) for c in rest]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_NODE)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[bytes, ZFastTrie] = {}
    for batch in batches:
        found: dict[bytes, list] = {}
        for depth, before, keys, sizes, c in _sequences(batch):
            if before not in tries:
                tries[before] = ZFastTrie(depth, before)
            found.setdefault(before, []).append((keys, sizes, c))
        for before, some in found.items():
            tries[before].insert_batch(some)
        if sum(t.held for t in tries.values()) > HELD:
            yield from _rows(list(tries.values()))
            tries = {}
    yield from _rows(list(tries.values()))


def _last_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [(np.frombuffer(keys[-1], dtype=">u8").astype(np.uint64).view(np.int64), c) for _, _, keys, _, c in _sequences(batch)]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in ends]), pa.array([k[1] for k, _ in ends]), pa.array([c for _, c in ends])], schema=_END)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id -> one digest per node; nothing but the running hash is held."""
    rows = (r for batch in batches for r in zip(*[batch[c].to_pylist() for c in ("h1", "h2", "c")], strict=True))

    def digests() -> Iterator[tuple]:
        for (h1, h2), run in groupby(rows, key=itemgetter(0, 1)):
            digest = hashlib.sha256(str(next(run)[2]).encode())
            for _, _, c in run:
                digest.update(b",%d" % c)
            yield h1, h2, digest.hexdigest()

    out = digests()
    for part in iter(lambda: list(islice(out, 10_000)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def trie_nodes(pieces: DataFrame) -> DataFrame:
    """All nodes but the root: key h1, h2, parent's key p1, p2, depth, size of the last text, n members, least member."""
    turn = lambda k: F.try_element_at("items", F.lit(k))["q1"]
    order = [F.col("block"), F.col("s1"), turn(1), turn(2), turn(3), F.col("c")]
    found = pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tries, _sql(_NODE))
    same = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "size")]
    return found.groupBy(*_KEY).agg(*same, F.sum("n").alias("n"), F.min("least").alias("least"))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Checkpoints hand on all constraints the optimizer has
    derived, and over many rounds of joins these grow beyond any bound."""
    path = f"{shared_folder(df.sparkSession)}/trie-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """h1, h2 and the sums of `values` over each node's subtree; nodes: h1, h2, p1, p2, depth and values."""
    sums = lambda: [F.sum(v).alias(v) for v in values]
    parts = [nodes.select(*_KEY, *values)]
    active = stored(nodes.where("depth > 1").select(*_KEY, *_PARENT, *values))  # p: the ancestor 2^k levels above
    step = 1
    while step < deepest:
        below = stored(active.groupBy(*_PARENT).agg(*sums(), F.count("*").alias("pointing")).toDF(*_KEY, *values, "pointing"))
        parts.append(below.select(*_KEY, *values))
        extra = below.select(*_KEY, *[F.col(v).alias(f"_{v}") for v in values], "pointing")
        grown = stored(
            active.join(extra, _KEY, "left").select(
                *_KEY, *_PARENT, *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], F.coalesce("pointing", F.lit(0)).alias("pointing")
            )
        )
        ahead = grown.where("pointing > 0").select(
            F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), "pointing"
        )
        rows = grown.select(*_KEY, *_PARENT, *values)
        moved = join_counted(rows, ahead, _PARENT, "pointing", active.count())
        active = stored(moved.select(*_KEY, F.col("g1").alias("p1"), F.col("g2").alias("p2"), *values))
        step *= 2
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*_KEY).agg(*sums())


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = checkpointed(own_turns(conversations))
    ids, together = rebuilt(turns)
    pieces = checkpointed(segments(together))
    nodes = checkpointed(trie_nodes(pieces))
    kids = nodes.groupBy(*_PARENT).agg(F.count("*").alias("n_children")).toDF(*_KEY, "n_children")
    weighed = checkpointed(
        nodes.join(kids, _KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("size")})
    )
    top = weighed.agg(
        F.max("depth").alias("deepest"), F.count("*").alias("nodes"), F.sum((F.col("depth") == 1).cast("long")).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    ).first()
    sums = subtree_sums(weighed.select(*_KEY, *_PARENT, "depth", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], top["deepest"] or 0)
    last = pieces.where(F.col("length") <= (F.col("block") + 1) * SEGMENT).mapInArrow(_last_keys, _sql(_END))
    turnless = ids.where("length = 0").select(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "c")
    ends = last.union(turnless).repartition(*_KEY).sortWithinPartitions(*_KEY, "c").mapInArrow(_digests, _sql(_DIGEST))
    whole = ids.agg(F.min("c").alias("least"), F.count("*").alias("n")).first()
    root_id = F.lit(whole["least"]).cast("long")

    plain = weighed.select(*_KEY, *_PARENT, "depth", "n", "least", "n_children").join(sums, _KEY)
    above = weighed.where("n_children > 0").select(
        F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("pointing")
    )
    deep = join_counted(plain.where("depth > 1"), above, _PARENT, "pointing", top["nodes"]).drop("pointing")
    shallow = plain.where("depth = 1").withColumn("parent_conv_id", root_id)
    number = lambda x: F.lit(x or 0).cast("long")
    root = ids.agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 0").select(
        number(0).alias("h1"), number(0).alias("h2"), number(0).alias("depth"), "n", "least", F.lit(None).cast("long").alias("parent_conv_id"),
        number(top["n_children"]).alias("n_children"), number(top["n_leaves"] or 1).alias("n_leaves"), number(top["saved_tokens"]).alias("saved_tokens"),
    )
    columns = [*_KEY, "depth", "n", "least", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    rows = deep.select(*columns).union(shallow.select(*columns)).union(root.select(*columns))
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(ends, _KEY, "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
