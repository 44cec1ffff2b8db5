"""N-gram Jaccard join with Bayesian candidate pruning.

Each text becomes its set of distinct five-word shingles (64-bit hashes). Texts with equal sets are one
class, and only classes are compared. The work goes in two rounds:

1. Candidates. 240 MinHash values in 40 bands of 6 find pairs that may reach the threshold; a pair at 0.8
   meets in no band with a chance of 5e-6. In a bucket of up to `BUCKET` classes all pairs are compared
   incrementally: after every 16 MinHash values a pair whose posterior chance of reaching the threshold has
   fallen below `TOLERANCE` is dropped. The survivors of a bucket come out as a forest, not as pairs.
   Larger buckets are copies of one text as a rule and link to their least member at once, unpruned.
2. Verification. Links form components; the texts of a component meet in pairs of blocks of bounded size.
   There every pair is pruned in the same way, the rest compared exactly, and what comes out is one row
   per class and block pair with its number of links, again with a forest. So a group of n near copies
   takes (n / block)^2 bounded tasks and no row per pair, and no link between different texts is lost.
   The shingle sets of linked classes are made once; pairs of blocks get sorted arrays, never texts.

Defined cases: null texts count as empty; texts without words form one class; a text of one to four words
has one shingle, all of them. Repeated rows and null ids count as documents of their own. The class id is
the least doc_id of the class (null if all are null). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, components, free_name, join_counted, plain_columns, row_keys, small
from sessionmill.llm.words import SHINGLE, batch_words, mix, shingles, text_slices

THRESHOLD = 0.8
BANDS, ROWS = 40, 6
COMPARED, STEP = 64, 16  # MinHash values that are carried along, and compared at a time
TOLERANCE = 1e-6
BUCKET = 64
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 18
BROADCAST_LIMIT = 64 << 20
_COLUMNS = 1024  # of a block's shingle matrix at a time

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many equal MinHash values, from a uniform prior.

    The posterior is Beta(matches + 1, misses + 1); its upper tail is a binomial sum.
    """
    n = compared + 1
    return sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(matches + 1))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest equal values with which a pair goes on."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance) for n in range(STEP, COMPARED + 1, STEP)]


def minhash(values: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value of a non-empty shingle set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_MUL), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, (low[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=best)
    return (best * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    sums = (signature.reshape(BANDS, ROWS).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return mix(sums + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(97))).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_slices(whole["text"])):
        words, begins = batch_words(batch["text"])
        node, sizes, signatures, keys = [], [], [], []
        for i in range(batch.num_rows):
            own = shingles(words[begins[i] : begins[i + 1]])
            total = np.array([own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)])
            node.append(total.tobytes())
            sizes.append(len(own))
            signature = minhash(own) if len(own) else None
            signatures.append(None if signature is None else signature[:COMPARED].tobytes())
            keys.append(None if signature is None else _band_keys(signature))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["k1"],
                batch["k2"],
                pa.array(node, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(signatures, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["doc_id", "k1", "k2", "node", "shingles", "signature", "keys"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: keys of the row, 128 bits that name its shingle set, set size, MinHash values, band keys."""
    k1, k2 = row_keys()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInArrow(_sketch, "doc_id long, k1 long, k2 long, node binary, shingles long, signature binary, keys array<long>")


def _alive(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which pairs remain after the incremental comparison."""
    keep = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int16)
    for step, least in enumerate(needed):
        at = slice(step * STEP, (step + 1) * STEP)
        equal = equal + (signatures[left[keep], at] == signatures[right[keep], at]).sum(axis=1, dtype=np.int16)
        alive = equal >= least
        keep, equal = keep[alive], equal[alive]
    return keep


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each component; labels pass along the edges until nothing changes."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _pruned_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> links (a, b) of classes that survive the pruning in some bucket."""
    needed = least_matches()

    def forest(rows: pa.Table) -> pa.RecordBatch:
        key = rows["key"].to_numpy()
        ids = rows["id"].to_numpy()
        signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype=np.uint16).reshape(-1, COMPARED)
        lefts, rights = [], []
        for lag in range(1, len(key)):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                break
            for at in range(0, len(same), 65536):
                some = same[at : at + 65536]
                kept = some[_alive(signatures, some, some + lag, needed)]
                lefts.append(kept)
                rights.append(kept + lag)
        left, right = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (lefts, rights))
        root = _roots(len(key), left, right)
        out = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[out]]), pa.array(ids[out])], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = held["key"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and key[0] != key[-1] else 0  # the last bucket may go on
        if cut:
            yield forest(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield forest(held)


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that may be similar; classes: id, signature, keys."""
    spread = classes.where("keys is not null").select("id", F.posexplode("keys").alias("band", "key")).drop("band")
    counted = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    members = spread.join(counted, "key")
    large = members.where(F.col("n") > BUCKET).select(F.col("first").alias("a"), F.col("id").alias("b"))
    pruned = (
        members.where(F.col("n") <= BUCKET)
        .select("key", "id")
        .join(classes.select("id", "signature"), "id")
        .repartition("key")
        .sortWithinPartitions("key", "id")
        .select("key", "id", "signature")
        .mapInArrow(_pruned_forest, "a long, b long")
    )
    return large.union(pruned)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_slices(whole["text"])):
        words, begins = batch_words(batch["text"])
        sets = [shingles(words[begins[i] : begins[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["signature"], batch["copies"], pa.array(sets, pa.list_(pa.int64()))], ["id", "signature", "copies", "items"])


def _verified(rows: pa.Table) -> pa.Table:
    """All links of one pair of blocks: for each class its weight in links, and its root among them."""
    needed = least_matches()
    first, second = rows["i"][0].as_py(), rows["j"][0].as_py()
    rows = rows.take(pc.sort_indices(rows["id"]))
    ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
    sets = [np.asarray(chunk.values[a:b]).view(np.uint64) for chunk in rows["items"].chunks for a, b in zip(chunk.offsets[:-1].to_pylist(), chunk.offsets[1:].to_pylist(), strict=True)]
    signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype=np.uint16).reshape(-1, COMPARED)
    one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
    size = np.array([len(s) for s in sets])
    alive = []
    for a in one:  # a row of the pair matrix at a time
        others = two[two > a] if first == second else two
        kept = others[_alive(signatures, np.full(len(others), a), others, needed)]
        alive.append(np.stack([np.full(len(kept), a), kept]))
    left, right = np.concatenate([np.zeros((2, 0), dtype=np.int64), *alive], axis=1).astype(np.int64)
    shared = _shared(sets, one, two, left, right)
    similar = shared >= THRESHOLD * (size[left] + size[right] - shared) - 1e-9
    left, right = left[similar], right[similar]
    weight = rows["copies"].to_numpy()
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, left, weight[right])
    np.add.at(links, right, weight[left])
    root = _roots(len(ids), left, right)
    out = links > 0
    return pa.table({"id": ids[out], "root": ids[root[out]], "links": links[out]})


def _shared(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common shingles of each pair (left, right): one by one, or by blocks of a 0/1 matrix."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.cumsum(count > 1) - 1  # only shingles that two texts have
    owner, code = owner[count[code] > 1], rank[code[count[code] > 1]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(one), len(two)), dtype=np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        some = slice(*np.searchsorted(code, [at, at + _COLUMNS]))
        matrix = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        matrix[owner[some], code[some] - at] = 1
        total += matrix[one] @ matrix[two].T
    row, column = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    row[one], column[two] = np.arange(len(one)), np.arange(len(two))
    return total[row[left], column[right]].astype(np.int64)


def verified_links(sets: DataFrame, sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (id, root, links) per pair of blocks; sets: id, signature, copies, items; sizes: id, shingles; groups: node, root."""
    members = groups.toDF("id", "grp")
    blocks = members.join(sizes, "id").groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.count("*").alias("n"),
    )
    placed = join_counted(members, blocks, ["grp"], "n", groups.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = other.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    return units.join(sets, "id").groupBy("grp", "i", "j").applyInArrow(_verified, "id long, root long, links long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, k1, k2 (keys of the row), class_id, class_size, n_links, kept."""
    docs = plain_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    sketch = checkpointed(sketches(docs))
    classes = checkpointed(
        sketch.groupBy("node")
        .agg(
            F.first("signature").alias("signature"),
            F.first("shingles").alias("shingles"),
            F.first("keys").alias("keys"),
            F.count("*").alias("copies"),
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("row"),
        )
        .withColumn("id", F.monotonically_increasing_id())  # fixed by the checkpoint
    )
    groups = checkpointed(components(spark, candidate_links(classes)))
    k1, k2 = row_keys()
    found = groups.select(F.col("node").alias("id"))
    wanted = classes.join(found, "id").select("id", "signature", "copies", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"))
    if small(wanted, F.lit(256), BROADCAST_LIMIT):  # else the texts shuffle
        wanted = F.broadcast(wanted)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(wanted, ["k1", "k2"]).select("id", "signature", "copies", "text")
    sets = texts.mapInArrow(_shingle_sets, "id long, signature binary, copies long, items array<long>").dropDuplicates(["id"])
    links = checkpointed(verified_links(checkpointed(sets), classes.select("id", "shingles"), groups))
    final = components(spark, links.select(F.col("root").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.select("id", "node", "copies", "least_id", "row")
        .join(final, "id", "left")
        .join(counted, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    whole = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("row").alias("stays"))
    per_class = checkpointed(
        named.join(whole, "root").select(
            "node", "copies", "class_id", "class_size", "stays", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    )
    kept = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2"))
    rows = sketch.select("doc_id", "k1", "k2", "node")
    return join_counted(rows, per_class, ["node"], "copies", sketch.count()).select("doc_id", "k1", "k2", "class_id", "class_size", "n_links", kept.alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the row with the least doc_id."""
    k1, k2, kept = (free_name(docs, name) for name in ("_k1", "_k2", "_kept"))
    groups = near_groups(docs).where("class_size > 1").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").alias(kept)).distinct()
    groups = checkpointed(groups)
    if small(groups, F.lit(32), BROADCAST_LIMIT):
        groups = F.broadcast(groups)
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(), strict=True))).join(groups, [k1, k2], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stays = keyed.where(F.col(kept)).dropDuplicates([k1, k2])  # rows equal in id and text
    return keyed.where(F.col(kept).isNull()).select(*columns).union(stays.select(*columns))
