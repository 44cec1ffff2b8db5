"""Repeated passages by suffix arrays over all documents.

A string of `LENGTH` bytes that starts in two places is found in one group, however far apart the places are:
every window of that length has an anchor, the first of its 32-byte pieces with the least hash, and equal
windows have equal anchors at equal offsets. The windows of one anchor make up a context of some 280 bytes.

1. Anchors of all documents are counted. One that occurs once ends here, without its text.
2. Contexts that are equal are one string with a count; with a count of two or more, all their windows repeat.
3. The different contexts of an anchor are sorted together: they are cut into 16-byte symbols, aligned at the
   anchor, and a suffix array built by linear grouping (see `suffix_array`) puts equal runs side by side. A
   window holds 11 whole symbols, so only runs with a common prefix of 11 can hold equal windows; those are
   compared byte by byte.
4. Repeated windows go back to their documents as spans.

An anchor with more than `GROUP` different contexts is not sorted in one task: its windows are counted by
their 128-bit hashes, over all tasks, with the same result.

Defined cases: a null text counts as empty. Matches lie within a document; both places may be in one
document and may overlap. Rows that are equal in id and text are places of their own. An empty table gives an
empty result. Other columns are not read by the digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, join_counted, join_salted, plain_columns, row_keys, small, text_or_empty
from sessionmill.llm.suffix_array import common_prefixes, suffix_array
from sessionmill.llm.words import prefix_sums, span_hashes

LENGTH = 200
PIECE, SYMBOL = 32, 16
GROUP = 4096
BROADCAST_LIMIT = 64 << 20
_SEGMENT = 1 << 20
_PLACE = np.uint64(_SEGMENT - 1)
_SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32())])


def _least(codes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, from running minima of blocks in both directions."""
    pad = -len(codes) % width
    blocks = np.concatenate([codes, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(codes) - width + 1], ahead[width - 1 : len(codes)])


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Per anchor of a text: place, first and last window that has it, hash of the piece, hash of the context."""
    parts = []
    step = _SEGMENT - length
    for at in range(0, max(0, len(raw) - length + 1), step):
        part = raw[at : at + step + length - 1]
        sums = prefix_sums(part)
        places = np.arange(len(part) - PIECE + 1)
        pieces = span_hashes(sums, places, places + PIECE)
        place = (_least((pieces & ~_PLACE) | places.astype(np.uint64), length - PIECE + 1) & _PLACE).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        low, high = edges[:-1], edges[1:] - 1
        parts.append((place[low] + at, low + at, high + at, pieces[place[low]], span_hashes(sums, low, high + length)))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if value.is_valid else b"", dtype=np.uint8)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "anchor", "context", "place", "low", "high"]
    for batch in batches:
        held, size = [], 0
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        for i, text in enumerate(batch["text"]):
            place, low, high, piece, context = anchors(_bytes(text))
            n = len(place)
            held.append((np.full(n, k1[i]), np.full(n, k2[i]), piece.view(np.int64), context.view(np.int64), *(x.astype(np.int32) for x in (place, low, high))))
            size += n
            if size > 200_000 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                held, size = [], 0


def repeated_in_group(contexts: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each context (bytes, offset of the anchor, count) the starts of its windows that another place has too."""
    run = (length - SYMBOL + 1) // SYMBOL
    names: dict[bytes, int] = {}
    text, owner, starts = [], [], []
    for c, (raw, anchor, _) in enumerate(contexts):
        for at in range(anchor % SYMBOL, len(raw) - SYMBOL + 1, SYMBOL):
            text.append(names.setdefault(raw[at : at + SYMBOL], len(names)))
            owner.append(c)
            starts.append(at)
        text.append(-1 - c)  # no run goes over the end of a context
        owner.append(c)
        starts.append(len(raw))
    order = suffix_array(text)
    prefixes = common_prefixes(text, order)
    found: list[set[int]] = [set() for _ in contexts]

    def compare(members: list[int]) -> None:
        for slack in range(SYMBOL):
            windows: dict[bytes, list[tuple[int, int]]] = {}
            for m in members:
                c, at = owner[m], starts[m] - slack
                if 0 <= at <= len(contexts[c][0]) - length:
                    windows.setdefault(contexts[c][0][at : at + length], []).append((c, at))
            for places in windows.values():
                if len(places) > 1 or contexts[places[0][0]][2] > 1:
                    for c, at in places:
                        found[c].add(at)

    members = [order[0]] if order else []
    for k in range(1, len(order)):
        if prefixes[k] < run:
            if len(members) > 1:
                compare(members)
            members = []
        members.append(order[k])
    if len(members) > 1:
        compare(members)
    return [np.array(sorted(f), dtype=np.int64) for f in found]


def _runs(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Spans covered by windows that start here."""
    cuts = np.flatnonzero(np.diff(starts) > length)
    firsts, lasts = np.append(starts[:1], starts[cuts + 1]), np.append(starts[cuts], starts[-1:])
    return [{"first": int(a), "end": int(b) + length} for a, b in zip(firsts, lasts, strict=True)]


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> spans within each context that occurs once."""
    held: dict[int, tuple[bytes, int, int]] = {}
    anchor = None

    def out() -> pa.RecordBatch:
        keys, spans = [], []
        if len(held) > 1:
            for (key, (_, _, n)), starts in zip(held.items(), repeated_in_group(list(held.values())), strict=True):
                if n == 1 and len(starts):
                    keys.append(key)
                    spans.append(_runs(starts, LENGTH))
        return pa.RecordBatch.from_arrays([pa.array([anchor] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, pa.list_(_SPAN))], ["anchor", "context", "spans"])

    for batch in batches:
        for a, context, raw, offset, n in zip(*[batch[c].to_pylist() for c in ("anchor", "context", "raw", "offset", "n")], strict=True):
            if a != anchor:
                if len(held) > 1:
                    yield out()
                anchor, held = a, {}
            held[context] = (raw, offset, n)
    yield out()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, context, raw, n in zip(*[batch[c].to_pylist() for c in ("anchor", "context", "raw", "n")], strict=True):
            size = len(raw) - LENGTH + 1
            hashes = [xxhash.xxh3_128_digest(raw[at : at + LENGTH]) for at in range(size)]
            columns = [pa.array([anchor] * size, pa.int64()), pa.array([context] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n] * size, pa.int64())], ["anchor", "context", "start", "window", "n"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, wanted in zip(batch["text"], batch["wanted"].to_pylist(), strict=True):
            raw = bytes(_bytes(text))
            columns = list(zip(*[(w["anchor"], w["context"], w["place"] - w["low"], w["n"], w["many"], raw[w["low"] : w["high"] + LENGTH]) for w in wanted], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()], strict=True)],
                ["anchor", "context", "offset", "n", "many", "raw"],
            )


def _with_rows(docs: DataFrame, per_row: DataFrame, size, how: str) -> DataFrame:
    """docs (k1, k2, text, ...) joined with one row per (k1, k2): by broadcast if that is small, else by a shuffle."""
    return docs.join(F.broadcast(per_row) if small(per_row, size, BROADCAST_LIMIT) else per_row, ["k1", "k2"], how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document that has any: k1, k2 (keys of the row), spans (first byte, end; maximal runs)."""
    k1, k2 = row_keys()
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), text_or_empty().alias("text"))
    # Anchors are found twice rather than kept: written down they would take more room than the texts.
    found = keyed.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _find_anchors, "k1 long, k2 long, anchor long, context long, place int, low int, high int"
    )
    counted = (
        found.groupBy("anchor")
        .agg(F.count("*").alias("c"), F.min("context").alias("one"), F.max("context").alias("other"))
        .where("c > 1")
        .select("anchor", "c", (F.col("one") != F.col("other")).alias("mixed"))
    )
    counted = checkpointed(counted)
    total = counted.agg(F.sum("c")).first()[0] or 0
    places = checkpointed(join_salted(found, counted, ["anchor"], "c", total, F.struct("k1", "place")).drop("c"))
    mixed = places.where("mixed")
    contexts = checkpointed(
        mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place", "low", "high")).alias("row"))
    )
    many = contexts.groupBy("anchor").count().select("anchor", (F.col("count") > GROUP).alias("many"))
    wanted = (
        contexts.join(many, "anchor")
        .select("anchor", "context", "n", "many", "row.*")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "context", "place", "low", "high", "n", "many")).alias("wanted"))
    )
    wanted = checkpointed(wanted)
    cut = checkpointed(
        _with_rows(keyed, wanted, F.size("wanted") * 56 + 32, "inner")
        .select("text", "wanted")
        .mapInArrow(_cut_contexts, "anchor long, context long, offset int, n long, many boolean, raw binary")
    )
    schema = "anchor long, context long, spans array<struct<first: int, end: int>>"
    single = cut.where("not many").drop("many").repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(_sort_groups, schema)
    windows = cut.where("many").dropDuplicates(["anchor", "context"]).mapInArrow(_windows, "anchor long, context long, start int, window binary, n long")
    again = windows.groupBy("anchor", "window").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
    spread = (
        windows.where("n = 1")
        .join(again, ["anchor", "window"])
        .groupBy("anchor", "context")
        .agg(F.transform(F.collect_list("start"), lambda s: F.struct(s.alias("first"), (s + LENGTH).alias("end"))).alias("spans"))
    )
    once = single.union(spread).join(contexts, ["anchor", "context"])
    spans = (
        places.where("not mixed")
        .select("k1", "k2", F.array(F.struct(F.col("low").alias("first"), (F.col("high") + LENGTH).alias("end"))).alias("spans"))
        .union(
            join_counted(mixed, contexts.where("n > 1").select("anchor", "context", "n"), ["anchor", "context"], "n", total).select(
                "k1", "k2", F.array(F.struct(F.col("low").alias("first"), (F.col("high") + LENGTH).alias("end"))).alias("spans")
            )
        )
        .union(
            once.select(
                "row.k1",
                "row.k2",
                F.transform("spans", lambda s: F.struct((s["first"] + F.col("row.low")).alias("first"), (s["end"] + F.col("row.low")).alias("end"))),
            )
        )
    )
    # A set: rows equal in id and text bring the same spans, however many they are.
    listed = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return listed.mapInArrow(_merge, "k1 long, k2 long, spans array<struct<first: int, end: int>>")


def merged(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [[{"first": a, "end": b} for a, b in merged(spans)] for spans in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(runs, pa.list_(_SPAN))], ["k1", "k2", "spans"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, digests = [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            raw, gone = bytes(_bytes(text)), merged(spans or [])
            edges = [0, *[x for run in gone for x in run], len(raw)]
            digest = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                digest.update(raw[a:b])
            size.append(len(raw))
            removed.append(sum(b - a for a, b in gone))
            runs.append(len(gone))
            digests.append(digest.hexdigest())
        columns = [batch["doc_id"], *[pa.array(c, pa.int64()) for c in (size, removed, runs)], pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)."""
    docs = plain_columns(docs, "doc_id", "text")
    spans = checkpointed(repeated_spans(docs))
    k1, k2 = row_keys()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_or_empty().alias("text"))
    rows = _with_rows(keyed, spans, F.size("spans") * 32 + 32, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
