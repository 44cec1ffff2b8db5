"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become word hashes. Seeds, runs of five words found by a Karp-Rabin running
hash, are joined with the seeds of the benchmark. For each pair of document and item whose seeds could
cover enough of the item, the longest match that overlaps no earlier tile is marked again and again, in
both texts, until no free match of five words remains. The pair is contaminated if tiles cover at least
0.8 of the item's words, in whatever order they stand in the document.

The benchmark's index goes to the executors in blocks of bounded size (`BLOCK_BYTES` of text each). Of one block
the documents are read once and never shuffled. Where there are more, one pass with a bit table of all seeds
(`FILTER_BITS`) puts the suspects aside, documents in which enough words are covered by possible seeds, and only
those meet the blocks, one at a time.

Defined cases: null texts count as empty. An item of fewer than five words has no seed and contaminates
nothing. Equal items and repeated rows are reported each. Of equally long matches the one that begins
first in the document, then in the item, is marked first. Very long texts, of one repeated word too, cost their
length times a logarithm, as matches are sought from where they begin. Empty tables give an empty result (`clean`:
keep everything). Other columns are carried along by `clean` and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, map_rows, plain_columns, row_keys, text_or_empty
from sessionmill.llm.words import SHINGLE, batch_words, powers, text_slices, window_hashes

COVERAGE = 0.8
BLOCK_BYTES = 16 << 20
#: Size of the bit table that tells suspects where the benchmark has several blocks: 64 MB.
FILTER_BITS = 1 << 29
_TILES = "array<struct<doc_word long, item_word long, words long>>"


def _room(used: np.ndarray) -> np.ndarray:
    """For each place, how many free places follow from there on; 0 where it is used."""
    taken = np.append(np.flatnonzero(used), len(used))
    at = np.arange(len(used))
    return taken[np.searchsorted(taken, at)] - at


def _left(words: np.ndarray, used: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each place, and whether there is no free one."""
    return words[at - 1], (at == 0) | used[at - 1]


class _Pair:
    """A document's words and an item's words, what of them is marked, and their running hashes."""

    def __init__(self, doc: np.ndarray, item: np.ndarray, used: np.ndarray):
        self.words = doc, item
        self.used = used.copy(), np.zeros(len(item), dtype=bool)
        up, self.down = powers(max(len(doc), len(item)))
        self.sums = tuple(np.concatenate([[np.uint64(0)], np.cumsum(w * up[: len(w)], dtype=np.uint64)]) for w in self.words)

    def _hash(self, side: int, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[side][at + size] - self.sums[side][at]) * self.down[at]

    def matches(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal free matches of at least `size` words: starts in document and item, lengths.

        Windows of `size` words with equal hashes are paired only where a match begins, that is where the
        words before them differ, so a text of one repeated word costs its length and not its square.
        """
        room = [_room(u) for u in self.used]
        starts = [np.flatnonzero(r >= size) for r in room]
        hashes = [self._hash(side, at, size) for side, at in enumerate(starts)]
        common = np.intersect1d(*hashes)
        for side in (0, 1):
            inside = np.isin(hashes[side], common)
            order = np.argsort(hashes[side][inside], kind="stable")
            starts[side], hashes[side] = starts[side][inside][order], hashes[side][inside][order]
        (d, t), bounds = starts, [np.append(np.searchsorted(h, common), len(h)) for h in hashes]
        (word_d, edge_d), (word_t, edge_t) = (_left(w, u, at) for w, u, at in zip(self.words, self.used, starts, strict=True))
        one = (np.diff(bounds[0]) == 1) & (np.diff(bounds[1]) == 1)
        i, j = bounds[0][:-1][one], bounds[1][:-1][one]
        begin = edge_d[i] | edge_t[j] | (word_d[i] != word_t[j])
        found_d, found_t = [d[i[begin]]], [t[j[begin]]]
        for k in np.flatnonzero(~one):
            mine, other = (slice(b[k], b[k + 1]) for b in bounds)
            free = ~edge_t[other]
            groups = [(word, t[other][free & (word_t[other] == word)]) for word in np.unique(word_t[other][free])]
            for word, spots in [*groups, (None, t[other][~free])]:
                begins = d[mine] if word is None else d[mine][edge_d[mine] | (word_d[mine] != word)]
                found_d.append(np.repeat(begins, len(spots)))
                found_t.append(np.tile(spots, len(begins)))
        p, q = np.concatenate(found_d), np.concatenate(found_t)
        low, high = np.full(len(p), size), np.minimum(room[0][p], room[1][q])
        while (low < high).any():  # the longest equal run by binary search
            mid = (low + high + 1) // 2
            same = self._hash(0, p, mid) == self._hash(1, q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return p, q, low

    def mark(self, size: int) -> Iterator[tuple[int, int, int]]:
        """Mark the longest free match again and again while it has `size` words. Words are compared, not only hashes."""
        heap = [(-n, p, t) for p, t, n in zip(*(a.tolist() for a in self.matches(size)), strict=True)]
        heapq.heapify(heap)
        while heap:
            n, p, t = heapq.heappop(heap)
            own, other = slice(p, p - n), slice(t, t - n)
            blocked = self.used[0][own] | self.used[1][other] | (self.words[0][own] != self.words[1][other])
            if not blocked.any():
                self.used[0][own] = self.used[1][other] = True
                yield p, t, -n
                if not (_room(self.used[1]) >= size).any():
                    return
                continue
            edges = np.concatenate([[-1], np.flatnonzero(blocked), [-n]])  # free parts go back, to be met at their own length
            for k in np.flatnonzero(np.diff(edges) > size).tolist():
                begin = int(edges[k]) + 1
                heapq.heappush(heap, (begin - int(edges[k + 1]), p + begin, t + begin))


def tiles(doc: np.ndarray, item: np.ndarray, used: np.ndarray | None = None, least: int = SHINGLE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two runs of word hashes: (start in document, start in item, words).

    The search length falls by halves down to `least`; all matches of a length or more are marked before
    shorter ones are sought among what is still free. `used` are words of the document no tile may take.
    """
    pair = _Pair(doc, item, np.zeros(len(doc), dtype=bool) if used is None else used)
    size, found = least, []
    while 2 * size <= min(len(doc), len(item)):
        size *= 2
    while size >= least:
        found += pair.mark(size)
        size //= 2
    return found


class SeedIndex:
    """Seeds of a block of benchmark items: sorted hashes, and for each the items and places that have it."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        words, begins = batch_words(texts)
        self.ids = ids
        self.words, self.begins = words, begins
        self.size = np.diff(begins)
        hashes, items, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for item, (low, high) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            own = window_hashes(words[low:high], SHINGLE)
            hashes.append(own)
            items.append(np.full(len(own), item, dtype=np.int32))
            places.append(np.arange(len(own), dtype=np.int32))
        joined = np.concatenate(hashes)
        order = np.argsort(joined, kind="stable")
        self.item, self.place = np.concatenate(items)[order], np.concatenate(places)[order]
        self.seeds, first = np.unique(joined[order], return_index=True)
        self.first = np.append(first, len(joined))

    def matches(self, texts: pa.Array, coverage: float = COVERAGE) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(row, item, coverage, tiles) of every contaminated pair, by row."""
        if not len(self.seeds):
            return
        for first, stop in text_slices(texts):
            yield from ((first + row, *found) for row, *found in self._slice(texts.slice(first, stop - first), coverage))

    def _slice(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        words, begins = batch_words(texts)
        hashes = window_hashes(words, SHINGLE)
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == hashes)
        row = np.searchsorted(begins, hit, side="right") - 1
        inside = hit + SHINGLE <= begins[row + 1]
        hit, row = hit[inside], row[inside]
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(0, dtype=int)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            own = int(row[low])
            doc = words[begins[own] : begins[own + 1]]
            yield from ((own, *found) for found in self._pairs(doc, hit[low:high] - begins[own], at[hit[low:high]], coverage))

    def _pairs(
        self, doc: np.ndarray, places: np.ndarray, seeds: np.ndarray, coverage: float
    ) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        used = np.unique(seeds)
        owners = np.concatenate([self.item[self.first[s] : self.first[s + 1]] for s in used])
        spots = np.concatenate([self.place[self.first[s] : self.first[s + 1]] for s in used])
        codes = np.repeat(used, self.first[used + 1] - self.first[used])
        order = np.lexsort((spots, owners))
        owners, spots, codes = owners[order], spots[order], codes[order]
        edges = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]]))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            item = int(owners[low])
            spot = spots[low:high]
            reach = SHINGLE + int(np.minimum(np.diff(spot), SHINGLE).sum())  # words that any seed covers
            if reach < coverage * self.size[item]:
                continue  # tiles lie within seeds, so they cannot cover enough
            at = places[np.isin(seeds, codes[low:high])]
            covered = np.unique((at[:, None] + np.arange(SHINGLE)).ravel())  # words of the document that a seed covers
            if len(covered) < coverage * self.size[item]:
                continue
            gaps = np.flatnonzero(np.diff(covered) > 1) + 1  # a used word between stretches: no match runs across
            stretch, used = np.insert(covered, gaps, 0), np.insert(np.zeros(len(covered), dtype=bool), gaps, True)
            own = self.words[self.begins[item] : self.begins[item + 1]]
            marked = [(int(stretch[p]), t, n) for p, t, n in tiles(doc[stretch], own, used)]
            part = sum(n for _, _, n in marked) / int(self.size[item])
            if part >= coverage:
                yield item, part, marked


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", text_or_empty().alias("text"))


def _block_count(benchmark: DataFrame, block_bytes: int) -> int:
    total = _items(benchmark).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return -(-total // block_bytes)


def _block(benchmark: DataFrame, k: int, blocks: int) -> SeedIndex:
    part = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
    return SeedIndex(part["item_id"].combine_chunks(), part["text"].combine_chunks())


def _cells(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Two cells of the bit table for each seed."""
    yield (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    yield ((hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _seed_filter(benchmark: DataFrame) -> tuple[np.ndarray, int]:
    """Bit table of all seeds of the benchmark, at most FILTER_BITS in size, and the fewest words of an item with seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in text_slices(batch["text"]):
                words, begins = batch_words(batch["text"].slice(first, stop - first))
                size = np.diff(begins)
                if not (size >= SHINGLE).any():
                    continue
                cells = np.unique(np.concatenate(list(_cells(window_hashes(words, SHINGLE)))))
                place, at = np.unique(cells >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), at)
                least = np.full(len(place), size[size >= SHINGLE].min())
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits.view(np.int64)), pa.array(least)], ["place", "bits", "least"])

    parts = _items(benchmark).select("text").mapInArrow(run, "place long, bits long, least long")
    rows = parts.groupBy("place").agg(F.bit_or("bits").alias("bits"), F.min("least").alias("least")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    table[rows["place"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table, int(rows["least"].to_numpy().min()) if rows.num_rows else 0


def suspects(texts: pa.Array, table: np.ndarray, words_needed: float) -> np.ndarray:
    """Whether possible seeds of the benchmark cover that many words of a text: no contaminated text is missed."""
    out = np.zeros(len(texts), dtype=bool)
    for first, stop in text_slices(texts):
        words, begins = batch_words(texts.slice(first, stop - first))
        hashes = window_hashes(words, SHINGLE)
        hit = np.ones(len(hashes), dtype=bool)
        for cells in _cells(hashes):
            hit &= (table[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) == 1
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        for j in range(SHINGLE):
            covered[1 + j : 1 + j + len(hit)] |= hit
        sums = np.cumsum(covered)
        found = sums[begins[1:]] - sums[begins[:-1]]
        out[first:stop] = (found >= words_needed) & (found > 0)
    return out


def _suspect_rows(docs: DataFrame, seeds, coverage: float, wanted: bool) -> DataFrame:
    """The rows that may be contaminated (or the others), told by the bit table alone, in one pass."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least = seeds.value
        for batch in batches:
            yield batch.filter(pa.array(suspects(batch.column(place), table, coverage * least) == wanted))

    return map_rows(docs, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, coverage, and the tiles in words."""
    docs = plain_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type}, coverage double, tiles {_TILES}"
    tile_type = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))

    def search(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.value.matches(batch["text"], coverage))
                ids = index.value.ids.take(pa.array([f[1] for f in found], pa.int64()))
                tiled = pa.array([[dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in f[3]] for f in found], tile_type)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array([f[0] for f in found], pa.int64())), ids, pa.array([f[2] for f in found], pa.float64()), tiled],
                    ["doc_id", "item_id", "coverage", "tiles"],
                )

        return docs.mapInArrow(run, schema)

    blocks = _block_count(benchmark, block_bytes)
    if blocks > 1:
        docs = checkpointed(_suspect_rows(docs, spark.sparkContext.broadcast(_seed_filter(benchmark)), coverage, True))
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        index = spark.sparkContext.broadcast(_block(benchmark, k, blocks))
        part = search(index)
        if blocks > 1:  # one block's index at a time on the executors
            part = checkpointed(part)
            index.unpersist()
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns."""
    place = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    blocks = _block_count(benchmark, block_bytes)
    if blocks == 0:
        return docs
    if blocks == 1:
        index = sc.broadcast(_block(benchmark, 0, 1))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in index.value.matches(batch.column(place), coverage)]] = False
                yield batch.filter(pa.array(keep))

        return map_rows(docs, drop)
    seeds = sc.broadcast(_seed_filter(benchmark))
    names = [f"_{i}" for i in range(len(docs.columns))]
    k1, k2 = row_keys("_k", f"_{place}")
    rows = _suspect_rows(docs, seeds, coverage, True).toDF(*names).withColumn("_k", F.lit(0))
    rows = checkpointed(rows.withColumns({"_k1": k1, "_k2": k2}).drop("_k"))
    text = rows.select(F.struct("_k1", "_k2").alias("doc_id"), F.col(f"_{place}").alias("text"))
    bad = contaminated(text, benchmark, coverage, block_bytes).select("doc_id.*").distinct()
    kept = rows.join(bad, ["_k1", "_k2"], "left_anti").select(*names).toDF(*docs.columns)
    return _suspect_rows(docs, seeds, coverage, False).union(kept)
