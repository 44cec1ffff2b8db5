"""Phrase collocations per language, counted in HAT-tries.

Each task counts phrases of word ids in a HAT-trie: a shallow trie over the digits of the ids whose leaves
are hash containers. A container that grows beyond `BURST` phrases bursts into a trie node with one container
per next digit. Beyond `HELD` phrases in a task the largest subtrees are spilled whole, each as a run sorted by
word ids, which makes neighbours share their prefix. Spark deals the runs to partitions by the phrase, where
the counts of equal phrases are merged. The partition key is the whole phrase, so a frequent prefix does not
gather in one task.

Two passes read the texts. The first counts words and pairs. The second counts a triple only if both its
pairs may be frequent, as no triple occurs oftener than its pairs; they are looked up in a bit table of fixed
size (`BITS`), whose false hits cost counting and change nothing.

Defined cases: null texts count as empty, a null language as `und` (together with any `und` in the data). Rows
with equal or null ids all count; ids and other columns are not read. An empty table, or one without
candidates, gives an empty result. A text is split as a whole; beside it a task holds about ten times the
size of the longest text and at most `HELD` phrases. Words of any length count. Ties in the score go to the
larger count, then to the phrase that comes first by its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionmill.llm.common import checkpointed, plain_columns
from sessionmill.llm.words import mix, text_slices

LEAST = 10  # occurrences of a candidate
TOP = 2000  # rows of a language
CONTAINED = 50  # per cent: the share of a phrase that lies in a longer candidate from which on it is dropped
BURST = 1 << 14
HELD = 1 << 19
BITS = 1 << 26  # of the table of frequent pairs: 8 MB
_ID_BITS = 21
_MOST_WORDS = 1 << _ID_BITS
_DIGIT = 8
_SALTS = 64
_ROWS = 1 << 16  # of an emitted batch
_SCHEMA = "lang string, phrase string, f long"
_FIELDS = ["lang", "phrase", "f"]
_TOTAL = ""  # the phrase of the row that counts all words of a language

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class HatTrie:
    """Counts of phrases, each packed into one integer of word ids."""

    def __init__(self) -> None:
        self.slots: dict[int, Counter | HatTrie] = {}

    def add(self, keys: np.ndarray, shift: int) -> int:
        """Count keys, which share all bits above `shift` digits; returns how many were new."""
        shift -= _DIGIT
        digits = (keys >> np.int64(shift)).astype(np.uint8)
        keys = keys[np.argsort(digits, kind="stable")]
        ends = np.cumsum(np.bincount(digits, minlength=1 << _DIGIT))
        new = 0
        for digit in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            some = keys[ends[digit - 1] if digit else 0 : ends[digit]]
            child = self.slots.setdefault(digit, Counter())
            if isinstance(child, HatTrie):
                new += child.add(some, shift)
                continue
            before = len(child)
            child.update(some.tolist())
            new += len(child) - before
            if len(child) > BURST and shift:
                self.slots[digit] = _burst(child, shift)
        return new

    def containers(self) -> Iterator[Counter]:
        for child in self.slots.values():
            if isinstance(child, HatTrie):
                yield from child.containers()
            else:
                yield child

    def run(self, digit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order with their counts, of the whole trie or of the subtree of one digit."""
        top = self if digit is None else self.slots[digit]
        parts = list(top.containers()) if isinstance(top, HatTrie) else [top]
        size = sum(map(len, parts))
        keys = np.fromiter((k for c in parts for k in c), dtype=np.int64, count=size)
        counts = np.fromiter((n for c in parts for n in c.values()), dtype=np.int64, count=size)
        order = np.argsort(keys)
        return keys[order], counts[order]


def _burst(container: Counter, shift: int) -> HatTrie:
    node = HatTrie()
    shift -= _DIGIT
    for key, n in container.items():
        node.slots.setdefault(key >> shift & 0xFF, Counter())[key] = n
    return node


class Tally:
    """Words and phrases of `order` words of one language, as a task has met them so far."""

    def __init__(self, lang: str, order: int) -> None:
        self.lang, self.order = lang, order
        self.ids: dict[str, int] = {}
        self.named = pa.array([], pa.large_string())
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.words = np.zeros(0, dtype=np.int64)
        self.trie, self.held = HatTrie(), 0
        self.width = 24 if order == 2 else _ID_BITS  # bits of a word id in a key, the first word highest
        self.shift = 48 if order == 2 else 64

    def learn(self, found: pa.DictionaryArray) -> np.ndarray:
        named = found.dictionary.to_pylist()
        before = len(self.ids)
        own = np.array([self.ids.setdefault(w, len(self.ids)) for w in named], dtype=np.int64)
        if len(self.ids) > before:
            if self.order == 3:
                new = list(self.ids)[before:]
                self.hashes = np.concatenate([self.hashes, word_hashes(new)])
            self.words = np.concatenate([self.words, np.zeros(len(self.ids) - before, dtype=np.int64)])
        return own[found.indices.to_numpy()]

    def count(self, ids: np.ndarray, piece: np.ndarray, table: np.ndarray | None) -> None:
        if table is None:
            self.words += np.bincount(ids, minlength=len(self.words))
        pair = piece[1:] == piece[:-1]
        if self.order == 2:
            keys = ids[:-1][pair] << self.width | ids[1:][pair]
        else:
            may = pair.copy()
            at = np.flatnonzero(pair)
            where = pair_places(self.hashes[ids[at]], self.hashes[ids[at + 1]], self.lang)
            may[at] = table[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8) & 1 == 1
            at = np.flatnonzero(may[:-1] & may[1:])
            keys = (ids[at] << self.width | ids[at + 1]) << self.width | ids[at + 2]
        self.held += self.trie.add(keys, self.shift)

    def known(self) -> pa.Array:
        if len(self.named) < len(self.ids):
            self.named = pa.array(list(self.ids), pa.large_string())
        return self.named

    def rows(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = self.known()
        low = (1 << self.width) - 1
        for at in range(0, len(keys), _ROWS):
            some = keys[at : at + _ROWS]
            parts = [words.take(pa.array(some >> self.width * k & low)) for k in range(self.order - 1, -1, -1)]
            yield _batch(self.lang, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), counts[at : at + _ROWS])

    def spill(self, goal: int) -> Iterator[pa.RecordBatch]:
        """Emit the largest subtrees until at least `goal` phrases are gone."""
        sizes = {d: sum(map(len, c.containers())) if isinstance(c, HatTrie) else len(c) for d, c in self.trie.slots.items()}
        for digit in sorted(sizes, key=sizes.get, reverse=True):
            if goal <= 0:
                break
            yield from self.rows(*self.trie.run(digit))
            del self.trie.slots[digit]
            self.held -= sizes[digit]
            goal -= sizes[digit]

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows(*self.trie.run())
        if self.order == 2:
            words = self.known()
            for at in range(0, len(words), _ROWS):
                yield _batch(self.lang, words[at : at + _ROWS], self.words[at : at + _ROWS])
            yield _batch(self.lang, pa.array([_TOTAL]), np.array([self.words.sum()]))


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrases), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())], _FIELDS)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts and the number of the piece each lies in; texts never share a piece."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    joined = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0]
    raw = np.frombuffer(joined.as_buffer(), dtype=np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = _LOWER[raw[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return words.dictionary_encode(), np.cumsum(kind == 2)[starts]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def pair_places(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    """Where a pair stands in the table of frequent pairs."""
    own = np.uint64(xxhash.xxh64_intdigest(lang))
    return mix(mix(first ^ own) + second * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(BITS - 1)


def _counting(batches: Iterator[pa.RecordBatch], order: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, Tally] = {}
    for batch in batches:
        for lang in pc.unique(batch["lang"]).to_pylist():
            texts = batch["text"].filter(pc.equal(batch["lang"], lang))
            for first, stop in text_slices(texts):
                words, piece = split_words(texts.slice(first, stop - first))
                tally = tallies.setdefault(lang, Tally(lang, order))
                if len(tally.ids) + len(words.dictionary) > _MOST_WORDS:
                    yield from tally.close()
                    tally = tallies[lang] = Tally(lang, order)
                tally.count(tally.learn(words), piece, table)
                if (held := sum(t.held for t in tallies.values())) > HELD:
                    for one in sorted(tallies.values(), key=lambda t: -t.held):
                        goal = held - HELD // 2
                        if goal > 0:
                            before = one.held
                            yield from one.spill(goal)
                            held -= before - one.held
    for tally in tallies.values():
        yield from tally.close()


def _merged(texts: DataFrame, count) -> DataFrame:
    """Counts of all tasks added up; the key is the phrase, so that frequent prefixes spread."""
    return texts.mapInArrow(count, _SCHEMA).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _pair_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch["lang"]).to_pylist():
            phrases = batch["phrase"].filter(pc.equal(batch["lang"], lang)).to_pylist()
            first, second = (word_hashes([p.split(" ")[k] for p in phrases]) for k in (0, 1))
            places = np.unique(pair_places(first, second, lang)).astype(np.int64)
            words, begins = np.unique(places >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (places & 63), begins) if len(places) else places
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def pair_table(pairs: DataFrame) -> np.ndarray:
    """The bit table of these pairs: at most BITS / 64 rows come to the driver, 16 bytes each."""
    found = pairs.mapInArrow(_pair_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint8)


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frequent words and pairs, with one row per language for all its words; frequent triples): lang, phrase, f."""
    texts = plain_columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    short = checkpointed(_merged(texts, lambda b: _counting(b, 2, None)).where((F.col("f") >= LEAST) | (F.col("phrase") == _TOTAL)))
    table = docs.sparkSession.sparkContext.broadcast(pair_table(short.where("instr(phrase, ' ') > 0")))
    triples = _merged(texts, lambda b: _counting(b, 3, table.value)).where(F.col("f") >= LEAST)
    return short, checkpointed(triples)


def collocations(docs: DataFrame) -> DataFrame:
    """Per language the TOP phrases: lang, rank, phrase, a, l, r, n, score."""
    short, triples = phrase_counts(docs)
    pairs = short.where("instr(phrase, ' ') > 0")
    head, tail = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    front, back = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    inner = triples.select("lang", F.explode(F.array(front, back)).alias("phrase"), F.col("f").alias("longer"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = pairs.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {CONTAINED} * f").drop("longer")
    cut = lambda left, right, k: F.struct(left.alias("left"), right.alias("right"), F.lit(k).alias("k"))
    cuts = alone.withColumn("cut", cut(head, tail, 1)).union(
        triples.withColumn("cut", F.explode(F.array(cut(head, back, 1), cut(front, tail, 2))))
    )
    parts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut.*")
    left = short.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = short.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr("cast(1000000 * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0))) AS long)")
    scored = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= TOP)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    totals = short.where(F.col("phrase") == _TOTAL).select("lang", F.col("f").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
