"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. Pre-token frequencies over all documents (summed per task, then shuffled by pre-token).
2. The number of tokens of each distinct pre-token, by the library.
3. The join with each document's own frequencies. Pre-tokens that are frequent enough go to the executors as
   two sorted arrays of at most `FREQUENT` entries of 12 bytes; the frequency bound follows from a histogram.
   All rarer ones, which no key can make hot, are joined by a shuffle on the pre-token.

The arrays are probed by the 64-bit xxhash of the pre-token.

Defined cases: a null text counts as empty and has no tokens. A special string of the vocabulary inside a
text counts as one token, as the library takes it by default, and splits the text. Repeated rows are
counted each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmill.llm.common import checkpointed

FREQUENT = 1 << 19
_HELD = 300_000  # distinct pre-tokens that a task holds before it passes them on
_loaded: dict[str, Tokenizer] = {}


class PreTokens:
    """Splits texts as the library does before its merges: special strings first, then the pattern."""

    def __init__(self, vocabulary: str, pattern: str):
        added = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
        added.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(pattern)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if self.special is None or self.special.search(text) is None:
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1


def _tokenizer(vocabulary: str) -> Tokenizer:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer.from_str(vocabulary)
    return _loaded[key]


def _digest(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode())


def piece_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per distinct pre-token: piece, n (in all documents), tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, held = PreTokens(shared.value, pattern), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch["text"]:
                held.update(pre.split(text.as_py() or "")[0])
                if len(held) >= _HELD:
                    yield out()
                    held.clear()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            pieces = batch["piece"].to_pylist()
            tokens = [len(tokenizer.encode(p, add_special_tokens=False)) for p in pieces]
            yield pa.RecordBatch.from_arrays([batch["piece"], batch["n"], pa.array(tokens, pa.int64())], ["piece", "n", "tokens"])

    total = docs.select("text").mapInArrow(frequencies, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return checkpointed(total.mapInArrow(count, "piece string, n long, tokens long"))


def _frequent(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least frequency of which at most `limit` pre-tokens have it or more; their digests, sorted, and tokens."""
    bins = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()  # at most 63 rows
    least, held = 64, 0
    for e, n in sorted(bins, reverse=True):
        if held + n > limit:
            break
        least, held = e, held + n

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_digest(p) for p in batch["piece"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch["tokens"].cast(pa.int32())], ["digest", "tokens"])

    bound = 1 << least if least < 63 else (1 << 63) - 1
    part = counts.where(F.col("n") >= bound).select("piece", "tokens").mapInArrow(digests, "digest long, tokens int").toArrow()
    keys = part["digest"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return bound, keys[order], part["tokens"].to_numpy()[order]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `vocabulary` is the library's JSON text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = piece_counts(docs, vocabulary, pattern)
    bound, keys, tokens = _frequent(counts, frequent)
    sc = docs.sparkSession.sparkContext
    shared, arrays = sc.broadcast(vocabulary), sc.broadcast((keys, tokens))
    rare_type = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(shared.value, pattern)
        known, size = arrays.value
        near: dict[str, int] = {}  # recent answers
        for batch in batches:
            bytes_, totals, rares = [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                pieces, special = pre.split(text)
                own, total = Counter(pieces), special
                ask = []
                for piece, n in own.items():
                    answer = near.get(piece)
                    if answer is None:
                        ask.append(piece)
                    else:
                        total += answer * n
                rare = []
                if ask:
                    digests = np.array([_digest(p) for p in ask], dtype=np.uint64)
                    at = np.minimum(np.searchsorted(known, digests), max(0, len(known) - 1))
                    hit = known[at] == digests if len(known) else np.zeros(len(ask), dtype=bool)
                    for piece, found, place in zip(ask, hit.tolist(), at.tolist(), strict=True):
                        if found:
                            answer = int(size[place])
                            total += answer * own[piece]
                            if len(near) >= _HELD:
                                near.clear()
                            near[piece] = answer
                        else:
                            rare.append({"piece": piece, "n": own[piece]})
                bytes_.append(len(text.encode()))
                totals.append(total)
                rares.append(rare)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(bytes_, pa.int64()), pa.array(totals, pa.int64()), pa.array(rares, rare_type)],
                ["doc_id", "n_bytes", "known", "rare"],
            )

    rows = docs.mapInArrow(sums, "doc_id long, n_bytes long, known long, rare array<struct<piece: string, n: bigint>>")
    if bound > 1:  # some pre-tokens are not in the arrays
        one = rows.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode_outer("rare").alias("r")).select("*", "r.*")
        rest = counts.where(F.col("n") < bound).select("piece", "tokens")
        # A row without rare pre-tokens gets a key of its own (no pre-token mixes this sign and digits).
        key = F.coalesce("piece", F.concat(F.lit("\x00"), F.col("row").cast("string")))
        joined = one.drop("rare", "r").withColumn("piece", key).join(rest, "piece", "left")
        rows = joined.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_bytes").alias("n_bytes"),
            (F.first("known") + F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0))).alias("known"),
        )
    return rows.select("doc_id", "n_bytes", F.col("known").alias("n_tokens"), (F.col("known") > limit).alias("over_limit"))
