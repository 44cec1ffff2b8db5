"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

Texts of up to `CHUNK` characters are one chunk. Longer ones are cut into chunks that overlap their
neighbours, and the chunks are pre-tokenised in parallel. A chunk that begins inside a pre-token goes wrong
at first; from the first boundary it has in common with the chunk before, both agree, as a pre-token depends
only on the text from its start. There the pieces are stitched, per text, and then encoded. If the overlap
shows no common boundary (one pre-token longer than it), pre-tokenising goes on from the last sure boundary
until it meets one of the next chunk. Decoding joins the raw bytes of the ids.

Defined cases: a null text counts as empty and has no ids. Special strings are ordinary text. Repeated
rows are encoded each. An empty table gives an empty result. `encode_documents` keeps all other columns,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sessionmill.llm.common import checkpointed, free_name, map_rows, plain_columns, text_or_empty
from sessionmill.llm.words import text_slices

CHUNK, OVERLAP = 32768, 256
_CACHE = 100_000
_encoders: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes pre-tokens; keeps the most recent ones. `digest` names the vocabulary within a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, tuple[str, bytes, list[int]]] = {}

    def piece(self, piece: str) -> tuple[str, bytes, list[int]]:
        """The ids as decimal text, the bytes they decode to, the ids."""
        got = self.known.get(piece)
        if got is None:
            ids = self.bpe.encode_ordinary(piece)
            got = (" ".join(map(str, ids)), self.decode(ids), ids)
            if len(piece) < 64:
                if len(self.known) >= _CACHE:
                    self.known.clear()
                self.known[piece] = got
        return got

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int64)


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver; it goes to the executors as a broadcast of its own size."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(ranks: bytes, pattern: str) -> PieceEncoder:
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = PieceEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)
    return _encoders[key]


def _result(pieces: list[str], encoder: PieceEncoder, digests: bool) -> tuple:
    known, piece = encoder.known, encoder.piece
    coded = [known.get(p) or piece(p) for p in pieces]
    if not digests:
        return ([i for c in coded for i in c[2]],)
    ids = " ".join([c[0] for c in coded])
    return (
        ids.count(" ") + 1 if ids else 0,
        hashlib.sha256(ids.encode()).hexdigest(),
        hashlib.sha256(b"".join([c[1] for c in coded])).hexdigest(),
    )


def stitch(text: str, chunks: list[tuple[int, int, np.ndarray]], encoder: PieceEncoder) -> list[str]:
    """Pieces of a text from its chunks in order: (first and last character seen, boundaries in the text)."""
    sure = chunks[0][2]
    for low, _, own in chunks[1:]:
        common = np.intersect1d(sure[sure >= low], own, assume_unique=True)
        if len(common):
            meet = int(common[0])
        else:  # a pre-token longer than the overlap
            ahead, found, meet = set(own.tolist()), [], len(text)
            for m in encoder.pattern.finditer(text, int(sure[-1]) if len(sure) else 0):
                if m.start() in ahead:
                    meet = m.start()
                    break
                found.append(m.start())
            sure = np.concatenate([sure[:-1], np.array(found, dtype=np.int64)])
        sure = np.concatenate([sure[sure < meet], own[own >= meet]])
    ends = [*sure[1:].tolist(), len(text)]
    return [text[a:b] for a, b in zip(sure.tolist(), ends, strict=True)] if len(sure) else []


def _coded(docs: DataFrame, ranks: bytes, pattern: str, digests: bool, chunk: int, overlap: int) -> DataFrame:
    """docs with the columns of `_result` behind their own."""
    if overlap < 1 or chunk < overlap:
        raise ValueError("a chunk must be at least as long as the overlap")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    place = docs.columns.index("text")
    names = [free_name(docs, n) for n in (("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids",))]
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())]
    sql = ["long", "string", "string"] if digests else ["array<int>"]
    added = ", ".join(f"`{n}` {t}" for n, t in zip(names, sql, strict=True))
    new_columns = docs.sparkSession.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in zip(names, sql, strict=True))).schema

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_slices(whole.column(place))):
            rows = [_result(encoder.pattern.findall(t.as_py() or ""), encoder, digests) for t in batch.column(place)]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                lows = list(range(0, len(text), chunk))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(lows), pa.int64()),
                        pa.array(lows, pa.int64()),
                        pa.array([max(0, a - overlap) for a in lows], pa.int64()),
                        pa.array([text[max(0, a - overlap) : a + chunk + overlap] for a in lows], pa.string()),
                    ],
                    ["row", "at", "low", "part"],
                )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            lows, parts = batch["low"].to_pylist(), batch["part"].to_pylist()
            starts = [(encoder.starts(p) + low).astype(np.int64).tobytes() for p, low in zip(parts, lows, strict=True)]
            own = [p[a - low :][:chunk] for p, a, low in zip(parts, batch["at"].to_pylist(), lows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["at"], batch["low"], pa.array(own, pa.string()), pa.array(starts, pa.binary())], ["row", "at", "low", "part", "starts"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        encoder = _encoder(shared.value, pattern)
        rows = rows.sort_values("at")
        text = "".join(rows["part"])
        chunks = [(low, low + len(p), np.frombuffer(s, dtype=np.int64)) for low, p, s in zip(rows["low"], rows["part"], rows["starts"], strict=True)]
        result = _result(stitch(text, chunks, encoder), encoder, digests)
        return pd.DataFrame({"row": [rows["row"].iloc[0]]} | {n: [v] for n, v in zip(names, result, strict=True)})

    fits = F.char_length(text_or_empty()) <= chunk
    row = free_name(docs, "_row")
    long = checkpointed(docs.where(~fits).withColumn(row, F.monotonically_increasing_id()))  # row ids must not change
    parts = long.select(F.col(row).alias("row"), "text").mapInArrow(cut, "row long, at long, low long, part string")
    spread = parts.repartition("row", "at").mapInArrow(pretokenise, "row long, at long, low long, part string, starts binary")
    joined = spread.groupBy("row").applyInPandas(join, f"row long, {added}").withColumnRenamed("row", row)
    stitched = long.join(joined, row).select(*[F.col(f"`{c}`") for c in [*docs.columns, *names]])
    return map_rows(docs.where(fits), short, new_columns).union(stitched)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column `ids` (array of int) behind its own columns."""
    return _coded(docs, ranks, pattern, False, chunk, overlap)


def token_digests(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by blanks), decoded_sha256 (of the decoded bytes)."""
    return _coded(plain_columns(docs, "doc_id", "text"), ranks, pattern, True, chunk, overlap).drop("text")


def decode_documents(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """tokens (with a column `ids`) with a binary column `bytes` behind its own; null ids decode to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    place, name = tokens.columns.index("ids"), free_name(tokens, "bytes")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            raw = [encoder.decode(ids or []) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, name])

    return map_rows(tokens, decode, StructType([StructField(name, BinaryType())]))
