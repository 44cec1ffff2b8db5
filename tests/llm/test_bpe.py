import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import SF, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={}
)
ENCODER = bpe._encoder(RANKS, P.PATTERN)


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet=st.sampled_from("abz 1'slt!\n\t 　é中Ⅷ𝟘"), max_size=60), st.integers(3, 12), st.integers(1, 3))
def test_stitched_pieces_are_those_of_the_whole_text(text, chunk, overlap):
    chunks = []
    for at in range(0, len(text), chunk):
        low = max(0, at - overlap)
        chunks.append((low, at + chunk, ENCODER.starts(text[low : at + chunk + overlap]) + low))
    pieces = bpe.stitch(text, chunks, ENCODER) if chunks else []
    assert pieces == ENCODER.pattern.findall(text)


def test_chunk_inside_one_long_piece():
    text = "a" * 100 + " b" + "c" * 50
    chunks = [(max(0, at - 2), at + 10, ENCODER.starts(text[max(0, at - 2) : at + 12]) + max(0, at - 2)) for at in range(0, len(text), 10)]
    assert bpe.stitch(text, chunks, ENCODER) == ["a" * 100, " b" + "c" * 50]


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 4)])
def test_given_documents(spark, chunk, overlap):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.token_digests(docs, RANKS, P.PATTERN, chunk, overlap).collect()}
    assert got == {r.doc_id: digests(r.text) for r in docs.collect()}


def test_odd_rows_and_round_trip(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    got = sorted((str(tuple(r)) for r in bpe.token_digests(docs, RANKS, P.PATTERN).collect()))
    assert got == sorted(str((r.doc_id, *digests(r.text))) for r in rows)
    coded = bpe.encode_documents(docs.drop("ids"), RANKS, P.PATTERN)
    assert coded.columns == [*docs.drop("ids").columns, "ids"]
    decoded = bpe.decode_documents(coded, RANKS, P.PATTERN).collect()
    assert len(decoded) == len(rows)
    for r in decoded:
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()


def test_clashing_name_empty_table_and_bad_overlap(spark):
    docs = odd_docs(spark)  # it has a column ids
    assert bpe.encode_documents(docs, RANKS, P.PATTERN).columns[-1] == "ids_"
    assert bpe.token_digests(docs.where("false"), RANKS, P.PATTERN).collect() == []
    with pytest.raises(ValueError):
        bpe.token_digests(docs, RANKS, P.PATTERN, 5, 6)
    assert np.array_equal(ENCODER.starts(""), [])
