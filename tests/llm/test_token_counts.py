from pathlib import Path

import public_tokenizers as P
import pytest
from helpers import SF, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionmill.llm import token_counts as tc

VOCABULARY = Path(P.path("byte_bpe_50k.json")).read_text()
LIBRARY = Tokenizer.from_str(VOCABULARY)


def plain(text):
    n = len(LIBRARY.encode(text or "", add_special_tokens=False))
    return len((text or "").encode()), n, n > 1024


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bcd", " ", "  ", "\n", "'s", "'", "12", "!", "é", "中", " ", "\x1c", "́", "<|endoftext|>"]), max_size=14).map("".join))
def test_pieces_add_up_to_the_library_count(text):
    pieces, special = tc.PreTokens(VOCABULARY, P.PATTERN).split(text)
    assert special + sum(len(LIBRARY.encode(p, add_special_tokens=False)) for p in pieces) == plain(text)[1]


@pytest.mark.parametrize("frequent", [tc.FREQUENT, 500, 0])
def test_given_documents(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in tc.count_tokens(docs, VOCABULARY, P.PATTERN, frequent=frequent).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


@pytest.mark.parametrize("frequent", [tc.FREQUENT, 3])
def test_odd_rows(spark, frequent):
    docs = odd_docs(spark, [(1, "a<|endoftext|> b"), (1, "a<|endoftext|> b"), (2, None), (3, ""), (None, "x y"), (4, "word " * 20_000), (5, "z" * 50_000), (6, "\x001 \x00")])
    got = sorted(str(tuple(r)) for r in tc.count_tokens(docs, VOCABULARY, P.PATTERN, frequent=frequent).collect())
    assert got == sorted(str((r.doc_id, *plain(r.text))) for r in docs.collect())


def test_each_piece_once_and_empty_table(spark):
    docs = odd_docs(spark, [(1, "one two two"), (2, "two")])
    rows = {r.piece: (r.n, r.tokens) for r in tc.piece_counts(docs, VOCABULARY, P.PATTERN).collect()}
    assert rows == {"one": (1, 1), " two": (2, 1), "two": (1, 1)}
    assert tc.count_tokens(docs.where("false"), VOCABULARY, P.PATTERN).collect() == []
