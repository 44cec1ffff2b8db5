from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.bpe import read_ranks, token_digests
from sessionmill.llm.registry import query, table


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
