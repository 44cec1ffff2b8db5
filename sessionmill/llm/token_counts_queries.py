from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.registry import query, table
from sessionmill.llm.token_counts import count_tokens


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
