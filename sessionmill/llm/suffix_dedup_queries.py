from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.registry import query, table
from sessionmill.llm.suffix_dedup import repeat_digests


@query()
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
