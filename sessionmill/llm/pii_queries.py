from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.pii import find_pii
from sessionmill.llm.registry import query, table


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
