from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.chat_format import repair_roles
from sessionmill.llm.registry import query, table


@query()
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))
