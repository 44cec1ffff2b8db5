from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.exact_dedup import copy_groups
from sessionmill.llm.registry import query, table


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))
