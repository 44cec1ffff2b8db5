from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm.quality import judge, train
from sessionmill.llm.registry import query, table


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
