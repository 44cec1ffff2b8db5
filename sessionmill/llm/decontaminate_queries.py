from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm.decontaminate import contaminated
from sessionmill.llm.registry import query, table


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.array_max(F.transform("tiles", lambda t: t["words"]))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"), longest.alias("longest_tile"))
