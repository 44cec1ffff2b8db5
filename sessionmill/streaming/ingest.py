"""Continuous ingest: every micro-batch of trigger or listing files runs one sweep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmill.operators.ordering import latest_per_key
from sessionmill.plans.upload import UploadRun, run_upload

LISTING = "source_kind string, path string, size_bytes bigint, mtime_ms double"


def ingest_listings(
    spark: SparkSession,
    listings: str,
    checkpoint: str,
    run: UploadRun,
    read_records: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Upload what the listing files of each micro-batch name.

    A growing log appears in a new listing under the same path and is told from the ledger. The
    run id is made of the batch id, so a batch that is tried again writes over its own output.
    """

    def sweep(listing: DataFrame, batch_id: int) -> None:
        if listing.isEmpty():
            return
        one = replace(run, run_id=f"{run.run_id}-{batch_id}")
        # A file listed twice in one batch counts as it was last seen.
        newest = latest_per_key(listing, ["source_kind", "path"], F.struct("mtime_ms", "size_bytes"))
        run_upload(newest, read_records, one)

    stream = spark.readStream.schema(LISTING).parquet(listings)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sweep)
        .start()
    )
