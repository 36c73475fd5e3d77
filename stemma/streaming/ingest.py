"""Incremental import: new GEDCOM files in a landing folder are appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemma.plans.imports import STREAM_BATCHES, import_records
from stemma.sources.gedcom import number_records, scan_files


def ingest_new_files(
    spark: SparkSession, landing: str, folder: str, checkpoint: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Import every file not imported yet, then stop.

    The file source remembers which files it has read, by default in a
    checkpoint below ``folder``, so that each target has its own. A micro-batch
    is imported under its number, apart from the numbers of single imports, so
    one that failed half-way is replaced when it runs again. Malformed lines
    and refused rows are not fatal; they are stored beside the tables.
    """

    def load(batch: DataFrame, number: int) -> None:
        import_records(number_records(batch), folder, STREAM_BATCHES + number, fail_fast=False)

    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return (
        scan_files(reader, landing)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint or f"{folder}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
