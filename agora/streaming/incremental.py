"""Incremental operators as Structured Streaming: file source, watermark, idempotent sinks.

A run with ``availableNow`` reads what has landed since the last run and stops; the checkpoint is the resume point.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def bucketed(events: DataFrame, at: str, keys: list[str], width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window, final once the watermark has passed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(*keys, F.window(at, width)).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("window.start").alias("bucket"), "n")


def once(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_new(keys: list[str], path: str):
    """For ``foreachBatch``: appends rows whose key the table at ``path`` lacks, so a replayed batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        try:
            known = spark.read.schema(batch.schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            rows = rows.join(known.select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return write


def run_now(stream: DataFrame, checkpoint: str, **sink) -> None:
    """Runs to the end of what is there.  ``sink``: path (append) or each (a foreachBatch function)."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if "each" in sink:
        writer.foreachBatch(sink["each"]).start().awaitTermination()
    else:
        writer.outputMode("append").format("parquet").start(sink["path"]).awaitTermination()
