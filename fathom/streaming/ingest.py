"""Continuous ingestion: new files of a folder become rows of a catalog.

Spark's file source remembers which files it has read and meets each once; the lake's own
source meets a file again when it changes.  Each micro-batch appends its own rows under
its number, so a batch that is run again after a failure overwrites its own rows only, and
costs what it brings; a snapshot is the last row of each file.  :func:`compact` folds
batches into one now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.functions.scalars import extension, filename
from fathom.sources import lake
from fathom.sources.files import relative_to

FILE = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """New files below ``root`` as they come; their contents are not read, so they are
    discovered, not yet indexed."""
    read = spark.readStream.format("binaryFile").schema(FILE)
    found = read.option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    return found.select(
        relative_to(root).alias("relative_path"),
        filename("path").alias("filename"),
        extension("path").alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        F.lit("discovered").alias("status"),
        F.lit(True).alias("is_present"),
    )


def changes_stream(spark: SparkSession, root: str, lag: float = lake.LAG) -> DataFrame:
    """The same rows for new files and, each time they change, for files met before; empty
    files too (see :mod:`fathom.sources.lake`)."""
    return lake.changes(spark, root, lag=lag).select("*", F.lit("discovered").alias("status"), F.lit(True).alias("is_present"))


def _batches(spark: SparkSession, folder: str, last: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/batches").filter(F.col("batch") <= last)


def snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The catalog after a batch: of each file its last row, and ``first_batch``, in
    which it was first met.  One partial aggregation; nothing is sorted."""
    rows = _batches(spark, folder, version)
    others = [c for c in rows.columns if c not in ("relative_path", "batch", "first_batch")]
    last = F.max_by(F.struct(*others), "batch").alias("last")
    found = rows.groupBy("relative_path").agg(last, F.min("first_batch").alias("first_batch"))
    return found.select("relative_path", *(F.col(f"last.{c}").alias(c) for c in others), "first_batch")


def compact(spark: SparkSession, folder: str, version: int, into: str) -> None:
    """The snapshot after a batch as the only batch of another folder."""
    whole = snapshot(spark, folder, version).withColumn("batch", F.lit(version))
    whole.write.mode("overwrite").partitionBy("batch").parquet(f"{into}/batches")


def run(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to the catalog; stops when all files so far are in."""

    def append(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["relative_path"]).withColumn("first_batch", F.lit(number))
        new.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    writer = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per type and tumbling window of a stream (or table) of events;
    rows later than the watermark are left out of a stream's result."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
