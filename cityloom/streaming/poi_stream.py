"""Incremental POI ingest and running counts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD = "event_id bigint, ts timestamp, event_type string, value double, cell_id int, capped boolean"


def read_records(spark: SparkSession, path: str, schema: str = RECORD, files_per_batch: int = 200) -> DataFrame:
    """Append-only JSON records; the file source log plays the part of the done list."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def _run(records: DataFrame, each, checkpoint: str) -> None:
    """Process what is there in micro-batches, then stop. A rerun continues from the checkpoint."""
    q = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def new_rows(batch: DataFrame, key: str, target: str, number: int) -> DataFrame:
    """Rows of a micro-batch whose key no earlier batch has stored, each key once."""
    once = batch.dropDuplicates([key])
    if number == 0:
        return once
    earlier = batch.sparkSession.read.parquet(target).where(F.col("batch") < number)
    return once.join(earlier.select(key), key, "left_anti")


def ingest(records: DataFrame, key: str, target: str, checkpoint: str, counts: str | None = None, kind: Column | None = None) -> None:
    """Append records with a new key to the Parquet table ``target``, a partition ``batch`` per micro-batch.

    The table itself is the memory of keys, so the stream keeps no state. A micro-batch overwrites only its own partition and
    ignores it when it looks for keys, so one that is repeated after a failure leaves the same rows. With ``counts``, counts
    of the new rows per day and ``kind`` are stored the same way.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = new_rows(batch, key, target, number)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if counts is not None:
            stored = batch.sparkSession.read.schema(new.schema).parquet(f"{target}/batch={number}")
            kind_counts(stored, kind).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    _run(records, each, checkpoint)


def totals(spark: SparkSession, counts: str) -> DataFrame:
    """``window_start, kind, n`` over the counts of all micro-batches."""
    return spark.read.parquet(counts).groupBy("window_start", "kind").agg(F.sum("n").alias("n"))


def kind_counts(records: DataFrame, kind: Column, window: str = "1 day") -> DataFrame:
    """Counts per tumbling window of ingest time and kind."""
    return records.groupBy(F.window("ts", window).alias("w"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "kind", "n"
    )
