"""Streaming ingest of events into a table, a micro-batch at a time. An extension, not a capability of the reference."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.store import shared_dir


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there, into a Parquet table, and returns the table.

    In update mode each batch writes the windows it changed, under its own number, so a batch that is run again replaces its rows; of a
    window the row of the latest batch counts. State older than the watermark is dropped.
    """
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/epoch={epoch}")

    query = windowed_counts(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = spark.read.parquet(f"{run}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return latest.select("start", "event_type", "x.n", "x.total")
