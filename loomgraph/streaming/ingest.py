"""Structured Streaming: statements that arrive in loads, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_statements(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (subject, predicate, object) once within the watermark, whatever chunk it comes from; loaded_at is the event time."""
    return stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["subject", "predicate", "object"])


def windowed(stream: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, value): counts and sums of events (ts, event_type, value) in tumbling windows."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def run_once(frame: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The rows of a stream after all that has arrived, one per `keys`; a rerun with the same folder goes on where it ended.

    Windows that the watermark has passed are written once and their state is freed; those still open are written with every batch they change in, and the
    last batch counts. Each batch replaces its own folder, so repeating one changes nothing.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/data/batch={epoch}")

    query = frame.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = frame.sparkSession.read.parquet(f"{folder}/data").drop("batch")
    others = [c for c in rows.columns if c not in keys and c != "epoch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("x")).select(*keys, "x.*")


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of an input folder as a stream of its files; times without a zone are read in the session's."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))
