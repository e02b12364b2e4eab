"""Structured Streaming forms: event windows, apply-once, running balances, and the account state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ledger import balances, settled_stream
from quire.plans.dialect import view


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream; its clock times count as UTC, so that watermarks apply."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source streams folders: the table's folder, with its name as the filter.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    return source.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def applied_once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def collected(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, writes its result under path, batch by batch, and returns that table. In complete mode the last batch
    is the whole result; a batch that runs again replaces itself."""
    schema = stream.schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


__all__ = ["applied_once", "balances", "collected", "events", "sessions", "settled_stream", "tumbling", "view"]
