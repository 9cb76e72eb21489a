"""Turns from a stream into chunks on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import chunking
from turnlake.schemas import ChunkerConfig


def read_turns(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """A stream of the Parquet files at path, so many at a time."""
    # a pattern with one match: the source takes patterns for files and folders, but plain paths for folders alone
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def deduplicated(turns: DataFrame, delay: str | None = None, time: str = "created_at") -> DataFrame:
    """Each (conv_id, turn) once. With a delay, state is kept for that long only; else for ever."""
    key = ["conv_id", "turn"]
    return turns.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if delay else turns.dropDuplicates(key)


def chunk_stream(turns: DataFrame, out: str, checkpoint: str, config: ChunkerConfig = ChunkerConfig(), trigger: dict | None = None):
    """Starts the query that chunks turns. A batch has its own folder and replaces it when it is run again, so each row lands once."""

    def land(batch: DataFrame, number: int) -> None:
        chunking.chunk(batch, config).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    return turns.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and users by window and type; on a stream, rows later than late are dropped."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return found.agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n_events", "value")
