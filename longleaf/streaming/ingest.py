"""Incremental ingest: new documents become chunks in an index folder, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from longleaf.operators import chunking


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id string, text string", files: int = 1000, keep: str = "30 days") -> StreamingQuery:
    """Chunk the documents that arrive as Parquet in a folder.

    The ids of the documents of the last while (keep, by the times of their files) are the stream's state, so each is worked on once in it, with or
    without chunks, and no batch reads what others wrote.  A batch writes to a folder of its
    number, so a batch that is run again after a failure replaces its own output.
    """

    def land(batch: DataFrame, number: int) -> None:
        chunking.chunk_markdown(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    fields = stream.columns
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_seen")).withWatermark("_seen", keep).dropDuplicatesWithinWatermark(["doc_id"]).select(fields)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(chunking.SCHEMA + ", batch int").parquet(target)


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their value by type in windows, for a stream or a table; in a stream rows later than the watermark go."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their span by user in sessions that a gap ends, for a stream or a table; in a stream rows later than the watermark go."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
