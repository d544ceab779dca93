"""Streams over growing folders of Parquet files: feedback by rank, windowed counts, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators import evaluate, mutate


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """New files of a folder (or files of a pattern), a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rank_counts(feedback: DataFrame) -> DataFrame:
    """Positive and negative signals by rank; needs the complete output mode, its state is one row a rank."""
    return evaluate.rank_accuracy(feedback)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped, and closed windows leave the state."""
    window = F.window("ts", width)["start"].alias("start")
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user's sessions."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there into a table in memory of this name; the caller reads the table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(stream: DataFrame, stored: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Files of each batch whose content isn't stored yet go to ``save``; a batch that is run again saves nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        save(mutate.new_files(rows, stored()), number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def periodic(spark: SparkSession, action: Callable[[], None], checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """Runs an upkeep action at an interval, on a clock stream; ``stop()`` ends it. A run that fails ends the query."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda rows, number: action()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
