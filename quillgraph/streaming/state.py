"""Streams with keyed state: the last turns of each conversation, and feedback by rank, as rows arrive.

Rows may come late, repeated, or again after a restart. State lies in the state store of the query's checkpoint, so a query
that goes on from it goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgraph.operators import evaluate

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURNS = "conv_id long, turns array<struct<turn: int, role: string, text: string>>, n_seen long, n_repeated long, n_late long"


class _LastTurns(StatefulProcessor):
    """Of each conversation the ``most`` turns of highest number; a map by turn is all that is kept, with three counts.

    A turn that is among the kept ones comes again (its first row stays); one below them is late and isn't taken in.
    After ``idle_ms`` without a row of it a conversation's turns leave the state; null: never.
    """

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn int", "role string, text string", self.idle_ms)
        self.counts = handle.getValueState("counts", "seen long, repeated long, late long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: tuple(v) for k, v in self.turns.iterator()} if self.turns.exists() else {}
        before = dict(kept)
        seen, repeated, late = self.counts.get() if self.counts.exists() else (0, 0, 0)
        for frame in rows:
            for turn, role, text in zip(frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True):
                seen += 1
                if turn in kept:
                    repeated += 1
                elif len(kept) == self.most and turn < min(kept):
                    late += 1
                else:
                    kept[turn] = (role, text)
                    if len(kept) > self.most:
                        del kept[min(kept)]
        for turn in before.keys() - kept.keys():
            self.turns.removeKey((turn,))
        for turn in kept.keys() - before.keys():
            self.turns.updateValue((turn,), kept[turn])
        self.counts.update((seen, repeated, late))
        turns = [{"turn": t, "role": kept[t][0], "text": kept[t][1]} for t in sorted(kept)]
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "n_seen": [seen], "n_repeated": [repeated], "n_late": [late]})

    def close(self) -> None:
        pass


def last_turns(turns: DataFrame, most: int = 5, idle_ms: int | None = None) -> DataFrame:
    """conv_id, turns (by number), n_seen, n_repeated, n_late of every conversation that a batch touches; for update mode.

    turns: conv_id, turn, role, text, a stream. Rows without conv_id or turn are left out. n_late counts rows below the kept turns
    when they came, which may be repeats of turns that have left. Its state store is ``PROVIDER``, which ``run_to_table`` sets for its query.
    """
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(_LastTurns(most, idle_ms), TURNS, "Update", "None" if idle_ms is None else "ProcessingTime")


def feedback_by_rank(feedback: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Signals by rank and their accuracy, each event_id once; for complete mode. feedback: event_id, ts, result_rank, signal.

    An event that comes again within the watermark counts once; what is later than that is dropped, so state is bounded by it.
    """
    return evaluate.rank_accuracy(feedback.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Works off what is there: each batch is written below ``path`` under its number, so that one that runs again replaces itself.

    ``read_table`` gives the newest row of each key. Files per batch and their order are the stream's.
    """
    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)  # read when the query starts
    try:
        query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    query.awaitTermination()
    return query


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
    return newest.select("r.*").drop("batch")
