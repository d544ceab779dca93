"""Minimax contiguous partition of documents into shards.

Groups of equal texts are atomic. They are ordered by the hash of their text, and the smallest capacity is
searched for which a greedy walk fills at most the given number of shards; the cuts of that walk are the shards.
A group as large as an even share stands first in the order, in a shard of its own, so that the others stay even.

The walk never sees single groups: it reads a histogram over ranges of the hash, of a bounded number of bins. A bin
of several groups counts once as indivisible (an upper bound of the capacity) and once as divisible (a lower bound);
only bins in which a cut may fall are split finer, until both bounds meet. What the driver holds is bounded by
``MAX_BINS``, whatever the input.

Defined cases: a null text counts as an empty one (size 16, with the default overhead); a null doc_id is kept, first in
its group; repeated rows are rows of the same group; a text of any length is one unit of its group; fewer groups than shards leave shards empty; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, table, whole_text

#: Most bins that one histogram has on the driver.
MAX_BINS = 1 << 16
#: Bits of the hash that the first histogram splits by.
FIRST_BITS = 14


@dataclass(frozen=True)
class Bin:
    low: int
    high: int
    size: int
    shift: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def _walk(bins: list[Bin], capacity: int, divisible: bool) -> tuple[int, list[int]]:
    """Greedy filling: the number of shards (a huge number if impossible), and the bin in which each shard ends."""
    shards, room, ends = 1, capacity, []
    for k, b in enumerate(bins):
        left = b.size
        if divisible and not b.single:
            while left > room:
                left -= room
                shards, room = shards + 1, capacity
                ends.append(k)
        elif left > room:
            if left > capacity:
                return 1 << 60, ends + [k]
            shards, room = shards + 1, capacity
            ends.append(k)
        room -= left
    return shards, ends


def _smallest(bins: list[Bin], n: int, low: int, divisible: bool) -> int:
    """Binary search of the smallest capacity that n shards suffice for."""
    high = max(low, sum(b.size for b in bins), 1)
    low = max(low, 1)
    while low < high:
        mid = (low + high) // 2
        if _walk(bins, mid, divisible)[0] <= n:
            high = mid
        else:
            low = mid + 1
    return low


def _histogram(sized: DataFrame, shift: int, only: list[int] | None, only_shift: int) -> list[Bin]:
    if only is not None:
        sized = sized.where(F.shiftright("key", only_shift).isin(only))
    rows = (
        sized.groupBy(F.shiftright("key", shift).alias("bin"))
        .agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("size"))
        .collect()  # at most MAX_BINS rows
    )
    return [Bin(r["low"], r["high"], r["size"], shift) for r in rows]


def _boundaries(sized: DataFrame, n: int) -> list[int]:
    """The last hash of each shard but the final one, for the smallest capacity of n shards."""
    bins = sorted(_histogram(sized, 64 - FIRST_BITS, None, 0), key=lambda b: b.low)
    while True:
        largest = max((b.size for b in bins if b.single), default=0)
        least = _smallest(bins, n, largest, divisible=True)
        most = _smallest(bins, n, max(b.size for b in bins), divisible=False) if bins else 0
        if least >= most:
            break
        early, late = _walk(bins, least, divisible=False)[1], _walk(bins, most, divisible=True)[1]
        early, late = early[: n - 1], late[: n - 1]
        early += [len(bins) - 1 if not early else early[-1]] * (len(late) - len(early))
        late += [len(bins) - 1] * (len(early) - len(late))
        touched = {k for a, b in zip(early, late, strict=True) for k in range(min(a, b), max(a, b) + 1) if not bins[k].single}
        if not touched:
            break
        finer = max(1, int(math.log2(max(2, MAX_BINS // len(touched)))))
        split = []
        for shift in {bins[k].shift for k in touched}:
            only = sorted({bins[k].low >> shift for k in touched if bins[k].shift == shift})
            split += _histogram(sized, max(0, shift - finer), only, shift)
        keep = [b for k, b in enumerate(bins) if k not in touched]
        bins = sorted(keep + split, key=lambda b: b.low)
    _, ends = _walk(bins, most, divisible=False)
    return [bins[k - 1].high for k in ends]


def minimax_shards(docs: DataFrame, n_shards: int, overhead: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Returns doc_id, size, text_crc32, key (hash of the text), shard and slot (gapless from 0 within a shard)."""
    body = whole_text(text)
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
        ),
        "sized",
    )
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Groups as large as an even share of what is left: fewer than n_shards, each in a shard of its own.
    top = sized.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(n_shards).collect()
    large: list[int] = []
    left = total
    for r in top:
        if n_shards - len(large) <= 1 or r["size"] * (n_shards - len(large)) < left:
            break
        large.append(r["key"])
        left -= r["size"]
    rest = sized.where(~F.col("key").isin(large)) if large else sized
    cuts = _boundaries(rest, n_shards - len(large)) if left else []
    shard = F.lit(len(large))
    for cut in cuts:
        shard = shard + (F.col("key") > F.lit(cut)).cast("int")
    for k, key in enumerate(large):
        shard = F.when(F.col("key") == F.lit(key), F.lit(k)).otherwise(shard)
    # Slots: rows are dealt by ranges that split even one group's copies; a shard's rows are numbered across ranges.
    dealt = materialise(
        sized.withColumn("shard", shard.cast("int"))
        .repartitionByRange("shard", "key", "doc_id")
        .sortWithinPartitions("shard", "key", "doc_id")
        .withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id()}),
        "dealt",
    )
    runs = dealt.groupBy("part", "shard").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    # One row per range and shard within it: as many as ranges and shards together.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(runs, ["part", "shard"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("idx") + F.col("shift")).cast("long").alias("slot"))


def op6_minimax_shards(spark, sf_dir: str) -> DataFrame:
    shards = minimax_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
