"""Shards of near-equal size by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest first, each to the
least-loaded shard, taken from a heap. Which of two groups of equal size goes first changes no load,
so the schedule only needs to know how many groups there are of each size. That histogram reaches
the driver; what goes back is how many groups of each size every shard takes, and executors rank the
groups of a size to tell which. Every group is scheduled, at any size of the table. There can be no
more different sizes than sqrt(2 * all bytes): 14 million at 100 TB, far fewer in practice.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Scratch, columns_of, join_hot
from quillframe.llm.ranking import running_sum


def longest_first(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """[(size, groups)] in any order -> [(size, groups that each shard takes)], largest size first.

    The loads are those of one step of the heap for each group. More groups of a size than there are
    shards are dealt at once up to a level: all that the heap would give to shards with loads below it.
    """
    heap = [(0, s) for s in range(shards)]
    dealt = []
    for size, left in sorted(histogram, reverse=True):
        took = [0] * shards
        if left > shards:
            level = _level([load for load, _ in heap], size, left)
            for load, s in heap:
                took[s] = max(0, -((load - level) // size))
            heap = [(load + took[s] * size, s) for load, s in heap]
            heapq.heapify(heap)
            left -= sum(took)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            took[s] += 1
        dealt.append((size, took))
    return dealt


def _level(loads: list[int], size: int, groups: int) -> int:
    """The highest level at which shards that take a group while their load is below it take no more than there are."""
    low, high = min(loads), min(loads) + size * groups + 1
    while high - low > 1:
        middle = (low + high) // 2
        if sum(max(0, -((load - middle) // size)) for load in loads) <= groups:
            low = middle
        else:
            high = middle
    return low


def shard_documents(df: DataFrame, scratch: Scratch, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot.

    slot numbers a shard's rows from 0 without gaps, by doc_id. A null text has size 1 and
    checksum 0; null texts form one group, apart from empty texts. Repeated rows each get a slot.
    A null doc_id sorts first. Of groups of equal size the order is that of their texts' hashes. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = scratch.keep(
        columns_of(df, doc_id=id_col, text=text_col).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("text_key"),
        )
    )
    groups = scratch.keep(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("one")))
    found = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    plan = longest_first(list(zip(found["bytes"].to_pylist(), found["n"].to_pylist(), strict=True)), shards)
    ends = [[sum(took[: s + 1]) for s in range(shards)] for _, took in plan]
    bounds = pa.table({"of": pa.array([size for size, _ in plan], pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})
    ranked = running_sum(groups, scratch, ["bytes"], ["text_key"], "one", "rank")
    placed = ranked.join(spark.createDataFrame(bounds), F.col("bytes") == F.col("of"))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    placed = scratch.keep(placed.select(F.col("text_key").alias("key"), "n", shard.alias("shard")))
    dealt = join_hot(rows, placed, {"text_key": "key"}, "n", rows.count()).select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("one"))
    kept = scratch.keep(dealt)
    scratch.drop(rows, groups, placed)
    return running_sum(kept, scratch, ["shard"], ["doc_id", "text_crc32", "size"], "one", "slot").drop("one")
