"""A model of a least-recently-used block cache over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..storage import save

#: Accesses that one task runs through in order.
RANGE_ROWS = 50_000


class BlockCache:
    """Exact byte budget: a block that is there moves to the front; the oldest go until the budget holds, but for the newest block."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.hits, self.misses = capacity, 0, 0, 0
        self.blocks: OrderedDict[tuple, int] = OrderedDict()

    def lookup(self, key: tuple) -> bool:
        if key in self.blocks:
            self.blocks.move_to_end(key)
            self.hits += 1
            return True
        self.misses += 1
        return False

    def insert(self, key: tuple, size: int) -> None:
        if not self.capacity:
            return
        known = key in self.blocks
        self.used += size - self.blocks.pop(key, 0)
        self.blocks[key] = size
        while not known and self.used > self.capacity and len(self.blocks) > 1:
            self.used -= self.blocks.popitem(last=False)[1]

    def __len__(self) -> int:
        return len(self.blocks)

    def reset_counters(self) -> None:
        self.hits = self.misses = 0

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def simulate(trace: DataFrame, capacity: int) -> DataFrame:
    """``trace`` (``cache_id``, ``seq``, ``file``, ``offset``, ``bytes``) with ``hit``; each cache's trace is one ordered group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cache, hits = BlockCache(capacity), []
        rows = rows.sort_values("seq")
        for file, offset, size in zip(rows.file, rows.offset, rows.bytes):
            hits.append(cache.lookup((file, offset)))
            if not hits[-1]:
                cache.insert((file, offset), size)
        return rows.assign(hit=hits)

    return trace.groupBy("cache_id").applyInPandas(run, "cache_id bigint, seq bigint, file bigint, offset bigint, bytes bigint, hit boolean")


def equal_blocks(trace: DataFrame, capacity_blocks: int) -> DataFrame:
    """``trace`` (``seq``, ``block``) with ``hit`` for blocks of one size: fewer than so many other blocks since the last access.

    What the cache holds at any place is the blocks used last. Each range of the trace gives its own last used blocks, at
    most as many as fit; these lists, handed on in order, are what each range begins with, and a range is then run on its own.
    """
    size = max(RANGE_ROWS, 8 * capacity_blocks)  # so the lists are at most about an eighth of the trace
    ranges = max(1, -(-trace.count() // size))
    ranged = save(trace.repartitionByRange(ranges, "seq").withColumn("_range", F.spark_partition_id()), "trace")
    newest = Window.partitionBy("_range").orderBy(F.desc("_last"))
    lists = ranged.groupBy("_range", "block").agg(F.max("seq").alias("_last")).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= capacity_blocks).drop("_n")

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = OrderedDict(), None
        for batch in batches:
            for number, part in batch.groupby("_range"):
                if at is not None and number != at:
                    yield pd.DataFrame({"_range": number, "block": list(held), "_last": list(held.values())}).astype(batch.dtypes)
                at = number
                for block, last in zip(part.block, part._last):
                    held.pop(block, None)
                    held[block] = last
                while len(held) > capacity_blocks:
                    held.popitem(last=False)

    def run(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        cache, hits = BlockCache(capacity_blocks), []
        for block in start.sort_values("_last").block:
            cache.insert((block,), 1)
        rows = rows.sort_values("seq")
        for block in rows.block:
            hits.append(cache.lookup((block,)))
            if not hits[-1]:
                cache.insert((block,), 1)
        return rows.drop(columns="_range").assign(hit=hits)

    # Ranges times capacity rows, in one task.
    starts = lists.repartition(1).sortWithinPartitions("_range", "_last").mapInPandas(begin, lists.schema)
    schema = StructType([*trace.schema.fields, StructField("hit", BooleanType())])
    return ranged.groupBy("_range").cogroup(starts.groupBy("_range")).applyInPandas(run, schema)
