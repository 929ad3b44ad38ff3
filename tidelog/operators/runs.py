"""Flush runs, run statistics, sparse indexes and level accounting, relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import RECORD_HEADER, Options
from .merge import newest_wins
from .ordered import running_sum


def key_value_bytes() -> Column:
    return F.octet_length("key") + F.octet_length("value")


def user_bytes() -> Column:
    """What a caller wrote: key and value of a put, the key of a deletion."""
    return F.octet_length("key") + F.when(F.col("tomb"), 0).otherwise(F.octet_length("value"))


def flush_runs(ops: DataFrame, threshold: int) -> DataFrame:
    """``ops`` with ``run_id``: a run ends where so many bytes have come since the first operation."""
    summed = running_sum(ops, "seq", key_value_bytes().cast("bigint"), "_bytes")
    return summed.withColumn("run_id", F.floor((F.col("_bytes") - key_value_bytes()) / threshold).cast("bigint")).drop("_bytes")


def run_rows(runs: DataFrame) -> DataFrame:
    """One row per key in each run, its newest."""
    return runs.groupBy("run_id", "key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.max_by("tomb", "seq").alias("tomb"))


def run_stats(rows: DataFrame) -> DataFrame:
    """Entries, tombstones, key range and record bytes of each run; ``rows`` from ``run_rows``."""
    size = (key_value_bytes() + RECORD_HEADER).cast("bigint")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.col("tomb").cast("bigint")).alias("tombstones"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.sum(size).alias("bytes")
    )


def compact(rows: DataFrame, bottommost: bool) -> DataFrame:
    """The merge of runs; tombstones go only where no older data can lie below."""
    return newest_wins(rows, keep_tombstones=not bottommost)


def overlaps(left: DataFrame, right: DataFrame) -> Column:
    return (left["largest"] >= right["smallest"]) & (left["smallest"] <= right["largest"])


def overlapping(files: DataFrame) -> DataFrame:
    """Pairs of files (``a`` < ``b``) with a common key range. Metadata only: a row per file."""
    a, b = (files.select(F.col("run_id").alias(x), F.col("smallest").alias(f"s{x}"), F.col("largest").alias(f"l{x}")) for x in "ab")
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("la") >= F.col("sb")) & (F.col("sa") <= F.col("lb"))).select("a", "b")


def blocks(rows: DataFrame, block_size: int) -> DataFrame:
    """The first key of each data block of each run: its sparse index."""
    within = Window.partitionBy("run_id").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    size = key_value_bytes() + RECORD_HEADER
    placed = rows.withColumn("_end", F.sum(size).over(within)).withColumn("block", F.floor((F.col("_end") - size) / block_size).cast("bigint"))
    return placed.groupBy("run_id", "block").agg(F.min("key").alias("first_key"))


def block_of(probe: DataFrame, index: DataFrame) -> DataFrame:
    """For each probe (``run_id``, ``key``) the block of its run that may hold the key, the last that begins at or before it.

    A probe names its run: ``in_files`` and ``overlapping`` tell which runs a key's range meets.
    """
    both = index.select("run_id", F.col("first_key").alias("key"), "block", F.lit(0).alias("kind")).unionByName(
        probe.select("run_id", "key", F.lit(None).cast("bigint").alias("block"), F.lit(1).alias("kind"))
    )  # a run is of bounded size
    upto = Window.partitionBy("run_id").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block", F.last("block", ignorenulls=True).over(upto)).where("kind = 1 and block is not null").select("run_id", "key", "block")


def write_amplification(user: Column, flushed: Column, compacted: Column) -> Column:
    return F.when(user == 0, 0.0).otherwise((flushed + compacted) / user)


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def over_budget(levels: DataFrame, options: Options) -> DataFrame:
    """``level_stats`` rows with ``needs_compaction``."""
    budget = F.lit(options.l1_target_bytes) * F.pow(F.lit(float(options.level_size_multiplier)), F.col("level") - 1)
    last = F.col("level") >= options.max_levels - 1
    needs = F.when(F.col("level") == 0, F.col("files") >= options.l0_compaction_trigger).when(last, F.lit(False)).otherwise(F.col("bytes") > budget)
    return levels.withColumn("needs_compaction", needs)


def pick_inputs(files: DataFrame) -> DataFrame:
    """What a merge of level 0 into level 1 reads: all of level 0, and of level 1 what overlaps its key span."""
    span = files.where("level = 0").agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    below = files.where("level = 1").join(span, (F.col("largest") >= F.col("lo")) & (F.col("smallest") <= F.col("hi"))).select(*files.columns)
    return files.where("level = 0").unionByName(below)


def in_files(files: DataFrame, start: str, end: str) -> DataFrame:
    """Files that may hold keys of ``[start, end)``."""
    return files.where((F.col("largest") >= start) & (F.col("smallest") < end))


def intact_prefix(frames: DataFrame) -> DataFrame:
    """Rows of a log before its first frame with ``intact`` false."""
    first_bad = frames.where(~F.col("intact")).agg(F.min("seq").alias("bad"))
    return frames.join(F.broadcast(first_bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def contiguous_prefix(ops: DataFrame) -> DataFrame:
    """Operations up to the first gap in ``seq``, counted from its least. ``seq`` is unique."""
    there = ops.select("seq")
    # What follows a gap has none before it; of the least that is no gap. The join is by equality, so no range is cut.
    begins = there.join(there.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti")
    first = begins.orderBy("seq").limit(2).agg(F.when(F.count("seq") > 1, F.max("seq")).alias("gap"))  # the least of all, and the first gap's
    return ops.join(F.broadcast(first), F.col("gap").isNull() | (F.col("seq") < F.col("gap"))).drop("gap")
