"""Newest-wins merging, scans and batch lookups over DataFrames with ``op_schema``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETED, FOUND, NOT_FOUND


def union(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def newest_wins(ops: DataFrame, keep_tombstones: bool = True) -> DataFrame:
    """One row per key, that with the largest ``seq``.

    Each column is its own ``max_by``, so that a query for keys alone never reads values. Tombstones are dropped only
    after the winner is known: before, an older value would come back.
    """
    out = ops.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.max_by("tomb", "seq").alias("tomb"))
    return out if keep_tombstones else out.where(~F.col("tomb"))


def layered(layers: list[DataFrame]) -> DataFrame:
    """One row per key from the first layer that holds it; a layer has at most one row per key."""
    ranked = union([x.withColumn("_layer", F.lit(i)) for i, x in enumerate(layers)])
    return ranked.groupBy("key").agg(F.min_by("seq", "_layer").alias("seq"), F.min_by("value", "_layer").alias("value"), F.min_by("tomb", "_layer").alias("tomb"))


def in_range(ops: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in ``[start, end)``; a null or empty bound is open."""
    if start not in (None, "", b""):
        ops = ops.where(F.col("key") >= F.lit(start))
    if end not in (None, "", b""):
        ops = ops.where(F.col("key") < F.lit(end))
    return ops


def prefix_end(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None if there is none."""
    chars = list(prefix)
    while chars:
        last = ord(chars.pop())
        if last < 0x10FFFF:
            return "".join(chars) + chr(0xE000 if last + 1 == 0xD800 else last + 1)
    return None


def scan(ops: DataFrame, start=None, end=None, ordered: bool = True, limit: int | None = None) -> DataFrame:
    """Live ``key`` and ``value`` in ``[start, end)``, ascending."""
    out = newest_wins(in_range(ops, start, end), keep_tombstones=False).select("key", "value")
    out = out.orderBy("key") if ordered or limit is not None else out
    return out if limit is None else out.limit(limit)


def multi_get(ops: DataFrame, probe: DataFrame) -> DataFrame:
    """``key``, ``status`` and ``value`` for every row of ``probe``; repeated keys are answered each time."""
    asked = probe.select("key")
    state = newest_wins(ops.join(asked.distinct(), "key", "left_semi"))
    status = F.when(F.col("tomb").isNull(), NOT_FOUND).when(F.col("tomb"), DELETED).otherwise(FOUND)
    joined = asked.join(state, "key", "left").withColumn("status", status)
    return joined.select("key", "status", F.when(F.col("status") == FOUND, F.col("value")).alias("value"))


def get(ops: DataFrame, key) -> tuple[str, object]:
    rows = newest_wins(ops.where(F.col("key") == F.lit(key))).select("tomb", "value").collect()  # one row at most
    if not rows:
        return NOT_FOUND, None
    return (DELETED, None) if rows[0]["tomb"] else (FOUND, rows[0]["value"])
