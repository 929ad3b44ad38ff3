"""Running sums and ranks over a global order, without bringing all rows to one task.

Rows are dealt into ranges of the order and written once with the range's number,
so that totals and rows are of the same ranges. Each range is summed on its own;
the ranges' totals, a row each, are added up and handed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save


def running_sum(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in ``order``, a column without ties."""
    # Dealt out twice, the ranges would be sampled and coalesced anew and the join below would lose rows.
    ranged = save(df.withColumn("_value", value).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_sum", F.sum("_value").over(inner))
    # As many rows as ranges: small whatever the table.
    return summed.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_sum")).drop("_value", "_range", "_base", "_sum")


def rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the row's number in ``order``, from 1."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name)


def percentiles(df: DataFrame, value: str, tie: str, quantiles: list[float]) -> DataFrame:
    """``q`` and ``value``: the entry at ``floor(q * n)`` of the sorted values, the last one at most. Not interpolated."""
    n = df.count()
    ranked = rank(df.select(F.struct(value, tie).alias("_o")), "_o")
    picks = [(q, min(int(q * n), n - 1) + 1) for q in quantiles] if n else []
    wanted = df.sparkSession.createDataFrame(picks, "q double, rank bigint")
    return ranked.join(F.broadcast(wanted), "rank").select("q", F.col(f"_o.{value}").alias("value"))
