"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node of ``edges`` (``a``, ``b`` of one orderable type).

    Each step makes every node point at a smaller one of its component; the edges that come of it are written to the
    shared folder. Edges that don't change in a round are stars. It takes a number of rounds of the order of the square of
    the logarithm of the number of edges, which is the bound by default; beyond ``rounds`` it fails.
    """
    pairs = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds or 10 + pairs.count().bit_length() ** 2):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last = pairs
        pairs = save(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(last)
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (state["n"], state["h"]):
            break
        mark = (state["n"], state["h"])
    else:
        raise RuntimeError("components need more rounds")
    labels = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
