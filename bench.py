"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.functions.sketch import bloom_may_contain
from tidelog.model import Options
from tidelog.operators.cache import BlockCache
from tidelog.plans import catalogue
from tidelog.sources.binary import SortedTable, encode_table
from tidelog.table import KVTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = ["kv_scan_range", "kv_scan_unbounded", "kv_multi_get", "kv_flush_runs", "kv_merge_keep_tombstones", "kv_compact_bottommost", "kv_write_amp", "kv_latency_percentiles", "kv_ordered_iteration", "kv_murmur128"]


def session() -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": CPUS, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.adaptive.enabled": "true", "spark.sql.parquet.enableVectorizedReader": "true",
    }
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(f, repeat: int = 3) -> float:
    best = float("inf")
    for _ in range(repeat):
        began = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def checked(spark: SparkSession, name: str) -> None:
    """Whether the query gives as many rows as its SQL: a fast wrong answer is no result."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    if name in catalogue.ORACLE_SQL:
        want, got = con.sql(f"SELECT count(*) FROM ({catalogue.ORACLE_SQL[name]})").fetchall()[0][0], catalogue.QUERIES[name](spark, SF_DIR).count()
        if got != want:
            raise SystemExit(f"{name}: {got} rows of {want}")


def filter_figures(spark: SparkSession) -> dict[str, float]:
    """Share of block reads that filters avoid, and false positives, over absent keys of sorted tables of all keys; hit rate of a cache under a hot tenth."""
    keys = [r["key"].encode() for r in catalogue.ops(spark, SF_DIR).select("key").distinct().orderBy("key").collect()]
    table = SortedTable(encode_table((k, b"", False) for k in keys))
    absent = [k + b"-absent" for k in keys]
    passed = int(bloom_may_contain(table.filter, absent).sum())
    cache, rng = BlockCache(16 << 20), random.Random(1)
    blocks = 200_000 * 122 // 4096  # 96-byte values, 13-byte keys
    for _ in range(500_000):
        at = (0, rng.randrange(max(1, blocks // 100)) if rng.random() < 0.9 else rng.randrange(blocks))
        if not cache.lookup(at):
            cache.insert(at, 4096)
    return {"block_reads_avoided": round(1 - passed / len(absent), 5), "bloom_false_positives": round(passed / len(absent), 5), "cache_hit_rate": round(cache.hit_rate(), 4)}


def main() -> None:
    spark = session()
    queries = {name: timed(lambda n=name: consume(catalogue.QUERIES[n](spark, SF_DIR))) for name in QUERIES}
    for name in QUERIES:
        checked(spark, name)
    root = tempfile.mkdtemp(prefix="tidelog-bench-")
    try:
        ops = catalogue.ops(spark, SF_DIR)
        rows = ops.count()
        t = KVTable.open(spark, f"{root}/t", Options())
        parts = 5

        def load() -> None:
            for k in range(parts):
                t.put(ops.where(F.col("seq") % parts == k).select("key", "value", "tomb", "seq"), order=F.col("seq"))
                t.flush()

        queries["table_load"] = timed(load, 1)
        queries["table_compact"] = timed(t.compact, 1)
        queries["table_scan"] = timed(lambda: consume(t.scan()))
        probe = ops.select("key").distinct().unionByName(spark.range(50_000).select(F.format_string("absent/%08d", "id").alias("key")))
        keys = probe.count()
        queries["table_multi_get"] = timed(lambda: consume(t.multi_get(probe)))
        # Rows come in five batches, the later one of a key wins.
        live = f"WITH {catalogue._OPS} SELECT key FROM (SELECT key, arg_max(tomb, (seq % {parts}) * 1000000000000 + seq) AS tomb FROM ops GROUP BY key) WHERE NOT tomb"
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
        if t.scan().count() != con.sql(f"SELECT count(*) FROM ({live})").fetchall()[0][0]:
            raise SystemExit("the table lost rows")
        amplification = t.stats().first()["write_amplification"]
    finally:
        shutil.rmtree(root, ignore_errors=True)
    figures = filter_figures(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": SF_DIR.rpartition("/sf")[2],
                "rows_merged_per_s": round(rows / queries["kv_ordered_iteration"]), "rows_loaded_per_s": round(rows / queries["table_load"]), "keys_looked_up_per_s": round(keys / queries["table_multi_get"]), "write_amplification": round(amplification, 3), **figures,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
