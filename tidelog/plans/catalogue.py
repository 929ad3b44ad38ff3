"""The registered queries over the driver's tables, and their SQL.

The operation log of most is made from ``events``: ``seq`` is the event id, a key
is a user and one of 16 slots, and an ``error`` event deletes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketch
from ..model import Options
from ..operators import cache, merge, ordered, runs

RUN_BYTES = 16384
LEVELS = Options(l1_target_bytes=30000, level_size_multiplier=4)

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("/"), F.lpad((F.col("event_id") % 16).cast("string"), 2, "0"))
    tomb = F.col("event_type") == "error"
    return e.select(key.alias("key"), F.col("event_id").alias("seq"), F.when(tomb, "").otherwise(F.col("props")).alias("value"), tomb.alias("tomb"))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_rows(runs.flush_runs(ops(spark, sf_dir), RUN_BYTES))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a level by age, as they would stand after some merges: at sf0.01 runs from 7 on in level 0, 4 to 6 in 1, the rest in 2."""
    stats = runs.run_stats(run_rows(spark, sf_dir))
    return stats.withColumn("level", F.when(F.col("run_id") >= 7, 0).when(F.col("run_id") >= 4, 1).otherwise(2))


def kv_scan_range(spark, sf_dir):
    return merge.scan(ops(spark, sf_dir), "u000020", "u000050")


def kv_scan_unbounded(spark, sf_dir):
    return merge.scan(ops(spark, sf_dir), "u000140", "")


def kv_scan_prefix(spark, sf_dir):
    return merge.scan(ops(spark, sf_dir), "u00001", merge.prefix_end("u00001"))


def kv_scan_empty(spark, sf_dir):
    return merge.scan(ops(spark, sf_dir), "zzz", "zzz")


def kv_multi_get(spark, sf_dir):
    i = F.col("id")
    key = F.concat(F.lit("u"), F.lpad((i * 3).cast("string"), 6, "0"), F.lit("/"), F.lpad((i % 16).cast("string"), 2, "0"))
    return merge.multi_get(ops(spark, sf_dir), spark.range(150).select(key.alias("key")))


def kv_flush_runs(spark, sf_dir):
    return runs.run_stats(run_rows(spark, sf_dir))


def kv_merge_keep_tombstones(spark, sf_dir):
    return runs.compact(run_rows(spark, sf_dir).drop("run_id"), bottommost=False)


def kv_compact_bottommost(spark, sf_dir):
    return runs.compact(run_rows(spark, sf_dir).drop("run_id"), bottommost=True).select("key", "seq", "value")


def kv_scan_layered(spark, sf_dir):
    rows = run_rows(spark, sf_dir)
    # A run is a layer; the layer's age is its number, so the first to hold a key is the largest.
    newest = rows.groupBy("key").agg(F.max_by("seq", "run_id").alias("seq"), F.max_by("value", "run_id").alias("value"), F.max_by("tomb", "run_id").alias("tomb"))
    return newest.where(~F.col("tomb")).select("key", "seq", "value")


def kv_file_overlap(spark, sf_dir):
    return runs.overlapping(kv_flush_runs(spark, sf_dir))


def kv_sparse_index_lookup(spark, sf_dir):
    rows = run_rows(spark, sf_dir)
    return runs.block_of(rows.select("run_id", "key"), runs.blocks(rows, 4096))


def kv_wal_prefix(spark, sf_dir):
    frames = ops(spark, sf_dir).withColumn("intact", F.col("seq") % 997 != 996)
    return runs.intact_prefix(frames).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def kv_write_amp(spark, sf_dir):
    user = ops(spark, sf_dir).agg(F.sum(runs.user_bytes()).alias("user_bytes"))
    flushed = kv_flush_runs(spark, sf_dir).agg(F.sum("bytes").alias("flush_bytes"))
    return user.crossJoin(flushed).select("user_bytes", "flush_bytes", runs.write_amplification(F.col("user_bytes"), F.col("flush_bytes"), F.lit(0)).alias("write_amplification"))


def kv_lru_hits(spark, sf_dir):
    trace = events(spark, sf_dir).select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("block"))
    hits = cache.equal_blocks(trace, 20).agg(F.sum(F.col("hit").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return hits.select("hits", (F.col("n") - F.col("hits")).alias("misses"), (F.col("hits") / F.col("n")).alias("hit_rate"))


def kv_lru_bytes(spark, sf_dir):
    trace = events(spark, sf_dir).select((F.col("user_id") % 4).alias("cache_id"), F.col("event_id").alias("seq"), F.lit(1).cast("bigint").alias("file"), (F.col("user_id") % 97).alias("offset"), (F.col("user_id") % 7 + 90).alias("bytes"))
    return cache.simulate(trace, 2000).groupBy("cache_id").agg(F.sum(F.col("hit").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("accesses"))


def kv_latency_percentiles(spark, sf_dir):
    return ordered.percentiles(events(spark, sf_dir), "value", "event_id", [0.5, 0.99, 0.999])


def kv_delete_band(spark, sf_dir):
    base = ops(spark, sf_dir)
    top = base.agg(F.max("seq").alias("top"))
    band = base.where("key >= 'u000020' and key < 'u000030'").select("key").distinct().crossJoin(F.broadcast(top))  # one row
    gone = band.select("key", (F.col("top") + 1 + F.pmod(F.xxhash64("key"), F.lit(1 << 30))).alias("seq"), F.lit("").alias("value"), F.lit(True).alias("tomb"))
    return merge.newest_wins(base.unionByName(gone), keep_tombstones=False).select("key", "value")


def kv_level_stats(spark, sf_dir):
    return runs.level_stats(files(spark, sf_dir))


def kv_level_budget(spark, sf_dir):
    return runs.over_budget(kv_level_stats(spark, sf_dir), LEVELS)


def kv_levels_with_data(spark, sf_dir):
    return files(spark, sf_dir).agg(F.countDistinct("level").alias("levels"))


def kv_pick_inputs(spark, sf_dir):
    return runs.pick_inputs(files(spark, sf_dir)).select("level", "run_id", "smallest", "largest")


def kv_range_file_prune(spark, sf_dir):
    return runs.in_files(kv_flush_runs(spark, sf_dir), "u000020", "u000050").select("run_id", "smallest", "largest")


def kv_orphans(spark, sf_dir):
    listing = spark.range(15).select(F.col("id").alias("number"), F.format_string("%06d.sst", F.col("id")).alias("name"))
    live = kv_flush_runs(spark, sf_dir).where("run_id < 11").select(F.col("run_id").alias("number"))
    return listing.join(live, "number", "left_anti").select("name")


def kv_recovery_prefix(spark, sf_dir):
    return runs.contiguous_prefix(ops(spark, sf_dir).where("seq <> 421")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def kv_bloom_bits(spark, sf_dir):
    return kv_flush_runs(spark, sf_dir).select("run_id", "entries", sketch.filter_bits(F.col("entries"), 10).alias("bits"))


def kv_bloom_theory(spark, sf_dir):
    b = F.col("id")
    return spark.range(1, 21).select(b.alias("bits_per_key"), sketch.probes_column(b).alias("probes"), F.round(sketch.false_positive_column(b), 12).alias("fp"))


def kv_user_bytes_by_bucket(spark, sf_dir):
    return ops(spark, sf_dir).groupBy(F.floor(F.col("seq") / 1000).cast("bigint").alias("bucket")).agg(F.sum(runs.user_bytes().cast("bigint")).alias("user_bytes"))


def kv_ordered_iteration(spark, sf_dir):
    ranked = ordered.rank(merge.newest_wins(ops(spark, sf_dir)), "key", "position")
    return ranked.select("position", "key", "tomb")


def kv_crc32(spark, sf_dir):
    return ops(spark, sf_dir).groupBy("key").agg(F.max_by("value", "seq").alias("value")).select("key", F.crc32(F.encode("value", "utf-8")).alias("crc"))


def kv_murmur128(spark, sf_dir):
    return ops(spark, sf_dir).select("key").distinct().select("key", sketch.murmur_column("key").alias("murmur128"))


def kv_bloom_fp(spark, sf_dir):
    rows = run_rows(spark, sf_dir).select("run_id", "key")
    absent = rows.select("run_id", F.concat("key", F.lit("-absent")).alias("key"))
    filters = sketch.bloom_by_run(rows, 10)
    asked = sketch.may_contain(rows, filters).groupBy("run_id").agg(F.count(F.lit(1)).alias("present"), F.sum(F.col("maybe").cast("bigint")).alias("found"))
    false = sketch.may_contain(absent, filters).groupBy("run_id").agg(F.sum(F.col("maybe").cast("bigint")).alias("false_positives"))
    return asked.join(false, "run_id")


QUERIES: dict[str, Query] = {name: f for name, f in list(globals().items()) if name.startswith("kv_")}

_OPS = """
ops AS (
  SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') || '/' || lpad((event_id % 16)::VARCHAR, 2, '0') AS key, event_id AS seq,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_type = 'error' AS tomb
  FROM events
)"""
_RUNS = (
    _OPS
    + """,
logged AS (SELECT *, floor((sum(length(key) + length(value)) OVER (ORDER BY seq) - length(key) - length(value)) / 16384)::BIGINT AS run_id FROM ops),
runs AS (SELECT run_id, key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tomb, seq) AS tomb FROM logged GROUP BY run_id, key)"""
)
_STATS = (
    _RUNS
    + """,
stats AS (
  SELECT run_id, count(*) AS entries, sum(tomb::BIGINT)::BIGINT AS tombstones, min(key) AS smallest, max(key) AS largest, sum(9 + length(key) + length(value))::BIGINT AS bytes
  FROM runs GROUP BY run_id
),
files AS (SELECT *, CASE WHEN run_id >= 7 THEN 0 WHEN run_id >= 4 THEN 1 ELSE 2 END AS level FROM stats),
levels AS (SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY level)"""
)
_NEWEST = "SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tomb, seq) AS tomb FROM {} GROUP BY key"


def _scan(where: str) -> str:
    return f"WITH {_OPS} SELECT key, value FROM ({_NEWEST.format('ops')}) WHERE NOT tomb AND {where}"


ORACLE_SQL: dict[str, str] = {
    "kv_scan_range": _scan("key >= 'u000020' AND key < 'u000050'"),
    "kv_scan_unbounded": _scan("key >= 'u000140'"),
    "kv_scan_prefix": _scan("starts_with(key, 'u00001')"),
    "kv_scan_empty": _scan("key >= 'zzz' AND key < 'zzz'"),
    "kv_multi_get": f"""WITH {_OPS},
probe AS (SELECT 'u' || lpad((i * 3)::VARCHAR, 6, '0') || '/' || lpad((i % 16)::VARCHAR, 2, '0') AS key FROM range(150) t(i)),
state AS ({_NEWEST.format("ops")})
SELECT probe.key, CASE WHEN tomb IS NULL THEN 'NOT_FOUND' WHEN tomb THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT tomb THEN value END AS value
FROM probe LEFT JOIN state USING (key)""",
    "kv_flush_runs": f"WITH {_STATS} SELECT * FROM stats",
    "kv_merge_keep_tombstones": f"WITH {_RUNS} {_NEWEST.format('runs')}",
    "kv_compact_bottommost": f"WITH {_RUNS} SELECT key, seq, value FROM ({_NEWEST.format('runs')}) WHERE NOT tomb",
    "kv_scan_layered": f"WITH {_OPS} SELECT key, seq, value FROM ({_NEWEST.format('ops')}) WHERE NOT tomb",
    "kv_file_overlap": f"WITH {_STATS} SELECT x.run_id AS a, y.run_id AS b FROM stats x, stats y WHERE x.run_id < y.run_id AND x.largest >= y.smallest AND x.smallest <= y.largest",
    "kv_sparse_index_lookup": f"""WITH {_RUNS},
placed AS (SELECT run_id, key, floor((sum(9 + length(key) + length(value)) OVER (PARTITION BY run_id ORDER BY key) - 9 - length(key) - length(value)) / 4096)::BIGINT AS block FROM runs),
idx AS (SELECT run_id, block, min(key) AS first_key FROM placed GROUP BY run_id, block)
SELECT p.run_id, p.key, max(idx.block) AS block FROM placed p JOIN idx ON idx.run_id = p.run_id AND idx.first_key <= p.key GROUP BY p.run_id, p.key""",
    "kv_wal_prefix": f"WITH {_OPS} SELECT count(*) AS n, max(seq) AS last_seq FROM ops WHERE seq < (SELECT min(seq) FROM ops WHERE seq % 997 = 996)",
    "kv_write_amp": f"""WITH {_STATS}, u AS (SELECT sum(length(key) + CASE WHEN tomb THEN 0 ELSE length(value) END)::BIGINT AS user_bytes FROM ops), f AS (SELECT sum(bytes)::BIGINT AS flush_bytes FROM stats)
SELECT user_bytes, flush_bytes, flush_bytes / user_bytes AS write_amplification FROM u, f""",
    "kv_lru_hits": """WITH trace AS (SELECT event_id AS seq, user_id % 50 AS block, lag(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS prev FROM events),
between_ AS (SELECT a.seq, count(*) AS others FROM trace a JOIN trace t ON t.seq > a.prev AND t.seq < a.seq WHERE t.prev IS NULL OR t.prev < a.prev GROUP BY a.seq),
hit AS (SELECT a.seq, a.prev IS NOT NULL AND coalesce(others, 0) < 20 AS hit FROM trace a LEFT JOIN between_ USING (seq))
SELECT sum(hit::BIGINT)::BIGINT AS hits, (count(*) - sum(hit::BIGINT))::BIGINT AS misses, sum(hit::BIGINT) / count(*) AS hit_rate FROM hit""",
    "kv_crc32": f"""WITH {_OPS}, newest AS (SELECT key, arg_max(value, seq) AS value FROM ops GROUP BY key),
bytes AS (SELECT key, list_prepend(4294967295, list_transform(string_split(value, ''), lambda c: ord(c)::BIGINT)) AS x, value FROM newest)
SELECT key, CASE WHEN value = '' THEN 0 ELSE xor(4294967295, list_reduce(x, lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) END::BIGINT AS crc FROM bytes""",
    "kv_latency_percentiles": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS rank, count(*) OVER () AS n FROM events)
SELECT q, value FROM r JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE)) p(q) ON rank = least(floor(q * n), n - 1) + 1""",
    "kv_delete_band": _scan("NOT (key >= 'u000020' AND key < 'u000030')"),
    "kv_level_stats": f"WITH {_STATS} SELECT * FROM levels",
    "kv_level_budget": f"WITH {_STATS} SELECT *, CASE WHEN level = 0 THEN files >= 4 ELSE bytes > 30000 * pow(4, level - 1) END AS needs_compaction FROM levels",
    "kv_levels_with_data": f"WITH {_STATS} SELECT count(DISTINCT level) AS levels FROM files",
    "kv_pick_inputs": f"""WITH {_STATS}, span AS (SELECT min(smallest) AS lo, max(largest) AS hi FROM files WHERE level = 0)
SELECT level, run_id, smallest, largest FROM files, span WHERE level = 0 OR (level = 1 AND largest >= lo AND smallest <= hi)""",
    "kv_range_file_prune": f"WITH {_STATS} SELECT run_id, smallest, largest FROM stats WHERE largest >= 'u000020' AND smallest < 'u000050'",
    "kv_orphans": f"WITH {_STATS} SELECT format('{{:06d}}.sst', i) AS name FROM range(15) t(i) WHERE i NOT IN (SELECT run_id FROM stats WHERE run_id < 11)",
    "kv_recovery_prefix": f"WITH {_OPS}, kept AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS n FROM ops WHERE seq <> 421) SELECT count(*) AS n, max(seq) AS last_seq FROM kept WHERE seq = n + (SELECT min(seq) FROM kept)",
    "kv_bloom_bits": f"WITH {_STATS} SELECT run_id, entries, (ceil(greatest(entries * 10, 64) / 8) * 8)::BIGINT AS bits FROM stats",
    "kv_bloom_theory": """WITH b AS (SELECT i AS bits_per_key, least(greatest(round(i * 0.6931471805599453), 1), 30)::INTEGER AS probes FROM range(1, 21) t(i))
SELECT bits_per_key, probes, round(pow(1 - exp(-probes / bits_per_key), probes), 12) AS fp FROM b""",
    "kv_user_bytes_by_bucket": f"WITH {_OPS} SELECT floor(seq / 1000)::BIGINT AS bucket, sum(length(key) + CASE WHEN tomb THEN 0 ELSE length(value) END)::BIGINT AS user_bytes FROM ops GROUP BY 1",
    "kv_ordered_iteration": f"WITH {_OPS} SELECT row_number() OVER (ORDER BY key) AS position, key, tomb FROM ({_NEWEST.format('ops')})",
}
