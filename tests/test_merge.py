import random

import pytest

from tidelog.operators import merge, ordered, runs


def ops(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, value string, tomb boolean")


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_last_write_wins_and_deletes_hide(spark):
    rows = [("a", 1, "1", False), ("b", 2, "2", False), ("a", 3, "3", False), ("b", 4, "", True), ("", 5, "empty key", False), ("c", 6, "", False)]
    assert as_dict(merge.scan(ops(spark, rows))) == {"": "empty key", "a": "3", "c": ""}


def test_put_after_delete_is_visible(spark):
    assert as_dict(merge.scan(ops(spark, [("a", 1, "1", False), ("a", 2, "", True), ("a", 3, "3", False)]))) == {"a": "3"}


def test_tombstones_stay_in_a_merge(spark):
    got = {r["key"]: (r["value"], r["tomb"]) for r in merge.newest_wins(ops(spark, [("a", 5, "new-a", False), ("c", 6, "", True), ("a", 1, "old-a", False), ("b", 2, "old-b", False), ("c", 3, "old-c", False)])).collect()}
    assert got == {"a": ("new-a", False), "b": ("old-b", False), "c": ("", True)}


def test_layers_rank_before_age(spark):
    new, old = ops(spark, [("a", 9, "new", False), ("c", 8, "", True)]), ops(spark, [("a", 1, "old", False), ("b", 2, "b", False), ("c", 3, "c", False)])
    got = {r["key"]: r["tomb"] for r in merge.layered([new, old]).collect()}
    assert got == {"a": False, "b": False, "c": True}


@pytest.mark.parametrize(("start", "end", "keys"), [("k02", "k04", ["k02", "k03"]), ("k08", "", ["k08", "k09"]), (None, "k02", ["k00", "k01"]), ("k05", "k05", []), ("k07", "k03", []), ("zzz", None, [])])
def test_bounds_are_half_open(spark, start, end, keys):
    rows = [(f"k{i:02d}", i, "v", False) for i in range(10)]
    random.Random(1).shuffle(rows)
    assert [r["key"] for r in merge.scan(ops(spark, rows), start, end).collect()] == keys


def test_multi_get_has_three_answers(spark):
    state = ops(spark, [("a", 1, "1", False), ("b", 2, "2", False), ("b", 3, "", True)])
    probe = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    got = sorted((r["key"], r["status"], r["value"]) for r in merge.multi_get(state, probe).collect())
    assert got == [("a", "FOUND", "1"), ("a", "FOUND", "1"), ("b", "DELETED", None), ("c", "NOT_FOUND", None)]
    assert merge.get(state, "a") == ("FOUND", "1") and merge.get(state, "b") == ("DELETED", None) and merge.get(state, "c") == ("NOT_FOUND", None)


@pytest.mark.parametrize("prefix", ["", "a", "az", "a\U0010ffff", "\U0010ffff", "퟿"])
def test_prefix_end(prefix):
    end = merge.prefix_end(prefix)
    assert end is None or (end > prefix + "\U0010ffff" * 3 or prefix == "퟿")


def test_key_query_reads_no_values(spark, tmp_path):
    ops(spark, [("a", 1, "1", False)]).write.parquet(str(tmp_path / "t"))
    plan = merge.newest_wins(spark.read.parquet(str(tmp_path / "t")), keep_tombstones=False).where("key >= 'a'").select("key")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<key:string,seq:bigint,tomb:boolean>" in plan and "GreaterThanOrEqual(key,a)" in plan


def test_running_sum_and_rank(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS id", "id * 7 % 1000 % 13 AS v")
    got = {r["id"]: (r["s"], r["rank"]) for r in ordered.rank(ordered.running_sum(df, "id", df["v"], "s"), "id").collect()}
    total = 0
    for i in range(1000):
        total += i % 13
        assert got[i] == (total, i + 1)


def test_running_sum_over_several_coalesced_ranges(spark, tmp_path):
    n, text = 300_000, "x" * 60
    spark.range(0, n, 1, 1).selectExpr("id * 7 % 300000 AS id", f"concat('{text}', id) AS text").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        out = ordered.running_sum(df, "id", df["id"] % 13, "s")
        tens = "13 * 6 * (id div 13) + (id % 13) * (id % 13 + 1) div 2"  # 0 + ... + 12 a round, then what has begun
        assert tuple(out.selectExpr("count(1)", f"count_if(s <> {tens})", "count(distinct id)", "min(length(text)) > 60").first()) == (n, 0, n, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_percentiles_do_not_interpolate(spark):
    df = spark.range(1000).selectExpr("CAST(id AS double) AS v", "id")
    assert sorted(tuple(r) for r in ordered.percentiles(df, "v", "id", [0.5, 0.99, 1.0]).collect()) == [(0.5, 500.0), (0.99, 990.0), (1.0, 999.0)]
    assert ordered.percentiles(df.where("id < 0"), "v", "id", [0.5]).count() == 0


def test_runs_hold_a_key_once(spark):
    rows = [(f"k{i % 5}", i, "x" * 10, i % 7 == 0) for i in range(40)]
    out = runs.run_rows(runs.flush_runs(ops(spark, rows), 100))
    assert out.count() == out.select("run_id", "key").distinct().count() and out.select("run_id").distinct().count() > 3


def test_contiguous_prefix(spark):
    df = ops(spark, [("k", i, "", False) for i in range(50) if i != 31])
    assert runs.contiguous_prefix(df).count() == 31
    assert runs.contiguous_prefix(ops(spark, [("k", i, "", False) for i in range(50)])).count() == 50


def test_write_amplification_of_nothing(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(runs.write_amplification(F.lit(0), F.lit(5), F.lit(5)).alias("w")).first()["w"] == 0.0


def test_contiguous_prefix_at_any_place(spark):
    from tidelog.operators import runs

    for gone in ([], [5], [1], [250, 400], [499]):
        seqs = [i for i in range(500) if i not in gone]
        got = sorted(r["seq"] for r in runs.contiguous_prefix(spark.createDataFrame([(i + 10,) for i in seqs], "seq bigint")).collect())
        assert got == [i + 10 for i in range(min([g for g in gone if g != 0], default=500))]
    assert runs.contiguous_prefix(spark.createDataFrame([], "seq bigint")).collect() == []
