import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog.functions import sketch
from tidelog.model import CorruptionError
from tidelog.operators import cache
from tidelog.sources import binary


@pytest.mark.parametrize(
    ("key", "h1", "h2"),
    [
        ("", 0, 0),
        ("a", 0x85555565F6597889, 0xE6B53A48510E895A),
        ("hello", 0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19),
        ("present-000000000000", 0x1A4606135B3BE936, 0x0FE1E6C0F87F5AAD),
        ("0123456789abcdef", 0x4BE06D94CF4AD1A7, 0x87C35B5C63A708DA),
    ],
)
def test_murmur(key, h1, h2):
    one, two = sketch.murmur128([key.encode(), b"other"])
    assert (int(one[0]), int(two[0])) == (h1, h2)


def test_crc32_is_the_usual_one(spark):
    row = spark.range(1).select(F.crc32(F.lit("123456789")).alias("a"), F.crc32(F.lit("")).alias("b")).first()
    assert (row["a"], row["b"]) == (0xCBF43926, 0)


def test_bloom():
    present, absent = [f"present-{i:012d}".encode() for i in range(20_000)], [f"absent--{i:012d}".encode() for i in range(20_000)]
    rates = []
    for bits in (4, 10, 16):
        data = sketch.bloom_build(present, bits)
        assert sketch.bloom_may_contain(data, present).all()
        rates.append(sketch.bloom_may_contain(data, absent).mean())
    assert rates[0] > rates[1] > rates[2] and 0.5 * 0.0082 <= rates[1] <= 1.6 * 0.0082 + 0.002
    assert sketch.bloom_may_contain(None, [b"x"]).all() and sketch.bloom_may_contain(b"\x01", [b"x"]).all()
    assert [sketch.probes(b) for b in (1, 4, 10, 16, 50)] == [1, 3, 7, 11, 30]


def table_rows(n, step=1):
    return [(f"key{i:08d}".encode(), b"" if i % 5 == 0 else f"value{i}".encode(), i % 5 == 0) for i in range(0, n, step)]


def test_sorted_table_round_trip(spark, tmp_path):
    rows = table_rows(2000)
    data = binary.encode_table(rows, block_size=256)
    t = binary.SortedTable(data)
    assert list(t.rows()) == rows and t.entries == 2000 and t.get(b"key00000007") == rows[7] and t.get(b"key00000005")[2]
    assert t.get(b"aaa") is None and t.get(b"zzz") is None and t.get(b"key00000007x") is None
    (tmp_path / "000001.sst").write_bytes(data)
    got = binary.read_tables(spark, str(tmp_path)).orderBy("key").collect()
    assert [(bytes(r["key"]), bytes(r["value"]), r["tomb"]) for r in got] == rows
    assert binary.SortedTable(binary.encode_table([])).entries == 0
    with pytest.raises(ValueError):
        binary.encode_table([(b"b", b"", False), (b"a", b"", False)])


@pytest.mark.parametrize("at", [40, -1, -60])
def test_damaged_table(at):
    data = bytearray(binary.encode_table(table_rows(2000)))
    data[at] ^= 0xFF
    with pytest.raises(CorruptionError):
        list(binary.SortedTable(bytes(data)).rows())


def test_log_ends_at_a_torn_record(spark, tmp_path):
    rows = [(b"a", b"1", False), (b"b", b"2", False), (b"c", b"", True)]
    data = binary.encode_log(rows)
    for tail in (b"", b"\x11\x22\x33\x44\x55", data[:9]):
        assert list(binary.replay_log(data + tail)) == rows
    hurt = bytearray(data)
    hurt[10] ^= 1
    assert list(binary.replay_log(bytes(hurt))) == []
    (tmp_path / "wal.log").write_bytes(data + b"\x01")
    assert binary.read_logs(spark, str(tmp_path)).count() == 3


def test_manifest_round_trip():
    levels = [[(7, 100, 5, b"a", b"c")], [], [(3, 50, 2, b"", b"zz")]]
    data = binary.encode_manifest(8, levels)
    assert list(binary.decode_manifest(data)) == [(0, 7, 100, 5, b"a", b"c"), (2, 3, 50, 2, b"", b"zz")]
    with pytest.raises(CorruptionError):
        list(binary.decode_manifest(data[:-1]))


def test_cache_accounting_and_eviction():
    c = cache.BlockCache(200)
    assert not c.lookup((1, 0))
    for k in ((1, 0), (1, 1)):
        c.insert(k, 100)
    assert c.lookup((1, 0)) and not c.lookup((2, 0))
    c.insert((1, 2), 100)
    assert (1, 1) not in c.blocks and (1, 0) in c.blocks and (c.hits, c.misses) == (1, 2) and c.hit_rate() == 1 / 3
    off = cache.BlockCache(0)
    off.insert((1, 0), 10)
    assert not off.blocks and cache.BlockCache(5).hit_rate() == 0.0
    big = cache.BlockCache(50)
    big.insert((1, 0), 100)
    assert (1, 0) in big.blocks


def test_equal_block_model_is_a_true_lru(spark):
    rng = random.Random(2)
    trace = [(i, rng.randrange(30)) for i in range(600)]
    lru, hits = cache.BlockCache(8), {}
    for i, b in trace:
        hits[i] = lru.lookup((0, b))
        lru.insert((0, b), 1)
    got = cache.equal_blocks(spark.createDataFrame(trace, "seq bigint, block int"), 8)
    assert {r["seq"]: r["hit"] for r in got.collect()} == hits


def test_equal_blocks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(cache, "RANGE_ROWS", 100)
    rng = random.Random(3)
    trace = [(i * 3, rng.randrange(40) if i < 900 else rng.randrange(5)) for i in range(1500)]
    df = spark.createDataFrame(trace, "seq bigint, block int")
    for capacity in (0, 1, 8, 100):
        lru = cache.BlockCache(capacity)
        hits = {}
        for i, b in trace:
            hits[i] = lru.lookup((0, b))
            lru.insert((0, b), 1)
        assert {r["seq"]: r["hit"] for r in cache.equal_blocks(df, capacity).collect()} == hits
    assert cache.equal_blocks(df.limit(0), 8).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_lru_query_runs_all_accesses(spark):
    from tidelog.plans import catalogue

    sf = "/root/testdata/sf0.01"
    lru = cache.BlockCache(20)
    for r in catalogue.events(spark, sf).orderBy("event_id").select("user_id").collect():
        lru.lookup((r[0] % 50,))
        lru.insert((r[0] % 50,), 1)
    assert catalogue.kv_lru_hits(spark, sf).first()[:2] == (lru.hits, lru.misses) and lru.hits + lru.misses == catalogue.events(spark, sf).count()


def test_files_written_from_a_dataframe(spark, tmp_path):
    from tidelog.sources import binary

    rows = [(f"k{i:05d}", f"v{i}" * 3 if i % 5 else "", i % 5 == 0, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, value string, tomb boolean, seq bigint")
    files = binary.write_tables(df, str(tmp_path / "t"), limit=5000)
    meta = sorted((bytes(r["smallest"]), bytes(r["largest"]), r["entries"], r["number"]) for r in files.collect())
    assert len(meta) > 4 and sum(m[2] for m in meta) == 2000 and all(a[1] < b[0] for a, b in zip(meta, meta[1:])) and len({m[3] for m in meta}) == len(meta)
    back = {(bytes(r["key"]).decode(), bytes(r["value"]).decode(), r["tomb"]) for r in binary.read_tables(spark, str(tmp_path / "t")).collect()}
    assert back == {r[:3] for r in rows}
    assert {binary.file_number(f.name) for f in (tmp_path / "t").glob("*.sst")} == {(m[3], "sst") for m in meta} and binary.file_number("x.sst") is None and binary.file_number("1.tmp") is None
    binary.write_logs(df, str(tmp_path / "l"), limit=9000)
    logged = [(bytes(r["key"]).decode(), bytes(r["value"]).decode(), r["tomb"]) for r in binary.read_logs(spark, str(tmp_path / "l")).collect()]
    assert sorted(logged) == sorted(r[:3] for r in rows)
    from pyspark.sql import functions as F

    binary.write_manifest(files.withColumn("level", F.lit(1)), str(tmp_path / "m" / "MANIFEST"), 99)
    assert sorted((bytes(r["smallest"]), bytes(r["largest"]), r["entries"], r["number"]) for r in binary.read_manifests(spark, str(tmp_path / "m")).collect()) == meta


def test_seek_and_bounds():
    from tidelog.sources import binary

    rows = [(b"k%05d" % (2 * i), b"v" * (i % 9), i % 7 == 0) for i in range(900)]
    table = binary.SortedTable(binary.encode_table(rows, block_size=200))
    assert (table.smallest, table.largest) == (rows[0][0], rows[-1][0])
    for key in (b"", b"k00000", b"k00001", b"k00777", b"k01798", b"k9"):
        assert list(table.seek(key)) == [r for r in rows if r[0] >= key]
    empty = binary.SortedTable(binary.encode_table([]))
    assert (empty.smallest, empty.largest, list(empty.seek(b"a"))) == (b"", b"", [])
