"""Every registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_every_run_is_looked_up_in_its_own_index(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    # The registered SQL's runs, each with an index of its own.
    want = con.sql(f"""WITH {catalogue._RUNS},
placed AS (SELECT run_id, key, floor((sum(9 + length(key) + length(value)) OVER (PARTITION BY run_id ORDER BY key) - 9 - length(key) - length(value)) / 4096)::BIGINT AS block FROM runs),
idx AS (SELECT run_id, block, min(key) AS first_key FROM placed GROUP BY ALL)
SELECT run_id, key, (SELECT max(block) FROM idx WHERE first_key <= placed.key AND idx.run_id = placed.run_id) AS block FROM placed""")
    df = catalogue.kv_sparse_index_lookup(spark, sf)
    got = df.collect()
    assert len({r["run_id"] for r in got}) == 11 and normal(got, df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_merge_with_tombstones_takes_all_runs(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(f"WITH {catalogue._RUNS} {catalogue._NEWEST.format('runs')}")
    df = catalogue.kv_merge_keep_tombstones(spark, sf)
    got = df.collect()
    assert any(r["tomb"] for r in got) and normal(got, df.columns) == normal(want.fetchall(), want.columns)
