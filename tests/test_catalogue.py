"""Every query with SQL beside it gives the same rows as that SQL on the same files."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from thalweg.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.10g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].map(cell)
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, sql, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = sql.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["q26_schematic_layout"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_parts_and_suppliers_of_one_number_are_different_nodes(spark, tmp_path):
    """As in tables of over a million parts: numbers of parts reach those of suppliers as nodes."""
    for name, key in (("lineitem", "l_partkey"), ("part", "p_partkey"), ("supplier", None)):
        src = f"/root/testdata/sf0.001/{name}.parquet"
        moved = f"* replace ({key} + 999995 as {key})" if key else "*"
        duckdb.sql(f"copy (select {moved} from '{src}') to '{tmp_path}/{name}.parquet'")
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("q24_flow_direction", "q24_flow_stats", "q35_delete_split"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
