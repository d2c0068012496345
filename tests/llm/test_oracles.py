"""Queries of this subpackage with SQL beside them give the same rows as that SQL."""

import duckdb
import pytest

from tests.test_catalogue import plain
from thalweg.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 14))
