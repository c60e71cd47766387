"""Registered queries next to their SQL, and all of them by name."""

import duckdb
import pytest

import __spark_entry__
from tests.compare import frame
from wardline.catalog.registry import BASE
from wardline.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = frame(QUERIES[name](spark, sf_dir).toPandas()), frame(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and not (got != want).any(axis=None)


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
