from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _plain(v: object) -> object:
    return round(v, 6) if isinstance(v, float) else v


def compare_with_sql(spark: SparkSession, sf_dir: str, run, sql: str) -> int:  # noqa: ANN001
    """Asserts that a query and its SQL give the same columns and rows; returns how many."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(dict(zip(names, x, strict=True))[c]) for c in columns]) for x in result.fetchall())
    assert got == want
    return len(got)


@pytest.fixture(scope="session")
def small() -> str:
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
