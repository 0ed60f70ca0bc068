"""Fixtures that all tests share."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def same_rows(got, columns, wanted, wanted_columns) -> None:
    """Two results hold the same rows, whatever their order; columns go by name."""
    assert sorted(columns) == sorted(wanted_columns)
    at = [wanted_columns.index(c) for c in columns]
    key = repr
    mine = sorted((tuple(map(_plain, r)) for r in got), key=key)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in wanted), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-7) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.fixture(scope="session")
def compare():
    return same_rows
