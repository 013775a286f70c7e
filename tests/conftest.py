"""One local session for all tests, and comparison with DuckDB over the same tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("DOCWEFT_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables."""
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows in an order of their own, columns by name, numbers rounded."""
    df = df[sorted(df.columns)]

    def cell(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        if hasattr(x, "tolist"):
            return str(x.tolist())
        return None if x is None or x is pd.NaT or x is pd.NA else x

    return sorted((tuple(cell(x) for x in row) for row in df.astype(object).itertuples(index=False)), key=str)


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]


@pytest.fixture(scope="session")
def compare():
    return same_rows


def run_python(code: str, cwd: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, timeout=120)
