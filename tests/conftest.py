"""One local session for all tests, and the comparison of results with SQL."""

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp}")
        .config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{DATA}/sf0.001/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    """A value in a form that is the same from Spark and from DuckDB."""
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "Decimal")):
        return None if x != x else f"{float(x) + 0.0:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].removesuffix("T00:00:00")
    if hasattr(x, "__iter__") and not isinstance(x, (str, dict)):
        return str([plain(y) for y in x])
    return str(x)


NULL = "\0null"  # not the empty text


def same_rows(got, want) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (sorted(tuple(NULL if (x := plain(v)) is None else x for v in r) for r in df[cols].astype(object).itertuples(index=False)) for df in (got, want))
    assert len(a) == len(b)
    assert a == b
