"""One Spark session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    """Rows as sorted tuples with columns in the order of their names; numbers by value."""

    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, float):
            return float(f"{x:.12g}")
        return x if isinstance(x, int) else str(x)

    columns = sorted(frame.columns)
    rows = zip(*[frame[c].tolist() for c in columns], strict=True) if columns else []
    out = [tuple(plain(x) for x in row) for row in rows]
    return columns, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        a, b = canonical(spark_frame), canonical(duck_frame)
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        for x, y in zip(a[1], b[1], strict=True):
            assert x == y or all(p == q or isinstance(p, float) and abs(p - q) <= 1e-9 * max(1, abs(p)) for p, q in zip(x, y, strict=True)), (x, y)

    return check
