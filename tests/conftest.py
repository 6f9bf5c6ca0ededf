import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def normal(frame):
    """Rows as sorted tuples of text, for comparing engines."""
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    return len(got)
