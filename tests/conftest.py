import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows_of(df):
    """Order-free, type-loose rows of a pandas frame, columns by name."""

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest test tables."""

    def check(query, sql):
        mine, theirs = rows_of(query(spark, SMALL).toPandas()), rows_of(duck.sql(sql).df())
        assert mine[0] == theirs[0]
        assert mine[1] == theirs[1]

    return check
