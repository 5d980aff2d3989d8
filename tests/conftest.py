import os
import sys
import tempfile

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", work).config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a query's rows with its SQL's, order aside."""

    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)

        assert sorted(map(_text, _values(got, names))) == sorted(map(_text, _values(want, names)))

    return check


def _text(row):
    return tuple((v is None, str(v)) for v in row)


def _values(df, names):
    for r in df[names].astype(object).itertuples(index=False):
        yield tuple(None if pd.isna(v) else float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
