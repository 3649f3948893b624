import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def plain(v):
    """A value in a form that both engines print alike."""
    if isinstance(v, float):
        return "nan" if v != v else repr(float(f"{v:.10g}"))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(df, sql):
        columns = sorted(df.columns)
        ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert ours == theirs

    return check
