import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def canonical(df):
    """Rows of a pandas frame, columns by name, comparable across engines."""

    def one(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, (float, int)) or hasattr(x, "dtype") and x.dtype.kind in "iufb":
            return round(float(x), 6) + 0.0
        return str(x)

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    def check(query, sql):
        a, b = query(spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert canonical(a) == canonical(b)

    return check
