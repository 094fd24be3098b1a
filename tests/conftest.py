import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("HUNKWEAVE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}").master("local[8]").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con
