import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Whether a query and its SQL, run by DuckDB over the same tables, have the same rows."""
    import duckdb

    def check(query, sql, sf="sf0.001"):
        db = duckdb.connect()
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            db.execute(f"create view {name} as select * from '{DATA}/{sf}/{name}.parquet'")
        got, want = query(spark, f"{DATA}/{sf}").toPandas(), db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None))) for d in (got, want)]
        assert rows[0] == rows[1]
        return got

    return check
