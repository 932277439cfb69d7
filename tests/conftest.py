import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(value):
    import math
    from datetime import datetime

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in cursor.fetchall())
        assert mine == theirs

    return check
