import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same_rows(rows, names, other, other_names):
    """Whether two results are equal as bags, by column name; doubles to nine digits."""

    def canon(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    assert sorted(names) == sorted(other_names)
    order, other_order = (sorted(range(len(n)), key=lambda i: n[i]) for n in (names, other_names))
    assert sorted(tuple(canon(r[i]) for i in order) for r in rows) == sorted(tuple(canon(r[i]) for i in other_order) for r in other)
