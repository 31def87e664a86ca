import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canon(v):
    """Values in a form that both engines share."""
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


def same(spark_rows, columns, cursor):
    """Both results as sorted rows with columns in name order."""
    names = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(names)
    left = sorted(repr([canon(r[i]) for i in sorted(range(len(columns)), key=lambda i: columns[i])]) for r in spark_rows)
    right = sorted(repr([canon(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])]) for r in cursor.fetchall())
    return left, right
