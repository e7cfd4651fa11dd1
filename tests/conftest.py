import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logloom.session import local_session
    s = local_session("*", app="logloom-tests", extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


def one(spark, expr, **cols):
    """Evaluate a Column expression over one row of literal columns."""
    from pyspark.sql import functions as F
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], names)
    return df.select(expr.alias("x")).collect()[0]["x"]
