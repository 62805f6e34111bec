import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sieveline.session import build_session

    s = build_session("tests", cpus=os.environ.get("BENCH_CPUS", "*"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function over a list of strings."""

    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        from pyspark.sql import functions as F

        return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
