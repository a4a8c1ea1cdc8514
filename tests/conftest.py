import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tourlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a Column rule on a list of texts."""
    from pyspark.sql import functions as F

    def run(rule, values):
        rows = spark.createDataFrame(list(enumerate(values)), "n int, x string")
        return [r[0] for r in rows.select("n", rule(F.col("x")).alias("v")).orderBy("n").select("v").collect()]

    return run
