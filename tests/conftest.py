import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tonemark.plans.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    ship_package()
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Evaluate a column function on a list of strings."""

    def run(function, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        from pyspark.sql import functions as F

        return [r.out for r in rows.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]

    return run
