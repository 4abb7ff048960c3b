import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SEGMENT = (
    "plan_id string, seq bigint, layer string, source_type string, "
    "x1 double, y1 double, x2 double, y2 double"
)


@pytest.fixture(scope="session")
def drawing(spark):
    """Segment table from ``{plan: [(layer, x1, y1, x2, y2), ...]}``."""

    def build(plans):
        rows = [
            (plan, n, s[0], "LINE", *map(float, s[1:]))
            for plan, items in plans.items()
            for n, s in enumerate(items)
        ]
        return spark.createDataFrame(rows, SEGMENT)

    return build
