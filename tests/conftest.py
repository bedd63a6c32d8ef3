import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from rowmend.sources.workspace import cleanup, ensure_workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ensure_workspace(session)
    yield session
    cleanup(session)
    session.stop()


@pytest.fixture
def many_partitions(spark):
    """Keep small range partitions apart, as they would be on a large table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def frame(spark):
    """Build a table of strings from rows and a space-separated header."""
    def build(rows, header):
        columns = header.split()
        schema = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return build
