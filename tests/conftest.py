"""One Spark session for all tests, with a shared folder of its own."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def probe(spark):
    """Five rows with ties."""
    rows = [(1, 10, 5.5, "a"), (2, 20, 2.0, "b"), (0, 30, 9.0, "c"), (2, 40, 2.0, "d"), (1, 50, 1.0, "e")]
    return spark.createDataFrame(rows, "ANT int, WHAT int, VAL double, NAME string").coalesce(1)
