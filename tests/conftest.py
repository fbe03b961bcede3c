import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("carewise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="carewise-tests-"))
    return session


@pytest.fixture
def with_partitions(spark):
    """Sets the number of shuffle partitions and restores it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def change(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield change
    spark.conf.set("spark.sql.shuffle.partitions", before)
