import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def prov(spark, sf_dir):
    """The replicated weekly table, stored once for all tests."""
    from fixtures.weekly import WEEKLY_PROV, weekly_prov
    from weekwatch.sources.scratch import store
    from weekwatch.sources.tables import conform

    return store(conform(weekly_prov(spark, sf_dir), WEEKLY_PROV), "prov")


@pytest.fixture(scope="session")
def series(spark, sf_dir):
    """The weekly series per department, stored once for all tests."""
    from fixtures.weekly import WEEKLY_DEPT, weekly_dept
    from weekwatch.plans.detection import series_of
    from weekwatch.sources.scratch import store

    return store(series_of(weekly_dept(spark, sf_dir), WEEKLY_DEPT), "series")
