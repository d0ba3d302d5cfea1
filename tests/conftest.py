import pytest

from draftlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    yield session


@pytest.fixture
def small_tasks(spark):
    """Every group counts as hot, so the split plans run."""
    spark.conf.set("draftlake.rowsPerTask", "3")
    yield spark
    spark.conf.unset("draftlake.rowsPerTask")
