import pytest
from pyspark.sql import SparkSession

from fidelmill.runtime import ship

# at import: tests build columns while they are collected
SESSION = (
    SparkSession.builder.master("local[4]")
    .config("spark.driver.memory", "4g")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)


@pytest.fixture(scope="session")
def spark():
    SESSION.sparkContext.setLogLevel("ERROR")
    ship(SESSION)
    yield SESSION
