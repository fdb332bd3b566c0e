import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    s = builder.config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(shared / "checkpoints")).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
