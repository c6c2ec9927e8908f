import pytest
from pyspark.sql import SparkSession

from quarrykit import session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = session.build("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
