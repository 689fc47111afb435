import os

import pytest
from pyspark.sql import SparkSession


_HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(_HERE), _HERE, os.environ.get("PYTHONPATH")]))  # for workers


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
