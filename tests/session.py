"""The Spark session of the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(cores: str = "8") -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="gridlytics-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("gridlytics-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", scratch).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
