"""Staging of a frame that several later steps read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where that is unset, one in the session's warehouse.

    A warehouse on the driver's own machine is no shared folder once the executors run on others, so it is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match("(file:)?/", folder):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and go on from there, so a lost executor costs no recomputation."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
