"""Feature tables: write by primary key, look up by key, score in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridlytics.sources.keyed import KeyedTable
from gridlytics.sources.merge import upsert
from gridlytics.sources.tables import load, save


def feature_write(
    spark: SparkSession, features: DataFrame, name: str, key: str, merge: bool = False, buckets: int | None = None
) -> None:
    """Replace a feature table, or merge into it by key.

    With ``buckets`` the table is laid out by key, and a merge rewrites the touched buckets only; read it with
    :func:`feature_read`. Without, a merge reads the old table while the new one is written, so it goes to a second table, which
    then takes the first one's name; the old one is never overwritten by its own reader, and is dropped last.
    """
    if buckets:
        table = KeyedTable(name, (key,), buckets)
        if merge and table.exists(spark):
            table.merge(features)
        else:
            table.create(features)
    elif merge and spark.catalog.tableExists(name):
        save(upsert(load(spark, name), features, [key]), f"{name}_next")
        spark.sql(f"DROP TABLE IF EXISTS {name}_old")
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old")
        spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
        spark.sql(f"DROP TABLE {name}_old")
    else:
        save(features, name)


def feature_read(spark: SparkSession, name: str, key: str) -> DataFrame:
    return KeyedTable(name, (key,)).read(spark)


def feature_lookup(df: DataFrame, features: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return df.join(features.select(key, *names), key, "left")


def score_batch(model, df: DataFrame, features: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Look up the features of each key and apply a fitted pipeline."""
    return model.transform(feature_lookup(df, features, key, names))
