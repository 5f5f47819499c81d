"""Tables laid out by key bucket: a merge reads and rewrites the buckets its rows fall in, and leaves the files of all others alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.sources.merge import upsert
from gridlytics.sources.staging import staged

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table with at most one row per key, one folder per bucket of the key's hash.

    ``name`` is a catalog table, or a Parquet folder when it contains a slash. Choose ``buckets`` so that a bucket is a good file: a few
    hundred megabytes. Rows with a NULL key share a bucket and never match.

    A merge is a dynamic partition overwrite: the new buckets are written beside the table and take their places when the whole
    job has succeeded, so a job that fails leaves the table as it was. Places are taken one bucket after another; a driver lost
    in that moment leaves some buckets merged, and running the same merge again completes it.
    """

    name: str
    keys: tuple[str, ...]
    buckets: int = 64

    @property
    def is_path(self) -> bool:
        return "/" in self.name

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def exists(self, spark: SparkSession) -> bool:
        if not self.is_path:
            return spark.catalog.tableExists(self.name)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.name) if self.is_path else spark.table(self.name)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).drop(BUCKET)

    def create(self, df: DataFrame) -> None:
        """Write the table whole, in place of what was there."""
        writer = self.placed(df).repartition(self.buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET)
        # A catalog table keeps the option, so that later inserts into it replace single buckets.
        if self.is_path:
            writer.parquet(self.name)
        else:
            writer.option("partitionOverwriteMode", "dynamic").saveAsTable(self.name)

    def merge(self, updates: DataFrame, columns: Sequence[str] | None = None) -> list[int]:
        """Replace matched rows and insert the others, as :func:`~gridlytics.sources.merge.upsert`; the rewritten buckets.

        The updates are written once to the shared folder first: the buckets that are read must be those that are written.
        """
        spark = updates.sparkSession
        rows = staged(self.placed(updates))
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        if not touched:
            return touched
        old = self._rows(spark)
        merged = upsert(old.where(F.col(BUCKET).isin(touched)), rows.select(*old.columns), self.keys, columns)
        writer = merged.select(*old.columns).repartition(len(touched), BUCKET).write.mode("overwrite")
        if self.is_path:
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.name)
            spark.catalog.refreshByPath(self.name)
        else:
            writer.insertInto(self.name)
        return touched
