"""Table scans and sinks. Filters and projections applied to a scan reach the files through Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def load(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, or a parquet path when the name contains a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def load_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """CSV with a declared schema: inference would read the whole input a second time."""
    return spark.read.options(header=True, **options).schema(schema).csv(path)


UNREADABLE = "_unreadable"


def load_csv_checked(spark: SparkSession, path: str, schema: StructType, **options) -> tuple[DataFrame, DataFrame]:
    """Readable rows of a CSV, and the lines that do not fit the schema, whole, as ``_unreadable``.

    A value that cannot be read, and a line with too few or too many fields, make a line unreadable; nothing is dropped silently.
    """
    marked = StructType([*schema.fields, StructField(UNREADABLE, StringType())])
    # Without all its columns a line cannot be judged: neither pruned to some, nor to the mark alone, which Spark refuses.
    reader = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=UNREADABLE, enforceSchema=True, columnPruning=False, **options)
    rows = reader.schema(marked).csv(path)
    every = F.xxhash64(*[F.col(f.name) for f in schema.fields]) >= F.lit(-(1 << 63))  # always so, but it reads them
    bad = rows.where(F.col(UNREADABLE).isNotNull() & every).select(UNREADABLE)
    return rows.where(F.col(UNREADABLE).isNull()).drop(UNREADABLE), bad


def append_batch(df: DataFrame, path: str, batch: str, batch_col: str = "batch") -> None:
    """Add the rows of one named batch to a history of Parquet files; running the same batch again replaces what it added.

    A batch is a folder of its own, so a repeated or half-finished run neither doubles rows nor touches other batches.
    """
    rows = df.withColumn(batch_col, F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(path)


def jdbc_predicates(column: str, bounds: Sequence) -> list[str]:
    """Disjoint conditions that cover every row, NULLs included: one connection each. ``bounds`` are ascending numbers, dates or texts."""
    if not bounds:
        return ["1 = 1"]
    literal = [str(b) if isinstance(b, (int, float)) else "'" + str(b).replace("'", "''") + "'" for b in bounds]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(literal, literal[1:])]
    return [f"{column} < {literal[0]} OR {column} IS NULL", *middle, f"{column} >= {literal[-1]}"]


def jdbc_options(
    url: str, query: str, column: str | None = None, lower=None, upper=None, parts: int = 1, fetch: int = 10_000, **options
) -> dict[str, str]:
    """Options of a warehouse scan; with a partition column and bounds it is read over ``parts`` connections.

    A query can be split only as a derived table, so it travels as one. Bounds say where the parts are cut, not which rows are read.
    """
    out = {"url": url, "fetchsize": str(fetch), **{k: str(v) for k, v in options.items()}}
    if column is None or parts < 2:
        return out | {"query": query}
    if lower is None or upper is None:
        raise ValueError("a split scan needs both bounds of its column")
    return out | {
        "dbtable": f"({query}) AS scanned", "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def load_jdbc(
    spark: SparkSession, url: str, query: str, column: str | None = None, lower=None, upper=None, parts: int = 1,
    predicates: Sequence[str] | None = None, **options,
) -> DataFrame:
    """A query answered by a warehouse; the predicate travels in the query text.

    ``column`` with bounds and ``parts``, or a list of ``predicates``, reads it over several connections at once, by as many tasks.
    """
    if predicates:
        return spark.read.jdbc(url, f"({query}) AS scanned", predicates=list(predicates), properties={k: str(v) for k, v in options.items()})
    return spark.read.format("jdbc").options(**jdbc_options(url, query, column, lower, upper, parts, **options)).load()


def run_sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """The answer to an SQL text; ``{name}`` in it stands for the frame given under that name, a view for this text alone."""
    return spark.sql(text, **views)


def save(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def save_jdbc(df: DataFrame, url: str, table: str, truncate: bool = True, properties: dict | None = None) -> None:
    """Replace the rows of a warehouse table and keep the table's own declaration."""
    df.write.option("truncate", str(truncate).lower()).jdbc(url, table, mode="overwrite", properties=properties or {})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project and cast to a declared schema, in its order; unreadable values become NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
