"""Row and column operators used by every job."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlytics.functions.columns import draw, flag, month_end, month_name, ratio, to_date, weekday_name


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def month_ends(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col(date) == F.last_day(date))


def trailing_months(df: DataFrame, date: str, n: int, as_of) -> DataFrame:
    """Rows from ``n`` months before the last closed month up to that close; literal bounds reach the scan."""
    close = month_end(as_of, -1)
    return df.filter(F.col(date).between(F.lit(month_end(close, -n)), F.lit(close)))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in an explicit order.

    Spark keeps the best row of each key per input task before the shuffle, so a hot key
    sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_rows(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All rows of the latest date of each key; ties are kept."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_snapshot(df: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date of the whole table, through a scalar subquery."""
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


def top_k(df: DataFrame, metric: str, k: int, desc: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    order = F.col(metric).desc() if desc else F.col(metric).asc()
    return df.orderBy(order, *ties).limit(k)


def nth_largest(df: DataFrame, metric: str, n: int = 2) -> DataFrame:
    """Rows holding the n-th largest value of a metric, counting duplicates, as ``nlargest`` does."""
    nth = df.select(metric).orderBy(F.col(metric).desc()).limit(n).agg(F.min(metric)).scalar()
    return df.filter(F.col(metric) == nth)


def running_sum(df: DataFrame, key: str, order: str, value: str, alias: str = "running") -> DataFrame:
    """Prefix sum per series. Rows are first added up per (key, order), so a window holds one row per step."""
    steps = df.groupBy(key, order).agg(F.sum(value).alias(value))
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(alias, F.sum(value).over(frame))


def except_keys(all_ids: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct ids found in none of the other frames."""
    out = all_ids.distinct()
    for other in others:
        out = out.join(other, all_ids.columns, "left_anti")
    return out


def split(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the keys: the same row always lands on the same side, also when a task is rerun."""
    point = draw(keys, seed) % 1_000_000 < int(share * 1_000_000)
    return df.filter(point), df.filter(~point)


def sample_cap(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows drawn by hash order of unique keys.

    A count per hash cell finds the cell where the n-th row lies; only that cell is ranked.
    """
    cells = 65_536
    hashed = df.withColumn("_h", draw(keys, seed))
    hashed = hashed.withColumn("_cell", F.pmod(F.col("_h"), F.lit(cells)))
    # One row per cell: a fixed bound, so an unpartitioned window is safe here.
    frame = Window.partitionBy().orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    sizes = hashed.groupBy("_cell").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(frame))
    edge = sizes.filter(F.col("_upto") <= n).agg(
        F.coalesce(F.max("_cell"), F.lit(-1)).alias("last"), F.coalesce(F.max("_upto"), F.lit(0)).alias("taken")
    )
    # The first cell that does not fit whole gives the remaining rows.
    partial = sizes.filter(F.col("_upto") > n).agg(F.coalesce(F.min("_cell"), F.lit(cells))).scalar()
    whole = hashed.filter(F.col("_cell") < partial)
    rest = Window.partitionBy("_cell").orderBy("_h", *keys)
    tail = (
        hashed.filter(F.col("_cell") == partial)
        .withColumn("_r", F.row_number().over(rest))
        .filter(F.col("_r") <= F.lit(n) - edge.select("taken").scalar())
        .drop("_r")
    )
    return whole.unionByName(tail).drop("_h", "_cell")


#: Ranges of (date, label) that labels are numbered in.
NUMBERING_PARTS = 64


def ordinal(df: DataFrame, col: str, order: str, alias: str | None = None, parts: int = NUMBERING_PARTS) -> DataFrame:
    """Code labels 0, 1, 2 … by first appearance in date order, name order within one date.

    Labels are dealt into ranges of (first date, label), numbered inside their range and shifted by the labels of earlier ranges. So
    labels that all appear first on one date are still numbered by many tasks. The ranges are cut at the quantiles of a hashed sample of
    some hundred labels a range, an array that one aggregate makes; the same labels give the same cuts.
    """
    alias = alias or f"{col}_code"
    first = df.groupBy(col).agg(F.min(order).alias("_first"))
    place = F.struct(F.col("_first"), F.col(col))
    every = F.floor(first.agg(F.count("*")).scalar() / (100 * parts)) + 1
    sample = first.where(F.col(col).isNotNull() & F.col("_first").isNotNull() & (F.pmod(F.xxhash64(col), every) == 0))
    known = sample.agg(F.sort_array(F.collect_list(place)).alias("_known")).select(
        F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.get("_known", F.floor(k * F.size("_known") / parts).cast("int")))
    )
    number = F.size(F.filter("_edges", lambda edge: edge <= place))
    ranged = first.withColumn("_edges", known.scalar()).withColumn("_range", number).drop("_edges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # one row per range: a fixed bound
    sizes = sizes.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_first", col))
    codes = ranged.join(F.broadcast(sizes), "_range").select(col, (F.col("_before") + inside - 1).alias(alias))
    return df.join(codes, col, "left")


def one_hot(df: DataFrame, categories: Mapping[str, Sequence]) -> DataFrame:
    """0/1 columns for declared categories; an unknown value gives all zeros."""
    dummies = {
        f"{col}_{value}": flag(F.col(col).cast("string") == F.lit(str(value)))
        for col, values in categories.items()
        for value in values
    }
    return df.withColumns(dummies).drop(*categories)


def ratios(df: DataFrame, numerators: Sequence[str], denominator: str, suffix: str = "", fill_with=None) -> DataFrame:
    return df.withColumns({f"ratio_{c}{suffix}": ratio(c, denominator, fill_with) for c in numerators})


def calendar_parts(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "month": F.month(d),
            "year": F.year(d),
            "month_year": F.concat_ws("-", F.month(d).cast("string"), F.year(d).cast("string")),
            "weekday_name": weekday_name(d),
            "month_name": month_name(d),
        }
    )


def positive_share(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of the known values of each group that are above zero, with their number."""
    known, above = F.count(value), F.count_if(F.col(value) > 0)
    return df.groupBy(*by).agg(known.alias("n"), F.try_divide(above, known).alias("positive_share"))


def sample(df: DataFrame, keys: Sequence[str], share: float, replace: bool = False, seed: int = 0) -> DataFrame:
    """Rows drawn by their keys: each with probability ``share``, or with ``replace`` as often as a Poisson law of that mean says.

    A row's number of copies depends on its keys alone, so a rerun task draws the same rows.
    """
    if not replace:
        return split(df, keys, share, seed)[0]
    point = draw(keys, seed) % 1_000_000 / 1_000_000
    steps, total, term, k = [], 0.0, math.exp(-share), 0
    while total < 1 - 1e-9:
        total += term
        steps.append(F.when(point >= total, 1).otherwise(0))
        k += 1
        term *= share / k
    copies = sum(steps[1:], steps[0])
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop("_copy")


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of NULLs; a single pass, then an unpivot of one row."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def class_share(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] by their global extremes; a constant column becomes 0.

    The extremes come from one aggregate read as scalar subqueries, not from an unpartitioned window.
    """
    limits = df.agg(*[f(c).alias(f"{name}_{c}") for c in cols for f, name in ((F.min, "lo"), (F.max, "hi"))])

    def scaled(c: str) -> Column:
        lo, hi = limits.select(f"lo_{c}").scalar(), limits.select(f"hi_{c}").scalar()
        value = F.coalesce(F.try_divide((F.col(c) - lo).cast("double"), (hi - lo).cast("double")), F.lit(0.0))
        return F.when(F.col(c).isNotNull(), value)

    return df.withColumns({c: scaled(c) for c in cols})


def since(df: DataFrame, date: str, start) -> DataFrame:
    return df.filter(F.col(date) >= F.lit(to_date(start)))
