"""Exact ranks and quantiles without sending a whole group to one task.

``percentile``, ``mode`` and a global ``ORDER BY`` window gather every value of a group in one
place. Here equal values are counted first (so a hot value shrinks to one row before any shuffle),
the distinct values are cut into buckets by a rule that keeps their order, and a rank is the sum of
the sizes of the buckets below plus a running count inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two levels of cells, taken from the value's own binary digits: the exponent with four digits behind it, then twenty more.
# Neither depends on the other values, and both never decrease in the value, so values crowded around one point are
# told apart as well as those of a long tail.
_COARSE, _FINE, _OFFSET = 16, 1 << 20, 20_000


def _cells(value: Column) -> tuple[Column, Column]:
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    digits = (size / F.pow(F.lit(2.0), exponent) - 1) * _COARSE
    coarse = exponent * _COARSE + F.floor(digits) + _OFFSET
    fine = F.floor((digits - F.floor(digits)) * _FINE)
    sign = F.signum(value).cast("long")
    zero = (size == 0) | F.isnan(value)
    special = F.when(F.isnan(value), 1 << 40).otherwise(0)
    endless = F.when(size == float("inf"), 1 << 39)
    return (
        F.when(zero, special).otherwise(F.coalesce(endless, coarse) * sign),
        F.when(zero | endless.isNotNull(), 0).otherwise(fine * sign),
    )


def ranked_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-NULL values with ``n`` copies, ``below`` smaller rows and the group's ``total``."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    counted = rows.groupBy(*by, "value").agg(F.count("*").alias("n"))
    coarse, fine = _cells(F.col("value"))
    cells = counted.select(*by, "value", "n", coarse.alias("_w"), fine.alias("_g"))
    sizes = cells.groupBy(*by, "_w", "_g").agg(F.sum("n").alias("_size"))
    # At most some ten thousand coarse cells per group, whatever the number of rows; fine ones are added up inside one of them.
    steps = Window.partitionBy(*by) if by else Window.partitionBy()
    upto = lambda frame, order: F.sum("_size").over(frame.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    large = sizes.groupBy(*by, "_w").agg(F.sum("_size").alias("_size")).select(
        *by, "_w", (upto(steps, "_w") - F.col("_size")).alias("_below"), F.sum("_size").over(steps).alias("total")
    )
    small = sizes.select(*by, "_w", "_g", (upto(Window.partitionBy(*by, "_w"), "_g") - F.col("_size")).alias("_inside"))
    offsets = small.join(large, [*by, "_w"]).withColumn("_before", F.col("_below") + F.col("_inside"))
    inside = Window.partitionBy(*by, "_w", "_g").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(offsets.drop("_below", "_inside"), [*by, "_w", "_g"]).select(
        *by, "value", "n",
        (F.col("_before") + F.sum("n").over(inside) - F.col("n")).alias("below"),
        "total",
    )


def quantiles_of(ranked: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles ``q`` (an array, in the order asked) from :func:`ranked_values`."""

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    parts = []
    for i, p in enumerate(probabilities):
        place = (F.col("total") - 1) * F.lit(float(p))
        left = F.floor(place)
        parts += [
            at(left).alias(f"_a{i}"),
            at(F.least(left + 1, F.col("total") - 1)).alias(f"_b{i}"),
            F.max(place - left).alias(f"_t{i}"),
        ]
    picked = ranked.groupBy(*by).agg(*parts)
    values = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_t{i}") for i in range(len(probabilities))]
    return picked.select(*by, F.array(*values).alias("q"))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return quantiles_of(ranked_values(df, value, by), probabilities, by)


def mode_by(df: DataFrame, by: Sequence[str], value: str, alias: str = "mode") -> DataFrame:
    """Most frequent non-NULL value per group; the smallest value wins a tie.

    The copies are counted first, then one ``min`` over (minus count, value) picks the winner.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best.v").alias(alias))
