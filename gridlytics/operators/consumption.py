"""Consumption per product and period, and the accepted variation band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.functions.columns import to_date

# Method left out, method ranked last, its rank, and its stand-in date.
EXCLUDED_METHOD, LAST_METHOD, LAST_RANK, LAST_DATE = 4, 2, 8, "1900-01-01"


def period_consumption(calc: DataFrame) -> DataFrame:
    """Units of a product and billing period with the preferred method and its days.

    The preferred rows are picked by ``max`` of an ordering struct: they are partially aggregated
    like a sum, where a ranking window would bring all calculations of a product together.
    """
    method, day = F.col("method"), F.col("consumed_on")
    demoted = method == LAST_METHOD
    rank = F.when(demoted, LAST_RANK).otherwise(method)
    rank_day = F.when(demoted, F.lit(LAST_DATE).cast("date")).otherwise(day)
    newest = F.struct(rank_day.alias("a"), rank.alias("b"), method.alias("c"))
    best = F.struct((-rank).alias("a"), day.alias("b"), F.col("days").alias("c"))
    return calc.filter(method != EXCLUDED_METHOD).groupBy("product_id", "period_id").agg(
        F.sum("units").cast("decimal(22,2)").alias("units"),
        F.min("method").alias("min_method"),
        F.max(newest)["c"].alias("method"),
        F.max(best)["c"].alias("days"),
    )


def consumption_fact(calc: DataFrame, periods: DataFrame, closes: DataFrame, since="2022-01-01") -> DataFrame:
    """Volume per product, category and period, for products closed in the month of the period."""
    months = periods.filter(F.col("is_current") & (F.col("period_date") >= F.lit(to_date(since)))).select(
        "period_id", "period_date", F.last_day("period_date").alias("close_date")
    )
    holders = closes.filter((F.col("category") <= 2) & (F.col("close_date") == F.last_day("close_date"))).select(
        "product_id", "close_date", "category", "subcategory"
    )
    joined = period_consumption(calc).join(months, "period_id").join(holders, ["product_id", "close_date"])
    return joined.groupBy("product_id", "category", "subcategory", "period_date").agg(
        F.sum("units").cast("int").alias("volume")
    )


def avg_consumption(fact: DataFrame, lo, hi) -> DataFrame:
    """Average volume per product over the periods ``lo`` to ``hi``, both included."""
    window = F.col("period_date").between(F.lit(to_date(lo)), F.lit(to_date(hi)))
    return fact.filter(window & F.col("volume").isNotNull()).groupBy("product_id").agg(F.avg("volume").alias("average"))


def variations(fact: DataFrame, averages: DataFrame, period, category: int, cap: float = 5) -> DataFrame:
    """Relative variation, to two decimals, of a period against the product's average; values from ``cap`` up are dropped."""
    now = fact.filter(
        (F.col("period_date") == F.lit(to_date(period))) & (F.col("category") == category) & (F.col("volume") > 0)
    )
    base = averages.filter(F.col("average") > 0)
    change = F.round((F.col("volume") - F.col("average")) / F.col("average"), 2)
    return now.join(base, "product_id").select("product_id", change.alias("variation")).filter(F.col("variation") < cap)


def variation_band(fact: DataFrame, averages: DataFrame, period, category: int, k: float = 2, cap: float = 5) -> DataFrame:
    """Accepted band mean ± k·sd of the variations, in one row."""
    rows = variations(fact, averages, period, category, cap)
    out = rows.agg(F.count("*").alias("n"), F.avg("variation").alias("mean"), F.stddev_samp("variation").alias("sd"))
    return out.withColumns({"lower": F.col("mean") - k * F.col("sd"), "upper": F.col("mean") + k * F.col("sd")})
