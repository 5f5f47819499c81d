"""Outlier correction and imputation of daily series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions.columns import day_code
from gridlytics.operators.forecast import with_fit
from gridlytics.operators.ranks import quantiles_of, ranked_values

# Fixed value: factor making the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def _window_limits(values: np.ndarray, w: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled median deviation of the frame ``[i-w, i+w)``, cut at the ends of the series."""
    n = len(values)
    median, limit = np.empty(n), np.empty(n)
    if n >= 2 * w:
        frames = np.lib.stride_tricks.sliding_window_view(values, 2 * w)
        inner = np.median(frames, axis=1)
        median[w : n - w + 1] = inner
        limit[w : n - w + 1] = np.median(np.abs(frames - inner[:, None]), axis=1)
        ends = [*range(w), *range(n - w + 1, n)]
    else:
        ends = range(n)
    for i in ends:
        frame = values[max(0, i - w) : min(n, i + w)]
        median[i] = np.median(frame)
        limit[i] = np.median(np.abs(frame - median[i]))
    return median, limit * scale


def _last_same_day(n: int, value: str) -> Column:
    """Sum of the last ``n`` values of the same station and weekday code, divided by ``n`` even when fewer exist.

    Partitioned by station and code below a window on the station: the rows are already in place.
    """
    same = Window.partitionBy("station", "day_code")
    return F.sum(F.when(F.col("_r") <= n, F.col(value))).over(same) / n


def correct_outliers_hampel(df: DataFrame, w: int = 100, n: int = 4, devs: float = 3.0, replacement: str = "weekday") -> DataFrame:
    """Hampel filter over the frame ``[i-w, i+w)``; an outlier becomes the last same-weekday mean or the window median.

    Spark's ``median`` takes no frame, and lists sorted per row cost twenty times as much as one numpy pass, so the
    two medians of a station's days come from an Arrow group; the calendar bounds its size.
    """
    if "day_code" not in df.columns:
        df = df.withColumn("day_code", day_code("date", "holiday"))
    df = df.fillna(0.0, subset=["volume"])
    scale = devs * MAD_SCALE

    def limits(table):
        table = table.sort_by("date")
        median, limit = _window_limits(table["volume"].to_numpy(), w, scale)
        return table.append_column("_median", pa.array(median)).append_column("_limit", pa.array(limit))

    schema = T.StructType([*df.schema.fields, T.StructField("_median", T.DoubleType()), T.StructField("_limit", T.DoubleType())])
    rows = df.groupBy("station").applyInArrow(limits, schema)
    outlier = F.abs(F.col("volume") - F.col("_median")) > F.col("_limit")
    if replacement == "weekday":
        rank = F.row_number().over(Window.partitionBy("station", "day_code").orderBy(F.col("date").desc()))
        rows = rows.withColumn("_r", rank).withColumn("_new", _last_same_day(n, "volume")).drop("_r")
    else:
        rows = rows.withColumn("_new", F.col("_median"))
    corrected = F.when(outlier, F.col("_new")).otherwise(F.col("volume"))
    return rows.withColumns({"outlier": outlier, "corrected": corrected}).drop("_median", "_limit", "_new")


def correct_outliers_mad(df: DataFrame, devs: float = 3.0) -> DataFrame:
    """Values further than ``devs`` scaled deviations from the median of their series become that median."""
    medians = quantiles_of(ranked_values(df, "volume", ["station"]), [0.5], ["station"])
    rows = df.join(medians.select("station", F.col("q")[0].alias("_m")), "station")
    rows = rows.withColumn("_d", F.abs(F.col("volume") - F.col("_m")))
    spreads = quantiles_of(ranked_values(rows, "_d", ["station"]), [0.5], ["station"])
    rows = rows.join(spreads.select("station", F.col("q")[0].alias("_s")), "station")
    outlier = F.col("_d") > devs * MAD_SCALE * F.col("_s")
    corrected = F.when(outlier, F.col("_m")).otherwise(F.col("volume"))
    return rows.withColumns({"outlier": outlier, "corrected": corrected}).drop("_m", "_d", "_s")


def correct_outliers_residual(df: DataFrame, k: float = 3.0, n: int = 4) -> DataFrame:
    """Values more than ``k`` residual deviations above the additive fit become the last same-weekday mean."""
    if "day_code" not in df.columns:
        df = df.withColumn("day_code", day_code("date", "holiday"))
    rows = with_fit(df, changepoint_scale=0.05, use_holidays=False).drop("trend", "lower", "upper")
    rows = rows.withColumn("residual", F.col("volume") - F.col("yhat"))
    limit = k * F.stddev_samp("residual").over(Window.partitionBy("station"))
    rank = F.row_number().over(Window.partitionBy("station", "day_code").orderBy(F.col("date").desc()))
    rows = rows.withColumn("outlier", F.col("residual") > limit).withColumn("_r", rank)
    corrected = F.when(F.col("outlier"), _last_same_day(n, "volume")).otherwise(F.col("volume"))
    return rows.withColumn("corrected", corrected).drop("_r")


def _block_deviation(deviation: np.ndarray, size: int) -> np.ma.MaskedArray:
    """Per row, the deviation of its block of ``size`` rows, the last row of all left out; masked where the block has no two rows."""
    starts = np.arange(0, len(deviation), size)
    rows = np.minimum(size, len(deviation) - starts)
    counted = rows.copy()
    counted[-1] -= 1
    squares = deviation * deviation
    squares[-1] = 0.0
    out = np.sqrt(np.add.reduceat(squares, starts) / np.maximum(counted - 1, 1))
    return np.ma.masked_array(np.repeat(out, rows), np.repeat(counted < 2, rows))


def correct_outliers_trend(df: DataFrame, n1: int = 30, n2: int = 15, k: float = 1.5, changepoint_scale: float = 0.5) -> DataFrame:
    """Values outside the fit's interval and beyond ``k`` block deviations, for both block sizes, become the trend (at least 0).

    Blocks hold ``n`` consecutive rows; the last row of a series lies outside its block, and a block's
    deviation divides by its rows less one.
    """

    def blocks(volume, fit):
        deviation = volume - fit["trend"]
        return {"deviation": deviation, "sd1": _block_deviation(deviation, n1), "sd2": _block_deviation(deviation, n2)}

    rows = with_fit(df, changepoint_scale, True, blocks, ["deviation", "sd1", "sd2"])
    outside = (F.col("volume") > F.col("upper")) | (F.col("volume") < F.col("lower"))
    size = F.abs(F.col("deviation"))
    outlier = F.coalesce(outside & (k * F.col("sd1") < size) & (k * F.col("sd2") < size), F.lit(False))
    corrected = F.when(outlier, F.greatest(F.col("trend"), F.lit(0.0))).otherwise(F.col("volume"))
    return rows.withColumns({"outlier": outlier, "corrected": corrected})


def impute_missing(df: DataFrame, n: int = 4) -> DataFrame:
    """Missing volumes become the mean of the last ``n`` known holidays, or same weekdays, of the station."""
    kind = F.when(F.col("holiday") == 1, F.lit(-1)).otherwise(F.weekday("date"))
    rows = df.withColumn("_k", kind)
    same = Window.partitionBy("station", "_k")
    rank = F.row_number().over(same.orderBy(F.col("volume").isNull(), F.col("date").desc()))
    rows = rows.withColumn("_r", rank)
    last = F.avg(F.when(F.col("_r") <= n, F.col("volume"))).over(same)
    return rows.withColumn("imputed", F.coalesce(F.col("volume"), last)).drop("_k", "_r")
