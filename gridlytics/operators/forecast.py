"""Forecasts of daily series, their tuning, back tests and routing.

The mean models are windows and sums. Only the additive model runs in Python, one Arrow group
per station; a group is a daily series, so its size is bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions.columns import any_of, flag, percent_error, to_date
from gridlytics.operators.boosting import BINS, DEPTH, PATIENCE, RATE, TREES, fit_watched
from gridlytics.operators.relational import first_per_key
from gridlytics.operators.series import NEW
from gridlytics.operators.stats import grouped_ols
from gridlytics.sources.merge import upsert
from gridlytics.sources.staging import staged

# Number of trend changes and their share of the history, Fourier orders, prior scales of the
# published additive model, half-width of its 80 % interval, and the grid of trend flexibilities.
CHANGES, CHANGE_SHARE = 25, 0.8
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
SEASON_SCALE, HOLIDAY_SCALE, BASE_SCALE = 10.0, 10.0, 5.0
INTERVAL_Z = 1.2815515655446004
SEASON_BLOCK, SEASON_BLOCKS = 512, 64
SCALE_GRID = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0)
ADDITIVE, MEAN = "Prophet", "Media"


class _Seasons:
    """Fourier terms by day, weekly ones first: the same for all series, so those of one task share a table of the days they have met.

    The table holds blocks of consecutive days and starts anew when it is full.
    """

    def __init__(self):
        self.blocks: dict[int, np.ndarray] = {}

    @staticmethod
    def terms(days: np.ndarray) -> np.ndarray:
        out = []
        for period, order in ((7.0, WEEKLY_ORDER), (365.25, YEARLY_ORDER)):
            for k in range(1, order + 1):
                angle = 2 * np.pi * k * days / period
                out += [np.sin(angle), np.cos(angle)]
        return np.column_stack(out)

    def block(self, at: int) -> np.ndarray:
        if at not in self.blocks:
            if len(self.blocks) >= SEASON_BLOCKS:
                self.blocks.clear()
            self.blocks[at] = self.terms(np.arange(at * SEASON_BLOCK, (at + 1) * SEASON_BLOCK, dtype=float))
        return self.blocks[at]

    def write(self, days: np.ndarray, out: np.ndarray) -> None:
        """Put the terms of ascending days into ``out``, as many as it has columns; days too scattered for blocks get theirs alone."""
        width = out.shape[1]
        block = np.floor_divide(days, SEASON_BLOCK)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(days)]
        if (len(cuts) - 1) * SEASON_BLOCK > 4 * len(days) + 2 * SEASON_BLOCK or not np.all(np.isfinite(days)):
            out[:] = self.terms(days)[:, :width]
            return
        for start, end in zip(cuts, cuts[1:]):
            at = int(block[start])
            out[start:end] = self.block(at)[(days[start:end] - at * SEASON_BLOCK).astype(int), :width]


class _Basis:
    """Columns of the additive model for one series: linear trend with hinges, Fourier terms, holidays."""

    def __init__(self, days: np.ndarray, use_holidays: bool):
        self.start, self.span = float(days[0]), max(float(days[-1] - days[0]), 1.0)
        last = int(np.floor(len(days) * CHANGE_SHARE)) - 1
        count = max(min(CHANGES, last), 0)
        places = np.unique(np.linspace(0, max(last, 0), count + 1).round().astype(int))[1:]
        self.hinges = (days[places] - self.start) / self.span
        self.weekly, self.yearly, self.use_holidays = self.span >= 14, self.span >= 730, use_holidays

    def columns(self, days: np.ndarray, holiday: np.ndarray, seasons: _Seasons | None = None) -> tuple[np.ndarray, int]:
        t = (days - self.start) / self.span
        lead, waves = 2 + len(self.hinges), 2 * (WEEKLY_ORDER * self.weekly + YEARLY_ORDER * self.yearly)
        out = np.empty((len(days), lead + waves + self.use_holidays))
        out[:, 0], out[:, 1] = 1.0, t
        np.maximum(t[:, None] - self.hinges, 0.0, out=out[:, 2:lead])
        if waves and seasons is not None:
            seasons.write(days, out[:, lead : lead + waves])
        elif waves:
            out[:, lead : lead + waves] = _Seasons.terms(days)[:, :waves]
        if self.use_holidays:
            out[:, -1] = holiday
        return out, lead

    def penalty(self, width: int, scale: float) -> np.ndarray:
        sizes = np.full(width, SEASON_SCALE)
        sizes[:2] = BASE_SCALE
        sizes[2 : 2 + len(self.hinges)] = scale
        if self.use_holidays:
            sizes[-1] = HOLIDAY_SCALE
        return 1.0 / sizes**2


def _noise(gram: np.ndarray, cross: np.ndarray, square: float, weight: float) -> float:
    """Noise variance from a weakly penalised fit."""
    loose = np.linalg.solve(gram + 1e-6 * weight * np.eye(len(cross)), cross)
    return max((square - 2 * loose @ cross + loose @ gram @ loose) / max(weight - 2, 1.0), 1e-8)


def _ridge(gram: np.ndarray, cross: np.ndarray, square: float, weight: float, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance of the penalised fit."""
    beta = np.linalg.solve(gram + _noise(gram, cross, square, weight) * np.diag(penalty), cross)
    left = max((square - 2 * beta @ cross + beta @ gram @ beta) / max(weight - 2, 1.0), 0.0)
    return beta, left


def _numbers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    weights = pdf["weight"].to_numpy(float) if "weight" in pdf else np.ones(len(pdf))
    return pdf["day"].to_numpy(float), pdf["volume"].to_numpy(float), pdf["holiday"].to_numpy(float), weights


def _fit(
    days: np.ndarray, y: np.ndarray, holiday: np.ndarray, weights: np.ndarray | None, scale: float, use_holidays: bool,
    seasons: _Seasons | None = None,
) -> tuple[_Basis, np.ndarray, int, np.ndarray, float]:
    """The basis, its columns and how many of them are trend, the coefficients, and the half-width of the interval, of ascending days."""
    unit = float(np.max(np.abs(y))) or 1.0
    basis = _Basis(days, use_holidays)
    x, lead = basis.columns(days, holiday, seasons)
    z = y / unit
    if weights is None:
        gram, cross, square, weight = x.T @ x, x.T @ z, float(z @ z), float(len(z))
    else:
        weighted = x * weights[:, None]
        gram, cross, square, weight = x.T @ weighted, weighted.T @ z, float(z @ (weights * z)), weights.sum()
    beta, left = _ridge(gram, cross, square, weight, basis.penalty(x.shape[1], scale))
    return basis, x, lead, beta * unit, INTERVAL_Z * np.sqrt(left) * unit


def _predict(
    pdf: pd.DataFrame, scale: float, use_holidays: bool, horizon: int, history: bool, seasons: _Seasons | None = None
) -> pd.DataFrame:
    """Trend, fit and 80 % interval for the history and/or the days after it."""
    pdf = pdf.dropna(subset=["volume"]).sort_values("day")
    days, y, holiday, weights = _numbers(pdf)
    basis, x, lead, beta, width = _fit(days, y, holiday, weights if "weight" in pdf else None, scale, use_holidays, seasons)
    target, future = days[:0], x[:0]
    if horizon:
        target = days[-1] + np.arange(1, horizon + 1)
        future, _ = basis.columns(target, np.zeros(horizon), seasons)
    if history:
        target, future = np.concatenate([days, target]), np.vstack([x, future]) if horizon else x
    fit, trend = future @ beta, future[:, :lead] @ beta[:lead]
    return pd.DataFrame({"day": target.astype("int32"), "trend": trend, "yhat": fit, "lower": fit - width, "upper": fit + width})


# Dates travel to Python and back as day numbers: plain integers, not date objects.
_FITTED = ("trend", "yhat", "lower", "upper")
_FIT = "day int, trend double, yhat double, lower double, upper double"


def _dated(df: DataFrame) -> DataFrame:
    """Turn the day number back into a date, in place."""
    cols = [F.date_from_unix_date("day").alias("date") if c == "day" else F.col(c) for c in df.columns]
    return df.select(*cols)


def _model_rows(df: DataFrame) -> DataFrame:
    holiday = F.col("holiday") if "holiday" in df.columns else F.lit(0).alias("holiday")
    return df.select("station", F.unix_date("date").alias("day"), F.col("volume").cast("double").alias("volume"), holiday)


def fitted_series(df: DataFrame, changepoint_scale: float = 0.05, use_holidays: bool = True) -> DataFrame:
    """In-sample trend, fit and interval of the additive model per station."""
    seasons = _Seasons()

    def fit(key, pdf):
        out = _predict(pdf, changepoint_scale, use_holidays, 0, True, seasons)
        out.insert(0, "station", key[0])
        return out

    return _dated(_model_rows(df).groupBy("station").applyInPandas(fit, f"station {dict(df.dtypes)['station']}, {_FIT}"))


def with_fit(
    df: DataFrame, changepoint_scale: float = 0.05, use_holidays: bool = True,
    more: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None, names: Sequence[str] = (),
) -> DataFrame:
    """The rows that have a volume, all columns, with trend, fit and interval of their station's additive model.

    The columns pass through the group, so the series is neither read nor shuffled a second time to meet its fit. ``more`` makes further
    columns, the doubles ``names``, from a station's volumes by day and its fit: Spark does not know that the rows a group returns still
    lie by station, and a window on them would shuffle and sort them all again.
    """
    holiday = F.col("holiday") if "holiday" in df.columns else F.lit(0)
    rows = df.withColumns({"_day": F.unix_date("date"), "_holiday": holiday.cast("double")})
    seasons, added = _Seasons(), (*_FITTED, *names)

    def fit(table: pa.Table) -> pa.Table:
        if table["volume"].null_count:
            table = table.filter(pc.is_valid(table["volume"]))
        columns = {name: [] for name in added}
        if table.num_rows:
            days = table["_day"].to_numpy().astype(float)
            if not np.all(days[1:] >= days[:-1]):
                table = table.sort_by("_day")
                days = table["_day"].to_numpy().astype(float)
            y = table["volume"].cast(pa.float64(), safe=False).to_numpy()
            _, x, lead, beta, width = _fit(days, y, table["_holiday"].to_numpy(), None, changepoint_scale, use_holidays, seasons)
            yhat = x @ beta
            columns = {"trend": x[:, :lead] @ beta[:lead], "yhat": yhat, "lower": yhat - width, "upper": yhat + width}
            if more is not None:
                columns |= more(y, columns)
        table = table.drop_columns(["_day", "_holiday"])
        for name in added:
            table = table.append_column(name, pa.array(columns[name], pa.float64()))
        return table

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in added)])
    return rows.groupBy("station").applyInArrow(fit, schema)


def additive_forecast(df: DataFrame, horizon: int = 1, scales: DataFrame | None = None, changepoint_scale: float = 0.05) -> DataFrame:
    """Forecast of the days after each series; negatives become 0; a series that cannot be fitted gives NULL.

    ``scales`` (station, changepoint_scale) holds the tuned flexibility of each station.
    """
    cols = _model_rows(df)
    if scales is None:
        cols = cols.withColumn("scale", F.lit(float(changepoint_scale)))
    else:
        tuned = scales.select("station", F.col("changepoint_scale").alias("scale"))
        cols = cols.join(tuned, "station", "left").fillna(float(changepoint_scale), subset=["scale"])
    seasons = _Seasons()

    def forecast(key, pdf):
        try:
            out = _predict(pdf, float(pdf["scale"].iloc[0]), True, horizon, False, seasons)
            out = pd.DataFrame({"day": out["day"], "prediction": out["yhat"].clip(lower=0.0)})
        except (np.linalg.LinAlgError, IndexError, ValueError):
            out = pd.DataFrame({"day": [int(pdf["day"].max()) + 1], "prediction": [None]})
        out.insert(0, "station", key[0])
        out.insert(1, "model", ADDITIVE)
        return out

    kind = dict(df.dtypes)["station"]
    return _dated(cols.groupBy("station").applyInPandas(forecast, f"station {kind}, model string, day int, prediction double"))


class _Cutoffs:
    """Normal equations of the additive model for every prefix of one series, each with trend changes placed for that prefix.

    Seasonal columns do not depend on the prefix; a hinge is zero up to its day and linear after it. So all cross products come
    from running sums of 1, the day, its square, the seasonal columns and their products with the day and the volume: a
    prefix costs a few subtractions, not another pass over its rows.
    """

    def __init__(self, days: np.ndarray, y: np.ndarray, holiday: np.ndarray):
        self.days, self.y = days, y
        self.whole = max(float(days[-1] - days[0]), 1.0)
        self.u = (days - days[0]) / self.whole
        season = [np.zeros((len(days), 0))]
        for period, order in ((7.0, WEEKLY_ORDER), (365.25, YEARLY_ORDER)):
            angle = 2 * np.pi * np.outer(days, np.arange(1, order + 1)) / period
            season.append(np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(days), 2 * order))
        self.season = np.column_stack([*season, holiday])
        fixed = np.column_stack([np.ones_like(self.u), self.u, self.season])
        running = lambda x: np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        # Columns: 1, u, seasons, then y; and the same times u.
        self.sums = running(np.column_stack([fixed, y]))
        self.with_u = running(np.column_stack([fixed, y]) * self.u[:, None])
        self.fixed, self.done = fixed, 0
        self.inner, self.inner_y = np.zeros((fixed.shape[1],) * 2), np.zeros(self.season.shape[1])

    def kept(self, basis: _Basis) -> np.ndarray:
        """Which seasonal columns a prefix of this span has."""
        return np.array([basis.weekly] * (2 * WEEKLY_ORDER) + [basis.yearly] * (2 * YEARLY_ORDER) + [True])

    def equations(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Basis]:
        """Gram matrix and cross products of the first `n` rows, the model's columns of row `n`, and the basis; `n` must not fall from
        call to call."""
        new, self.done = slice(self.done, n), n
        self.inner += self.fixed[new].T @ self.fixed[new]
        self.inner_y += self.season[new].T @ self.y[new]
        basis = _Basis(self.days[:n], True)
        places = np.searchsorted(self.days[:n], basis.start + basis.hinges * basis.span - 0.5)
        stretch, at = self.whole / basis.span, self.u[places]
        seasons = 2 + np.flatnonzero(self.kept(basis))
        columns = np.concatenate([[0, 1], seasons])
        # Sums over the rows after each hinge's place.
        after, after_u = (x[n] - x[places + 1] for x in (self.sums, self.with_u))
        hinge = after_u - at[:, None] * after  # with 1, u, seasons, y
        later = np.maximum(np.arange(len(at))[:, None], np.arange(len(at))[None, :])
        both = after_u[later, 1] - (at[:, None] + at[None, :]) * after[later, 1] + np.outer(at, at) * after[later, 0]
        inner = self.inner[np.ix_(columns, columns)]
        k = len(at)
        order = np.concatenate([[0, 1], np.arange(len(columns), len(columns) + k), np.arange(2, len(columns))])
        gram = np.block([[inner, hinge[:, columns].T], [hinge[:, columns], both]])[np.ix_(order, order)]
        cross = np.concatenate([self.sums[n, -1:], self.with_u[n, -1:], self.inner_y[seasons - 2], hinge[:, -1]])[order]
        row = np.concatenate([self.fixed[n, columns], np.maximum(self.u[n] - at, 0.0)])[order] if n < len(self.u) else None
        scale = np.ones(len(order))
        scale[1 : 2 + k] = stretch  # the trend runs over the prefix, not over the whole series
        return gram * np.outer(scale, scale), cross * scale, None if row is None else row * scale, basis


def _tuning(days: np.ndarray, y: np.ndarray, holiday: np.ndarray, grid: Sequence[float], cutoffs: int) -> np.ndarray:
    """One-day forecasts of the last `cutoffs` days by every flexibility: grid by cutoff."""
    train, all_cutoffs = len(days) - cutoffs, _Cutoffs(days, y, holiday)
    predicted = np.zeros((len(grid), cutoffs))
    top, squares = np.maximum.accumulate(np.abs(y)), np.cumsum(y**2)
    for step in range(cutoffs):
        n = train + step
        gram, cross, row, basis = all_cutoffs.equations(n)
        unit = float(top[n - 1]) or 1.0
        cross, square = cross / unit, float(squares[n - 1]) / unit**2
        noise = _noise(gram, cross, square, float(n))
        predicted[:, step] = _by_scale(gram, cross, row, basis, noise, grid) * unit
    return predicted


def _by_scale(gram: np.ndarray, cross: np.ndarray, row: np.ndarray, basis: _Basis, noise: float, grid: Sequence[float]) -> np.ndarray:
    """The penalised fit's value at a row for every flexibility.

    Flexibilities differ in the hinges' penalty alone, the same for all hinges. So the other columns are eliminated once, and in the axes
    of what is left for the hinges every flexibility is a division.
    """
    k = len(basis.hinges)
    hinge, rest = slice(2, 2 + k), np.r_[0:2, 2 + k : len(cross)]
    penalty = basis.penalty(len(cross), 1.0)[rest]
    solved = np.linalg.solve(gram[np.ix_(rest, rest)] + noise * np.diag(penalty), np.column_stack([gram[rest, hinge], cross[rest]]))
    onto, plain = solved[:, :-1], solved[:, -1]
    left = gram[hinge, hinge] - gram[hinge, rest] @ onto
    sizes, axes = np.linalg.eigh((left + left.T) / 2)
    along, effect = axes.T @ (cross[hinge] - gram[hinge, rest] @ plain), axes.T @ (row[hinge] - onto.T @ row[rest])
    scales = np.asarray(grid, float)[:, None]
    return row[rest] @ plain + (along * effect / (np.maximum(sizes, 0.0) + noise / scales**2)).sum(axis=1)


def tune_forecast(df: DataFrame, grid: Sequence[float] = SCALE_GRID, cutoffs: int = 30) -> DataFrame:
    """Trend flexibility with the least error over one-day forecasts from the last ``cutoffs`` days.

    At each cutoff the trend changes are placed anew over the days before it, as a fit on those days alone would place them. All
    cutoffs and grid points of a station share the running sums of one pass over its days; what is left are small solves.
    """
    grid = [float(g) for g in grid]

    def tune(key, pdf):
        pdf = pdf.dropna(subset=["volume"]).sort_values("day")
        row = {"station": key[0], "changepoint_scale": None, "rmse": None, "share5": None, "share10": None, "share15": None}
        if len(pdf) > cutoffs + 2:
            days, y, holiday, _ = _numbers(pdf)
            predicted, actual = _tuning(days, y, holiday, grid, cutoffs), y[len(days) - cutoffs :]
            rmse = np.sqrt(np.mean((predicted - actual) ** 2, axis=1))
            best = int(np.argmin(rmse))
            with np.errstate(divide="ignore", invalid="ignore"):
                error = np.abs(predicted[best] - actual) / actual
            row.update(changepoint_scale=grid[best], rmse=float(rmse[best]))
            row.update({f"share{p}": float(np.mean(error < p / 100)) for p in (5, 10, 15)})
        return pd.DataFrame([row])

    kind = dict(df.dtypes)["station"]
    return _model_rows(df).groupBy("station").applyInPandas(
        tune, f"station {kind}, changepoint_scale double, rmse double, share5 double, share10 double, share15 double"
    )


def category_forecast(
    df: DataFrame, categories: Sequence[str], date: str = "close_date", value: str = "amount", horizon: int = 60
) -> DataFrame:
    """Additive fit and forecast per value of each category column.

    Rows of one category and day are replaced by their mean with their count as weight, which gives the same
    least squares; so a category holding most of the rows still reaches Python as one row per day.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("category")) for c in categories])
    long = df.select(F.explode(entries).alias("c"), F.col(date).alias("date"), F.col(value).cast("double").alias("volume"))
    points = long.groupBy("c.kind", "c.category", F.unix_date("date").alias("day")).agg(
        F.avg("volume").alias("volume"), F.count("volume").cast("double").alias("weight")
    ).withColumn("holiday", F.lit(0))

    def fit(key, pdf):
        out = _predict(pdf, 0.05, False, horizon, True)
        out.insert(0, "kind", key[0])
        out.insert(1, "category", key[1])
        return out

    return _dated(points.groupBy("kind", "category").applyInPandas(fit, f"kind string, category string, {_FIT}"))


def _mean_features(df: DataFrame, n: int, last: int) -> DataFrame:
    """Per day: mean of the last ``n`` same weekdays, of the last ``n`` holidays, and of the week to date; right for the ``last`` days.

    All windows start with the station, so they share one shuffle. The week to date is the last ``weekday + 1`` rows,
    read as lags of the same sorted rows instead of a window of its own; ``back`` counts days from the end.

    The means of the ``last`` days reach ``last + n - 1`` same weekdays and holidays back. How many of its kind come after a row is the
    kind's count less a running count in the order that the lags have anyway; the rows further back are dropped before their sorts.
    """
    same = Window.partitionBy("station", "weekday").orderBy("date").rowsBetween(-(n - 1), 0)
    feast = Window.partitionBy("station", "holiday").orderBy("date").rowsBetween(-(n - 1), 0)
    order = Window.partitionBy("station").orderBy("date")
    whole = Window.partitionBy("station")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lags = {f"_lag{k}": F.when(F.col("weekday") >= k, F.lag("volume", k).over(order)) for k in range(1, 7)}
    kinds = {f"_day{k}": F.col("weekday") == k for k in range(7)} | {"_feast": F.col("holiday") == 1}
    after = {name: F.count_if(kind).over(whole) - F.count_if(kind).over(running) for name, kind in kinds.items()}
    rows = df.withColumns({
        "target": F.lead("volume").over(order), "target_date": F.lead("date").over(order),
        "back": F.count("*").over(whole) - F.row_number().over(order) + 1, **lags, **after,
    })
    near = [kind & (F.col(name) < last + n - 1) for name, kind in kinds.items()]
    known = F.col("weekday").between(0, 6) & F.col("date").isNotNull()
    rows = rows.filter((F.col("back") <= last) | ~F.coalesce(known, F.lit(False)) | F.coalesce(any_of(near), F.lit(False))).drop(*kinds)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in lags), F.col("volume"))
    count = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in lags), F.lit(1))
    rows = rows.withColumn("week_to_date", total / count).drop(*lags)
    rows = rows.withColumn("same_day", F.avg("volume").over(same))
    return rows.withColumn("holiday_mean", F.when(F.col("holiday") == 1, F.avg("volume").over(feast)))


def _mean_prediction(w1: Column, w2: Column) -> Column:
    """New stations: weekday mean; after a holiday: holiday mean; otherwise the weighted pair, halved."""
    pair = (F.col("same_day") * w1 + F.col("week_to_date") * w2) / 2
    return F.when(F.col("state") == NEW, F.col("same_day")).when(F.col("holiday") == 1, F.col("holiday_mean")).otherwise(pair)


def recent_features(df: DataFrame, history: int = 15, n: int = 4) -> DataFrame:
    """Features of the last ``history`` days that have a following day."""
    return _mean_features(df, n, history + 1).filter(F.col("back").between(2, history + 1))


def mean_forecast(df: DataFrame, weights: DataFrame, n: int = 4) -> DataFrame:
    """Next-day forecast of the mean model; the weekday is that of the last observed day. Negatives become 0."""
    last = _mean_features(df, n, 1).filter(F.col("target_date").isNull())
    rows = last.join(weights.select("station", "w1", "w2"), "station", "left")
    prediction = F.greatest(_mean_prediction(F.col("w1"), F.col("w2")), F.lit(0.0))
    value = F.when(_mean_prediction(F.col("w1"), F.col("w2")).isNotNull(), prediction)
    return rows.select("station", F.lit(MEAN).alias("model"), F.date_add("date", 1).alias("date"), value.alias("prediction"))


def fit_mean_weights(df: DataFrame, history: int = 15, n: int = 4) -> DataFrame:
    """Weights minimising the squared error of the last ``history`` one-day forecasts, per station.

    The loss is quadratic, so five sums give the minimum; where the sums are collinear the solution nearest to the
    start (0.5, 0.5) is taken. Stations with too short a history get NULL weights.
    """
    return mean_weights(recent_features(df, history, n), history)


def _weight_sums() -> dict[str, Column]:
    """What the weights of a station need of its rows, as aggregates."""
    free = (F.col("state") != NEW) & (F.col("holiday") == 0)
    a, b = F.when(free, F.col("same_day") / 2), F.when(free, F.col("week_to_date") / 2)
    y = F.col("target")
    fixed = F.when(~free, F.pow(_mean_prediction(F.lit(0.0), F.lit(0.0)) - y, 2))
    terms = {
        "aa": a * a, "ab": a * b, "bb": b * b, "ay": a * y, "by": b * y, "yy": F.when(a.isNotNull(), y * y), "rest": fixed,
    }
    return {"days": F.count("*")} | {name: F.sum(e) for name, e in terms.items()}


def _with_weights(sums: DataFrame, history: int) -> DataFrame:
    """Add `w1`, `w2` and `rmse` in place of the sums."""
    terms = list(_weight_sums())[1:]
    sums = sums.fillna(0.0, subset=terms)
    aa, ab, bb, ay, by = (F.col(c) for c in ("aa", "ab", "bb", "ay", "by"))
    det, trace = aa * bb - ab * ab, aa + bb
    # Residual gradient at the start, used when the pair is collinear.
    ga, gb = ay - (aa + ab) / 2, by - (ab + bb) / 2
    regular = det > 1e-9 * trace * trace
    flat1 = 0.5 + F.coalesce(F.try_divide(aa * ga + ab * gb, trace * trace), F.lit(0.0))
    flat2 = 0.5 + F.coalesce(F.try_divide(ab * ga + bb * gb, trace * trace), F.lit(0.0))
    out = sums.withColumns({
        "w1": F.when(regular, F.try_divide(bb * ay - ab * by, det)).otherwise(flat1),
        "w2": F.when(regular, F.try_divide(aa * by - ab * ay, det)).otherwise(flat2),
    })
    w1, w2 = F.col("w1"), F.col("w2")
    loss = F.col("yy") - 2 * (w1 * ay + w2 * by) + w1 * w1 * aa + 2 * w1 * w2 * ab + w2 * w2 * bb + F.col("rest")
    known = F.col("days") == history
    rmse = F.sqrt(F.greatest(loss, F.lit(0.0)) / history)
    return out.withColumns({name: F.when(known, c) for name, c in (("rmse", rmse), ("w1", w1), ("w2", w2))}).drop("days", *terms)


def mean_weights(rows: DataFrame, history: int = 15) -> DataFrame:
    """:func:`fit_mean_weights` from :func:`recent_features`."""
    sums = rows.groupBy("station").agg(*[e.alias(name) for name, e in _weight_sums().items()])
    return _with_weights(sums, history).select("station", "w1", "w2", "rmse")


def backtest(df: DataFrame, weights: DataFrame | None = None, history: int = 15, n: int = 4) -> DataFrame:
    """One-day forecasts of the last ``history`` days with their relative errors.

    Without ``weights`` they are fitted on the same days: their sums are windows over the station, by which the rows
    already lie together, so there is neither a second reading nor a join.
    """
    rows = recent_features(df, history, n)
    if weights is None:
        whole = Window.partitionBy("station")
        rows = _with_weights(rows.withColumns({name: e.over(whole) for name, e in _weight_sums().items()}), history)
    else:
        rows = rows.join(weights.select("station", "w1", "w2"), "station")
    raw = _mean_prediction(F.col("w1"), F.col("w2"))
    rows = rows.withColumn("prediction", F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0))))
    return rows.select(
        "station", "date", "target_date", F.col("target").alias("actual"), "prediction",
        percent_error("prediction", "target").alias("error"),
    )


def backtest_summary(backtested: DataFrame) -> DataFrame:
    """RMSE and shares of days with an error under 5, 10 and 15 %."""
    square = F.pow(F.col("prediction") - F.col("actual"), 2)
    return backtested.groupBy("station").agg(
        F.sqrt(F.avg(square)).alias("rmse"),
        *[F.avg(flag(F.col("error") < p / 100).cast("double")).alias(f"share{p}") for p in (5, 10, 15)],
    )


def simple_mean_forecast(df: DataFrame, states: DataFrame, as_of, last: int = 10) -> DataFrame:
    """New stations: mean of all days; inactive: 0; active: mean of the last ``last`` days."""
    rank = F.row_number().over(Window.partitionBy("station").orderBy(F.col("date").desc()))
    means = df.withColumn("_r", rank).groupBy("station").agg(
        F.avg("volume").alias("_all"), F.avg(F.when(F.col("_r") <= last, F.col("volume"))).alias("_last")
    )
    state = F.col("state")
    value = F.when(state == "Nueva", F.col("_all")).when(state == "Inactiva", 0.0).when(state == "Activa", F.col("_last"))
    day = to_date(as_of) + dt.timedelta(days=1)
    return means.join(states.select("station", "state"), "station").select(
        "station", F.lit(day).alias("date"), value.alias("prediction"), F.lit("Media Movil").alias("model"), "state"
    )


def tuning_dates(tuning: DataFrame) -> tuple[Column, Column]:
    """Latest and second latest tuning dates as scalar subqueries."""
    latest = tuning.agg(F.max("registered_at")).scalar()
    earlier = tuning.filter(F.col("registered_at") < latest).agg(
        F.coalesce(F.max("registered_at"), F.lit("1900-01-01").cast("date"))
    )
    return latest, earlier.scalar()


def route_models(
    mean: DataFrame, additive: DataFrame, tuning: DataFrame, states: DataFrame, results: DataFrame, limit: float = 0.4
) -> DataFrame:
    """Prediction served for each station at the latest tuning date and, as served then, at the one before.

    New stations and those whose share of days under 15 % error is below ``limit`` get the mean model; a station whose
    tuning failed has no share and counts as below. Semi and anti joins replace collected id lists.
    """
    latest, earlier = tuning_dates(tuning)
    bad = tuning.filter(F.col("is_current") & (F.coalesce(F.col("share15"), F.lit(-1.0)) < limit)).select("station")
    fresh = states.filter(F.col("is_current") & (F.col("state") == NEW)).select("station")
    averaged = bad.unionByName(fresh).distinct()
    now = additive.filter(F.col("date") == latest).join(averaged, "station", "left_anti").unionByName(
        mean.filter(F.col("date") == latest).join(averaged, "station", "left_semi")
    )
    out = now
    for served, model in ((additive, ADDITIVE), (mean, MEAN)):
        before = results.filter((F.col("date") == earlier) & (F.col("model") == model)).select("station")
        out = out.unionByName(served.filter(F.col("date") == earlier).join(before, "station", "left_semi"))
    return out


def forecast_results(predictions: DataFrame, actual: DataFrame, stations: DataFrame, since=None) -> DataFrame:
    """Predictions with station attributes, actual volume and relative error."""
    rows = predictions if since is None else predictions.filter(F.col("date") >= F.lit(to_date(since)))
    rows = rows.join(stations, "station", "left")
    rows = rows.join(actual.select("station", "date", "volume"), ["station", "date"], "left")
    return rows.withColumn("error", percent_error("prediction", "volume"))


def update_results(results: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(results, new.select(*results.columns), ["station", "date"])


def choose_best(predictions: DataFrame, as_of) -> DataFrame:
    """Model with the least absolute error per station for the next day; a failed model has no error and comes last."""
    day = to_date(as_of) + dt.timedelta(days=1)
    error = F.when(F.col("abs_error") >= 0, F.col("abs_error"))
    rows = predictions.filter(F.col("date") == F.lit(day)).withColumn("abs_error", error)
    return first_per_key(rows, ["station"], [F.col("abs_error").asc_nulls_last(), F.col("model")])


def compare_models(predictions: DataFrame, limit: float | None = None) -> DataFrame:
    """MAE, difference and percentage error of the first day, per station and model, to two decimals."""
    error = F.abs(F.col("actual") - F.col("prediction"))
    first = F.min(F.struct("date", error.alias("error"), percent_error("actual", "prediction").alias("share")))
    out = predictions.groupBy("station", "model").agg(F.avg(error).alias("mae"), first.alias("f")).select(
        "station", "model", F.round("mae", 2).alias("mae"), F.round("f.error", 2).alias("first_day_difference"),
        F.round(F.abs(F.col("f.share")) * 100, 2).alias("first_day_error"),
    )
    return out if limit is None else out.filter(F.col("first_day_error") <= limit)


def ar_forecast(df: DataFrame, p: int = 5, d: int = 1) -> DataFrame:
    """Autoregression of order ``p`` on the ``d`` times differenced series; next-day forecast per station.

    The coefficients come from grouped sums; a forecast is an expression over the last row of a station.
    """
    order = Window.partitionBy("station").orderBy("date")
    rows = df.select("station", "date", F.col("volume").alias("y0"))
    for i in range(d):
        rows = rows.withColumn(f"y{i + 1}", F.col(f"y{i}") - F.lag(f"y{i}").over(order))
    level = f"y{d}"
    rows = rows.withColumns({f"lag{k}": F.lag(level, k).over(order) for k in range(1, p + 1)})
    fit = grouped_ols(rows.select("station", level, *[f"lag{k}" for k in range(1, p + 1)]), ["station"], [f"lag{k}" for k in range(1, p + 1)], level)
    last = first_per_key(rows, ["station"], [F.col("date").desc()])
    out = last.join(fit, "station")
    # The next difference uses the latest p differences, that is this row's level and its first p-1 lags.
    inputs = [F.col(level), *[F.col(f"lag{k}") for k in range(1, p)]]
    step = F.col("coefficients")[p]
    for k, value in enumerate(inputs):
        step = step + F.col("coefficients")[k] * value
    for i in range(d):
        step = step + F.col(f"y{i}")
    return out.select("station", F.lit("ARIMA").alias("model"), F.date_add("date", 1).alias("date"), step.alias("prediction"))


def _least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients with the intercept last; the smallest ones where columns are collinear."""
    middle, mean = x.mean(axis=0), y.mean()
    beta = np.linalg.lstsq(x - middle, y - mean, rcond=1e-10)[0]
    return np.append(beta, mean - middle @ beta)


def _lags(z: np.ndarray, n: int, first: int) -> np.ndarray:
    """The `n` values before each of z[first:]."""
    return np.stack([z[first - k : len(z) - k] for k in range(1, n + 1)], axis=1) if n else np.zeros((len(z) - first, 0))


def _arma(y: np.ndarray, p: int, d: int, q: int, long: int) -> tuple[float, np.ndarray] | None:
    """The next value of a series and the coefficients: autoregressive, moving average, intercept."""
    z = np.diff(y, d)
    if len(z) <= max(long + q, p):
        return None
    shocks = z[long:] - np.column_stack([_lags(z, long, long), np.ones(len(z) - long)]) @ _least_squares(_lags(z, long, long), z[long:])
    shocks = np.concatenate([np.zeros(long), shocks])
    first = max(long + q, p)
    beta = _least_squares(np.column_stack([_lags(z, p, first), _lags(shocks, q, first)]), z[first:])
    step = beta[:p] @ z[::-1][:p] + beta[p : p + q] @ shocks[::-1][:q] + beta[-1]
    return float(step + sum(np.diff(y, i)[-1] for i in range(d))), beta


def arma_forecast(df: DataFrame, p: int = 5, d: int = 1, q: int = 5, long: int | None = None) -> DataFrame:
    """Autoregressive moving average of order ``(p, d, q)``; next-day forecast per station, by two regressions.

    The first, an autoregression of order ``long``, gives the residuals that stand for the unseen shocks; the second has the last
    ``p`` values and ``q`` residuals. One Arrow group is one station's series, so its size is bounded by the calendar. A station
    whose history is shorter than the lags has no row.
    """
    long = max(p, q) + 10 if long is None else long

    def fit(key, pdf):
        pdf = pdf.dropna(subset=["volume"]).sort_values("day")
        found = _arma(pdf["volume"].to_numpy(float), p, d, q, long)
        rows = [] if found is None else [(key[0], int(pdf["day"].iloc[-1]) + 1, found[0], found[1])]
        return pd.DataFrame(rows, columns=["station", "day", "prediction", "coefficients"])

    kind = dict(df.dtypes)["station"]
    rows = df.select("station", F.unix_date("date").alias("day"), F.col("volume").cast("double").alias("volume"))
    found = rows.groupBy("station").applyInPandas(fit, f"station {kind}, day int, prediction double, coefficients array<double>")
    return _dated(found).withColumn("model", F.lit("ARIMA"))


def lag_pairs(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Today's volume with the next day's as label; the first ``share`` of each series is for training."""
    order = Window.partitionBy("station").orderBy("date")
    rows = df.withColumns({
        "label": F.lead("volume").over(order), "_i": F.row_number().over(order),
        "_n": F.count("*").over(Window.partitionBy("station")),
        "station_mean": F.avg("volume").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    train = F.col("_i") <= F.floor(F.col("_n") * share)
    return rows.withColumn("is_train", train).filter(F.col("label").isNotNull()).drop("_i", "_n")


def boosted_forecast(
    df: DataFrame, share: float = 0.9, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, patience: int = PATIENCE
) -> DataFrame:
    """Boosted trees from a day's volume to the next day's, one model per station: its days after the first ``share``, their actual
    next-day volume, the prediction (not below 0) and the number of trees.

    The last tenth of a station's training days says when more trees stop helping (``patience``); the model is then fitted to all
    its training days with that many. A station with fewer than two training days has no rows. One Arrow group is one
    station's series, so its size is bounded by the calendar.
    """
    rows = lag_pairs(df, share).select("station", F.unix_date("date").alias("day"), "volume", "label", "is_train")

    def fit(key, pdf):
        pdf = pdf.dropna(subset=["volume"]).sort_values("day")
        train, rest = pdf[pdf["is_train"]], pdf[~pdf["is_train"]]
        if len(train) < 2 or not len(rest):
            return pd.DataFrame({"station": [], "day": [], "actual": [], "prediction": [], "trees": []})
        x, y = train[["volume"]].to_numpy(float), train["label"].to_numpy(float)
        model = fit_watched(x, y, max(len(y) // 10, 1), trees, depth, rate, bins, patience)
        predicted = np.maximum(model.predict(rest[["volume"]].to_numpy(float)), 0.0)
        return pd.DataFrame({
            "station": key[0], "day": rest["day"], "actual": rest["label"].astype(float), "prediction": predicted, "trees": len(model.trees)
        })

    kind = dict(df.dtypes)["station"]
    found = rows.groupBy("station").applyInPandas(fit, f"station {kind}, day int, actual double, prediction double, trees int")
    return _dated(found).withColumn("model", F.lit("XGBoost"))


#: Bins of a feature of the pooled trees (the learner's own number), and the accuracy of their quantiles.
GBT_BINS, GBT_ACCURACY = 32, 10_000


def binned_cells(train: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, dict[str, Column]]:
    """The training rows by the bins of their features, as mean label and number of rows, and the bin of a row as expressions.

    Boosted trees with squared error see a feature only by its bin, and of the rows that share all bins only their number and the sum of
    their labels: a split's gain and a leaf's value are the same over the cells. So the fit's passes read at most
    ``GBT_BINS`` to the number of features rows, however many the table has.
    """
    shares = [k / GBT_BINS for k in range(1, GBT_BINS)]
    known = train.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)])
    ends = known.agg(*[F.percentile_approx(c, shares, GBT_ACCURACY).alias(c) for c in features]).first()
    # A value's bin is the number of ends below it, so equal values share a bin; an unknown one has none.
    bins = {}
    for c in features:
        steps = sorted(set(ends[c] or []))
        bins[c] = sum((F.when(F.col(c) > e, 1.0).when(F.col(c).isNotNull(), 0.0) for e in steps), F.lit(0.0))
    cells = train.groupBy(*[bins[c].alias(c) for c in features]).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("weight"))
    return cells, bins


def gbt_lag_forecast(df: DataFrame, share: float = 0.9, trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Boosted trees from today's volume to the next day's, one pooled model over all stations.

    The running mean of the station tells the pooled model the level of a series. The trees are fitted to the cells of the training
    rows (:func:`binned_cells`), cut at quantiles of all of them.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    features, named = ["volume", "station_mean"], ["volume_bin", "station_mean_bin"]
    pairs = lag_pairs(df, share)
    cells, bins = binned_cells(pairs.filter("is_train"), features, "label")
    assembler = VectorAssembler(inputCols=named, outputCol="features")
    cells = cells.withColumnsRenamed(dict(zip(features, named)))
    model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, maxBins=GBT_BINS, weightCol="weight").fit(assembler.transform(staged(cells)))
    held = pairs.filter(~F.col("is_train")).withColumns({n: bins[c] for n, c in zip(named, features)})
    scored = model.transform(assembler.transform(held))
    return scored.select(
        "station", F.lit("XGBoost").alias("model"), "date", F.col("label").alias("actual"),
        F.greatest(F.col("prediction"), F.lit(0.0)).alias("prediction"),
    )
