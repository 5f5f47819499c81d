"""Daily volume series: build, complete, classify, profile.

A series has one row per station and day. That grain bounds every per-station window by the number
of calendar days, whatever the size of the raw readings; :func:`daily` enforces it with a
partially aggregated sum. Consecutive windows keep the station first in their partition, so one
shuffle serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions.columns import day_code, flag, to_cubic_meters, to_date
from gridlytics.functions.special import chi2_sf
from gridlytics.operators.ranks import mode_by
from gridlytics.operators.relational import first_per_key

ACTIVE, NEW, INACTIVE = "ACTIVA", "NUEVA", "NO ACTIVA"

#: Completed days that one task should hold; windows over a station sort them, so this bounds the task's memory.
DAYS_PER_TASK = 500_000
#: Rows that one task should add up where nearly each row is a key of its own; its hash map grows with them.
ROWS_PER_TASK = 500_000
FEED_KEYS = ("station_name", "device", "user_type", "date")


def _yesterday(as_of) -> Column:
    return F.date_sub(F.lit(to_date(as_of)), 1)


def daily(df: DataFrame, key: str = "station", date: str = "date", value: str = "volume") -> DataFrame:
    return df.groupBy(key, date).agg(F.sum(value).alias(value))


def daily_volume(devices: DataFrame, readings: DataFrame, start, as_of) -> DataFrame:
    """Signed daily volume in cubic metres of each device from its midnight readings.

    The newest version of a reading is chosen on the readings' own key before the join, and the
    date grid is a generated sequence per device. Days without a reading keep a NULL volume.
    """
    first, last = F.lit(to_date(start)), F.lit(to_date(as_of))
    midnight = F.date_trunc("day", F.col("read_at")) == F.col("read_at")
    valid = readings.filter(
        F.col("value").isNotNull() & midnight & (F.col("is_current") == 1) & (F.col("delta_applied") == 1)
        & F.col("read_at").cast("date").between(first, last)
    ).select("history_id", "column_id", F.col("read_at").cast("date").alias("date"), "created_at", "value")
    newest = first_per_key(valid, ["history_id", "column_id", "date"], [F.col("created_at").desc(), F.col("value").desc()])
    grid = devices.filter(F.col("history_id").isNotNull() & F.col("column_id").isNotNull()).select(
        "station", "history_id", "column_id", "sign", "unit", F.explode(F.sequence(first, last)).alias("date")
    )
    joined = grid.join(newest, ["history_id", "column_id", "date"], "left")
    # A station with several devices keeps the row of the newest reading.
    rows = joined.select("station", "date", to_cubic_meters("value", "unit", "sign").alias("volume"), "created_at")
    return first_per_key(
        rows, ["station", "date"], [F.col("created_at").desc_nulls_last(), F.col("volume").desc_nulls_last()]
    ).drop("created_at")


def enrich(volumes: DataFrame, stations: DataFrame, excluded: Sequence = (), how: str = "left") -> DataFrame:
    """Attach station attributes, leaving out listed stations."""
    if excluded:
        volumes = volumes.filter(~F.col("station").isin(*excluded))
    return volumes.join(stations, "station", how)


def feed_parts(df: DataFrame) -> int:
    """Number of partitions for the daily totals of some raw rows, from their number."""
    return max(math.ceil(df.count() / ROWS_PER_TASK), 1)


def feed_totals(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Daily totals of a feed.

    A day has few rows of a station, so adding up before the shuffle spares little and keeps a task's whole input in its hash map.
    ``parts`` (:func:`feed_parts`) deals the rows by key first; left to bytes, a task gets some ten times their size as a map.
    """
    if parts is not None:
        df = df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *FEED_KEYS)
    return df.groupBy(*FEED_KEYS).agg(F.sum("volume").alias("volume"))


def merge_feeds(first: DataFrame, second: DataFrame, device_fix: dict | None = None, parts: int | None = None) -> DataFrame:
    """Daily totals of one feed stacked on a second, already daily, feed; wrong device ids are replaced by station name."""
    device = F.col("device")
    for name, right in (device_fix or {}).items():
        device = F.when(F.col("station_name") == name, F.lit(right)).otherwise(device)
    totals = feed_totals(first.withColumn("device", device), parts)
    return totals.unionByName(second.select(*FEED_KEYS, "volume"))


def with_holidays(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Add ``holiday`` (0/1) from a table of holiday dates.

    Distinct dates are at most a few ten thousand rows for a century, so they are broadcast.
    """
    days = F.broadcast(calendar.select(F.col("date").alias(date)).distinct().withColumn("holiday", F.lit(1)))
    return df.join(days, date, "left").withColumn("holiday", F.coalesce(F.col("holiday"), F.lit(0)))


def encode_days(df: DataFrame, holidays: DataFrame, special: DataFrame | None = None, date: str = "date") -> DataFrame:
    """Holiday flag, weekday code with holidays as 8, and optionally a flag for special holidays."""
    out = with_holidays(df, holidays, date).withColumn("day_code", day_code(date, "holiday"))
    if special is not None:
        days = F.broadcast(special.select(F.col("date").alias(date)).distinct().withColumn("special_holiday", F.lit(1)))
        out = out.join(days, date, "left").fillna(0, subset=["special_holiday"])
    return out


def series_parts(df: DataFrame, station: str, date: str, as_of=None) -> int:
    """Number of partitions for the completed days of the stations of some raw rows, from the stations and the span of their dates."""
    last = F.max(date).cast("date") if as_of is None else _yesterday(as_of)
    found = df.agg(F.approx_count_distinct(station).alias("stations"), F.datediff(last, F.min(date).cast("date")).alias("days")).first()
    return max(math.ceil(found["stations"] * max((found["days"] or 0) + 1, 1) / DAYS_PER_TASK), 1)


def complete_dates(
    df: DataFrame, calendar: DataFrame, as_of=None, attributes: Sequence[str] = (), missing: float | None = 0.0, parts: int | None = None
) -> DataFrame:
    """Every day of every station from its first date to the day before ``as_of`` (or its last date).

    Each row generates itself and the empty days up to the next row,
    so there is no date grid, no join, and the result stays partitioned by station for the windows that follow.
    The input has one row per station and day; of a day given twice, both rows stay and no day is made up.

    ``parts`` (:func:`series_parts`) fixes the number of partitions by what the days will be. Left to adaptive execution it follows the
    bytes before the days are made up, and a task ends with many times the rows it was given.
    """
    order = Window.partitionBy("station").orderBy("date")
    rows = df.select("station", *attributes, "date", "volume")
    if parts is not None:
        rows = rows.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), "station")
    last = F.col("date")
    if as_of is not None:
        last = _yesterday(as_of)
        rows = rows.filter(F.col("date") <= last)
    until = F.coalesce(F.date_sub(F.lead("date").over(order), 1), last)
    days = rows.withColumn("_until", until).withColumn("_day", F.explode(F.sequence("date", F.greatest("date", "_until"))))
    volume = F.when(F.col("_day") == F.col("date"), F.col("volume"))
    if missing is not None:
        volume = F.coalesce(volume, F.lit(missing))
    out = days.select("station", *attributes, F.col("_day").alias("date"), volume.alias("volume"))
    return with_holidays(out, calendar).withColumn("weekday", F.weekday("date"))


def mode_fill(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing attributes with the most frequent value of their series."""
    out = df
    for c in cols:
        out = out.join(mode_by(df, [key], c, f"_mode_{c}"), key, "left")
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}"))).drop(f"_mode_{c}")
    return out


def effective_start(df: DataFrame, n: int = 30) -> DataFrame:
    """Add ``start``: the last day with volume after up to ``n`` days without any, else the first day.

    The window of the first row is empty, so its sum is NULL and it never qualifies; a series
    with fewer than ``n`` leading zeros does.
    """
    before = Window.partitionBy("station").orderBy("date").rowsBetween(-n, -1)
    whole = Window.partitionBy("station")
    marked = df.withColumn("_quiet", F.sum("volume").over(before))
    wake = F.when((F.col("_quiet") == 0) & (F.col("volume") != 0), F.col("date"))
    start = F.coalesce(F.max(wake).over(whole), F.min("date").over(whole))
    return marked.withColumn("start", start).drop("_quiet")


def series_state(df: DataFrame, as_of, window: int = 30, new_until: int = 60, attributes: Sequence[str] = ()) -> DataFrame:
    """State of each station: active, new or not active.

    A second look-back window before the first one exists when transmission began inside the first; the
    first day of transmission is taken by a window on the station, so one shuffle feeds both counts.
    """
    today = _yesterday(as_of)
    ago = F.date_sub(today, window - 1)
    whole = Window.partitionBy("station")
    recent = F.col("date") >= ago
    sent = F.when((F.col("volume") != 0) & recent, F.col("date"))
    rows = df.withColumn("_sent", F.coalesce(F.min(sent).over(whole), F.date_add(today, 1)))
    gap = F.datediff("_sent", ago)
    rest = window - gap
    # date_sub wants an integer day count; the second window starts `rest` days before the first.
    second = F.when((rest > 0) & (rest < window), F.date_sub(ago, rest.cast("int")))
    rows = rows.withColumn("_second", second)
    zero = F.col("volume") == 0
    earlier = zero & (F.col("date") < F.col("_sent")) & (F.col("date") >= F.col("_second"))
    stats = rows.groupBy("station", *attributes, "start", "_sent", "_second").agg(
        F.min("date").alias("first_date"),
        F.sum(flag(zero & recent)).alias("silent_days"),
        F.sum(flag(earlier)).alias("_earlier"),
    )
    gap = F.datediff("_sent", ago)
    fresh = F.when(F.col("first_date") > F.col("_second"), window)
    silent2 = F.when(F.col("_second").isNotNull(), F.coalesce(fresh, F.col("_earlier")))
    age = F.datediff(today, F.col("start"))
    out = stats.withColumns({"gap_days": gap, "silent_days_before": silent2})
    none = F.col("silent_days_before").isNull()
    state = (
        F.when(none & (F.col("gap_days") >= window), INACTIVE)
        .when(none & (F.col("gap_days") < window) & (age > new_until), ACTIVE)
        .when((F.col("silent_days_before") < window) & (age > new_until), ACTIVE)
        .when((F.col("silent_days_before") == window) | (age <= new_until), NEW)
    )
    return out.select(
        "station", *attributes, "start", "first_date", F.col("_sent").alias("first_sent"), "gap_days", "silent_days",
        ((window - F.col("silent_days")) / window).alias("sending_share"), "silent_days_before", state.alias("state"),
    )


def legacy_state(df: DataFrame, states: DataFrame, percentage: float = 0.9, check_length: bool = True) -> DataFrame:
    """Earlier rule: an active station turns inactive, an inactive one new or active, by zeros in its last days.

    ``check_length`` also demands 15 (active) or 30 (inactive) days of history.
    """
    last = F.row_number().over(Window.partitionBy("station").orderBy(F.col("date").desc()))
    tail = df.select("station", "date", "volume").withColumn("_r", last).filter(F.col("_r") <= 30)
    aggs = []
    for n in (15, 30):
        inside = F.col("_r") <= n
        aggs += [F.sum(flag(inside & (F.col("volume") == 0))).alias(f"_z{n}"), F.sum(flag(inside)).alias(f"_n{n}")]
    counts = tail.groupBy("station").agg(*aggs)
    out = states.join(counts, "station", "left").fillna(0, subset=["_z15", "_n15", "_z30", "_n30"])
    few15, few30 = (F.col("_n15") < 15, F.col("_n30") < 30) if check_length else (F.lit(False), F.lit(False))
    quiet = (F.col("_z15") >= int(15 * percentage)) | few15
    unsteady = (F.col("_z30") >= 30 - int(30 * percentage)) | few30
    state = F.when(F.col("state") == "Activa", F.when(quiet, "Inactiva").otherwise("Activa")).when(
        F.col("state") == "Inactiva", F.when(unsteady, "Nueva").otherwise("Activa")
    )
    return out.select("station", state.alias("state")).filter(F.col("state").isNotNull())


def series_metrics(df: DataFrame, block: int = 15, attributes: Sequence[str] = ("start",)) -> DataFrame:
    """Share of days with volume, moments, and uniformity of the zeros over blocks of ``block`` rows.

    Uniformity is the chi-square tail probability of the zero counts per block; only one row per
    station reaches Python.
    """
    keys = ["station", *attributes]
    index = F.row_number().over(Window.partitionBy("station").orderBy("date")) - 1
    # Moments are taken from the distance to the series' smallest volume: large, steady volumes keep their digits.
    low = F.coalesce(F.min("volume").over(Window.partitionBy("station")), F.lit(0.0))
    rows = df.withColumns({"_block": F.floor(index / block), "_low": low, "_x": F.col("volume") - low})
    blocks = rows.groupBy(*keys, "_block").agg(
        F.sum(flag(F.col("volume") == 0)).alias("_z"), F.count("*").alias("_n"),
        F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"), F.first("_low").alias("_low"),
    )
    out = blocks.groupBy(*keys).agg(
        F.sum("_z").alias("zeros"), F.sum("_n").alias("total"), F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss"),
        F.count("*").alias("blocks"), F.sum(F.col("_z") * F.col("_z")).alias("_zz"), F.first("_low").alias("_low"),
    )
    n, above = F.col("total"), F.col("_s") / F.col("total")
    mean = F.col("_low") + above
    var = F.greatest(F.try_divide(F.col("_ss") - n * above * above, n - 1), F.lit(0.0))
    expected = F.col("zeros") / n * block
    # sum over blocks of (e - z)^2 / e, written out.
    stat = F.try_divide(F.col("_zz"), expected) - 2 * F.col("zeros") + F.col("blocks") * expected
    return out.select(
        *keys, (1 - F.col("zeros") / n).alias("share"), "zeros", "total", mean.alias("mean"),
        F.sqrt(var).alias("sd"), "blocks", F.when(expected > 0, stat).alias("statistic"),
    ).withColumn("uniformity", chi2_sf("statistic", (F.col("blocks") - 1).cast("double")))


def trim_rule(share: float = 0.85, level: float = 0.05) -> Column:
    """Whether the metrics of a series say that its volume is sparse and its zeros uneven; unknown metrics say no."""
    return F.coalesce((F.col("share") < share) & (F.col("uniformity") < level), F.lit(False))


def trim_series(df: DataFrame, metrics: DataFrame, share: float = 0.85, level: float = 0.05) -> DataFrame:
    """Keep a series only from its effective start when its volume is sparse and its zeros uneven."""
    listed = metrics.filter(trim_rule(share, level)).select("station", F.lit(True).alias("_cut"))
    return df.join(listed, "station", "left").filter(F.col("_cut").isNull() | (F.col("date") >= F.col("start"))).drop("_cut")


def transmission_profile(df: DataFrame, as_of) -> DataFrame:
    """Days without volume, last days with and without, and gaps, per station."""
    silent = F.col("volume") == 0
    none = F.lit("1900-01-01").cast("date")
    return df.groupBy("station").agg(
        F.sum(flag(silent)).alias("silent_days"),
        F.max(F.when(silent, F.col("date")).otherwise(none)).alias("last_silent"),
        F.max(F.when(silent, none).otherwise(F.col("date"))).alias("last_sent"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("rows"),
    ).withColumns(
        {"span_days": F.datediff("last_date", "first_date"), "days_since_sent": F.datediff(F.lit(to_date(as_of)), "last_sent")}
    )


def reporting_gap(df: DataFrame, as_of, limit: int = 60) -> DataFrame:
    """Days since the last report; stations silent for ``limit`` days or more are dropped."""
    last = df.groupBy("station").agg(F.max("date").alias("last_date"))
    return last.withColumn("gap_days", F.datediff(F.lit(to_date(as_of)), "last_date")).filter(F.col("gap_days") < limit)


def period_totals(df: DataFrame, period: str) -> DataFrame:
    """Volume per month-year, month, year or station."""
    parts = {
        "month_year": F.concat_ws("-", F.month("date").cast("string"), F.year("date").cast("string")),
        "month": F.month("date"), "year": F.year("date"), "station": F.col("station"),
    }
    return df.groupBy(parts[period].alias(period)).agg(F.sum("volume").alias("volume"))


def high_low(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` stations with the smallest and the ``k`` with the largest total."""
    totals = period_totals(df, "station")
    low = totals.orderBy(F.col("volume"), "station").limit(k).withColumn("side", F.lit("low"))
    high = totals.orderBy(F.col("volume").desc(), "station").limit(k).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def neighbour_days(df: DataFrame) -> DataFrame:
    """Flags of the days before and after a Monday holiday, looked up within the same station."""
    order = Window.partitionBy("station").orderBy("date")
    monday = flag((F.col("holiday") == 1) & (F.weekday("date") == 0))
    rows = df.withColumn("_monday", monday)
    return rows.withColumns(
        {"after_bridge": F.coalesce(F.lag("_monday").over(order), F.lit(0)),
         "before_bridge": F.coalesce(F.lead("_monday").over(order), F.lit(0))}
    ).drop("_monday")


def autocorrelation(df: DataFrame, max_lag: int = 20, value: str = "volume") -> DataFrame:
    """Auto- and partial autocorrelation per station, lags 0 to ``max_lag``.

    Lagged products are summed in one aggregate; the Durbin-Levinson recursion runs on the short
    lag vector of each station.
    """
    order = Window.partitionBy("station").orderBy("date")
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy("station")))
    lagged = centred.select("station", "_x", *[F.lag("_x", k).over(order).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    products = [F.sum(F.col("_x") * F.col("_x"))] + [
        F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)
    ]
    sums = lagged.groupBy("station").agg(F.array(*products).alias("c")).filter(F.col("c")[0] > 0)
    acf = sums.select("station", F.transform("c", lambda v: v / F.col("c")[0]).alias("acf"))

    def partial(acf):
        import pandas as pd

        out = []
        for r in acf:
            previous, values = [], [1.0]
            for k in range(1, len(r)):
                top = r[k] - sum(previous[j] * r[k - 1 - j] for j in range(len(previous)))
                low = 1.0 - sum(previous[j] * r[j + 1] for j in range(len(previous)))
                last = top / low if abs(low) > 1e-12 else 0.0
                previous = [previous[j] - last * previous[k - 2 - j] for j in range(len(previous))] + [last]
                values.append(float(last))
            out.append(values)
        return pd.Series(out)

    pacf = F.pandas_udf(partial, T.ArrayType(T.DoubleType()))
    both = acf.withColumn("pacf", pacf("acf"))
    return both.select("station", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "v")).select(
        "station", "lag", F.col("v.acf").alias("acf"), F.col("v.pacf").alias("pacf")
    )


def sequences(df: DataFrame, n: int = 30, value: str = "volume") -> DataFrame:
    """Sliding sequences of ``n`` consecutive values per station; the last one is the target."""
    frame = Window.partitionBy("station").orderBy("date").rowsBetween(-(n - 1), 0)
    rows = df.withColumn("sequence", F.collect_list(value).over(frame)).filter(F.size("sequence") == n)
    return rows.select(
        "station", "date", F.slice("sequence", 1, n - 1).alias("inputs"), F.element_at("sequence", -1).alias("target")
    )
