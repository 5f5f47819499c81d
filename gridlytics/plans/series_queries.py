"""Daily series, outlier and forecast queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from gridlytics.operators import forecast as FC
from gridlytics.operators import outliers as O
from gridlytics.operators import ranks as RK
from gridlytics.operators import relational as R
from gridlytics.operators import series as S
from gridlytics.operators import similarity as SM
from gridlytics.operators import stats as ST
from gridlytics.plans.bases import READINGS_AS_OF, READINGS_START, SERIES_AS_OF, Tables
from gridlytics.plans.registry import query
from gridlytics.plans.tails import chi2_tail, t_tail
from gridlytics.sources import merge as M
from gridlytics.sources import tables as TB
from gridlytics.sources.keyed import KeyedTable
from gridlytics.sources.staging import shared_folder, staged


@query("daily_volume", """
    SELECT station, date, CASE unit WHEN 'M3' THEN signed WHEN 'FT3' THEN signed / 35.3147::DOUBLE
             WHEN 'KPC' THEN signed * 1000 / 35.3147::DOUBLE WHEN 'MBTU' THEN signed * 1000 / 35.3147::DOUBLE END::DECIMAL(20,4) AS volume
    FROM (SELECT u.station, u.date, u.unit, r.value * CASE WHEN u.station % 7 = 0 THEN -1 ELSE 1 END AS signed,
                 row_number() OVER (PARTITION BY u.station, u.date ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST) AS rn
          FROM (SELECT station, [ 'M3', 'FT3', 'KPC', 'MBTU', 'GAL' ][station % 5 + 1] AS unit, CAST(d AS DATE) AS date
                FROM (SELECT DISTINCT user_id AS station FROM events), generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d)) u
          LEFT JOIN (SELECT user_id, ts, CAST(ts AS DATE) AS day, value FROM events
                     WHERE event_type NOT IN ('click', 'error') AND value IS NOT NULL) r ON r.user_id = u.station AND r.day = u.date)
    WHERE rn = 1""", [], ["volume"])
def _(t):
    return S.daily_volume(t.devices, t.readings, READINGS_START, READINGS_AS_OF)


@query("enrich_stations", """
    SELECT d.station, date, volume, station_name, user_type, device FROM daily d LEFT JOIN stations USING (station)""",
       ["daily", "stations"], ["volume"])
def _(t):
    return S.enrich(t.daily, t.stations)


@query("merge_feeds", """
    SELECT station_name, CASE WHEN station_name = 'Supplier#000000001' THEN 'D-99' ELSE device END AS device, user_type, date,
           sum(l_quantity) AS volume
    FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_quantity FROM lineitem WHERE l_linestatus = 'O') JOIN stations ON station = l_suppkey
    GROUP BY 1, 2, 3, 4
    UNION ALL SELECT station_name, device, user_type, date, sum(l_quantity) FROM
      (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_quantity FROM lineitem WHERE l_linestatus <> 'O')
      JOIN stations ON station = l_suppkey GROUP BY 1, 2, 3, 4""", ["stations"], ["volume"])
def _(t):
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("volume"), "l_linestatus",
    ).join(t.stations, "station")
    parts = S.feed_parts(t.lineitem)
    second = S.feed_totals(lines.filter(F.col("l_linestatus") != "O"), parts)
    return S.merge_feeds(lines.filter(F.col("l_linestatus") == "O"), second, {"Supplier#000000001": "D-99"}, parts)


@query("complete_dates", "SELECT * FROM series", ["series"], ["volume"])
def _(t):
    return t.series


@query("complete_dates_to_last", """
    SELECT s.* FROM series s JOIN (SELECT station, max(date) AS last FROM daily GROUP BY 1) l ON l.station = s.station AND s.date <= l.last""",
       ["series", "daily"], ["volume"])
def _(t):
    return S.complete_dates(t.daily, t.calendar)


@query("encode_days", """
    SELECT d.station, d.date, volume, CASE WHEN c.date IS NULL THEN 0 ELSE 1 END AS holiday,
           CAST(CASE WHEN c.date IS NULL THEN isodow(d.date) - 1 ELSE 8 END AS INTEGER) AS day_code,
           CASE WHEN c.date IS NOT NULL AND month(c.date) = 1 THEN 1 ELSE 0 END AS special_holiday
    FROM daily d LEFT JOIN calendar c ON c.date = d.date""", ["daily", "calendar"], ["volume"])
def _(t):
    return S.encode_days(t.daily, t.calendar, t.calendar.filter(F.month("date") == 1))


@query("mode_fill", """
    SELECT station, date, line, coalesce(kind, mode) AS kind
    FROM (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, l_linenumber AS line,
                 CASE WHEN l_returnflag <> 'A' THEN l_linestatus || l_returnflag END AS kind FROM lineitem)
    JOIN (SELECT station, mode FROM (
            SELECT l_suppkey AS station, l_linestatus || l_returnflag AS mode,
                   row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linestatus || l_returnflag) AS rn
            FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) WHERE rn = 1) USING (station)""")
def _(t):
    kind = F.when(F.col("l_returnflag") != "A", F.concat("l_linestatus", "l_returnflag"))
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_linenumber").alias("line"), kind.alias("kind"),
    )
    return S.mode_fill(rows, "station", ["kind"])


@query("effective_start", "SELECT * FROM started", ["started"], ["volume"])
def _(t):
    return t.started


@query("series_state", "SELECT * FROM states", ["states"], ["sending_share"])
def _(t):
    return t.states


_LEGACY = """
    SELECT station, CASE WHEN state = 'Activa' THEN CASE WHEN z15 >= 13 OR n15 < 15 THEN 'Inactiva' ELSE 'Activa' END
                         ELSE CASE WHEN z30 >= 3 OR n30 < 30 THEN 'Nueva' ELSE 'Activa' END END AS state
    FROM (SELECT s_suppkey AS station, CASE WHEN s_acctbal > 4500 THEN 'Activa' ELSE 'Inactiva' END AS state FROM supplier)
    JOIN (SELECT station, count(*) FILTER (back <= 15 AND volume = 0) AS z15, count(*) FILTER (back <= 15) AS n15,
                 count(*) FILTER (back <= 30 AND volume = 0) AS z30, count(*) FILTER (back <= 30) AS n30
          FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS back FROM series) GROUP BY 1) USING (station)"""


def _old_states(t: Tables):
    return t.supplier.select(
        F.col("s_suppkey").alias("station"), F.when(F.col("s_acctbal") > 4500, "Activa").otherwise("Inactiva").alias("state")
    )


@query("legacy_state", _LEGACY, ["series"])
def _(t):
    return S.legacy_state(t.series, _old_states(t))


@query("legacy_state_any_length", _LEGACY.replace(" OR n15 < 15", "").replace(" OR n30 < 30", ""), ["series"])
def _(t):
    return S.legacy_state(t.series, _old_states(t), check_length=False)


_METRICS = """
    SELECT station, start, 1 - CAST(zeros AS DOUBLE) / total AS share, zeros, total, mean, sd, blocks,
           CASE WHEN zeros > 0 THEN stat END AS statistic
    FROM (SELECT station, start, CAST(sum(z) AS BIGINT) AS zeros, CAST(sum(n) AS BIGINT) AS total, sum(s) / sum(n) AS mean,
                 sqrt((sum(ss) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1)) AS sd, count(*) AS blocks,
                 sum(z * z) / nullif(sum(z) / sum(n) * 15, 0) - 2 * sum(z) + count(*) * sum(z) / sum(n) * 15 AS stat
          FROM (SELECT station, start, (rn - 1) // 15 AS block, CAST(count(*) FILTER (volume = 0) AS DOUBLE) AS z,
                       CAST(count(*) AS DOUBLE) AS n, sum(volume) AS s, sum(volume * volume) AS ss
                FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS rn FROM started) GROUP BY ALL)
          GROUP BY 1, 2)"""


@query("series_metrics", _METRICS, ["started"], ["share", "mean", "sd", "statistic"])
def _(t):
    return S.series_metrics(t.started).drop("uniformity")


_UNIFORMITY = f"SELECT *, {chi2_tail('statistic', 'blocks - 1')} AS uniformity FROM ({_METRICS})"


@query("series_uniformity", _UNIFORMITY, ["started"], ["share", "mean", "sd", "statistic", "uniformity"])
def _(t):
    return S.series_metrics(t.started)


# The started series is read for the metrics and for the rows, so it and the metrics are made once.
_TRIMMED = f"""
    SELECT * FROM (
      WITH rows AS MATERIALIZED (SELECT * FROM started),
           cuts AS MATERIALIZED (SELECT station, coalesce(share < {{share}} AND uniformity < 0.05, false) AS cut
                                 FROM ({_UNIFORMITY.replace("FROM started", "FROM rows")}))
      SELECT s.* FROM rows s JOIN cuts USING (station) WHERE NOT cut OR s.date >= s.start)"""


@query("trimmed_stations", f"SELECT station, coalesce(share < 0.85 AND uniformity < 0.05, false) AS cut FROM ({_UNIFORMITY})", ["started"])
def _(t):
    """Which series the trim rule cuts."""
    return S.series_metrics(t.started).select("station", S.trim_rule().alias("cut"))


@query("trim_series", _TRIMMED.format(share=0.85), ["started"], ["volume"])
def _(t):
    return S.trim_series(t.started, S.series_metrics(t.started))


@query("trim_series_uniformity", _TRIMMED.format(share=1.1), ["started"], ["volume"])
def _(t):
    """The uniformity alone decides: every share of days is under the limit."""
    return S.trim_series(t.started, S.series_metrics(t.started), share=1.1)


_HAMPEL = """
    SELECT f.station, f.date, volume, holiday, weekday, day_code, outlier,
           CASE WHEN outlier THEN {new} ELSE volume END AS corrected
    FROM (SELECT * EXCLUDE (w), abs(volume - median) > 3.0::DOUBLE * 1.4826::DOUBLE * list_median(list_transform(w, lambda v: abs(v - median))) AS outlier
          FROM (SELECT *, list_median(w) AS median FROM (
                SELECT *, CAST(CASE WHEN holiday = 1 THEN 8 ELSE weekday END AS INTEGER) AS day_code,
                       list(volume) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING) AS w
                FROM series))) f
    JOIN (SELECT station, code, sum(volume) / 4 AS fresh FROM (
            SELECT station, volume, CASE WHEN holiday = 1 THEN 8 ELSE weekday END AS code,
                   row_number() OVER (PARTITION BY station, CASE WHEN holiday = 1 THEN 8 ELSE weekday END ORDER BY date DESC) AS rn
            FROM series) WHERE rn <= 4 GROUP BY 1, 2) l ON l.station = f.station AND l.code = f.day_code"""


@query("outliers_hampel", _HAMPEL.format(new="fresh"), ["series"], ["volume", "corrected"])
def _(t):
    return O.correct_outliers_hampel(t.series)


@query("outliers_hampel_median", _HAMPEL.format(new="median"), ["series"], ["volume", "corrected"])
def _(t):
    return O.correct_outliers_hampel(t.series, replacement="median")


@query("outliers_mad", """
    SELECT d.station, date, volume, abs(volume - m) > 3.0::DOUBLE * 1.4826::DOUBLE * s AS outlier,
           CASE WHEN abs(volume - m) > 3.0::DOUBLE * 1.4826::DOUBLE * s THEN m ELSE volume END AS corrected
    FROM daily d JOIN (SELECT station, median(volume) AS m FROM daily GROUP BY 1) a USING (station)
    JOIN (SELECT station, median(abs(volume - m)) AS s FROM daily JOIN (SELECT station, median(volume) AS m FROM daily GROUP BY 1) USING (station)
          GROUP BY 1) b USING (station)""", ["daily"], ["volume", "corrected"])
def _(t):
    return O.correct_outliers_mad(t.daily)


@query("outliers_residual")
def _(t):
    return O.correct_outliers_residual(t.series)


@query("outliers_trend")
def _(t):
    # The rule needs no start, so the metrics spare the window that finds it.
    trimmed = S.trim_series(t.started, S.series_metrics(t.series, attributes=()))
    return O.correct_outliers_trend(trimmed)


@query("impute_missing", """
    SELECT station, date, volume, holiday, weekday, coalesce(volume, fresh) AS imputed
    FROM (SELECT *, CASE WHEN holiday = 1 THEN -1 ELSE weekday END AS k FROM (
            SELECT s.station, s.date, v.volume, holiday, weekday FROM series s LEFT JOIN daily v ON v.station = s.station AND v.date = s.date))
    LEFT JOIN (SELECT station, k, avg(volume) AS fresh FROM (
        SELECT d.station, volume, CASE WHEN c.date IS NOT NULL THEN -1 ELSE isodow(d.date) - 1 END AS k,
               row_number() OVER (PARTITION BY d.station, CASE WHEN c.date IS NOT NULL THEN -1 ELSE isodow(d.date) - 1 END ORDER BY d.date DESC) AS rn
        FROM daily d LEFT JOIN calendar c ON c.date = d.date WHERE d.date <= DATE '2001-11-04') WHERE rn <= 4 GROUP BY 1, 2) USING (station, k)""",
       ["series", "daily", "calendar"], ["volume", "imputed"])
def _(t):
    return O.impute_missing(S.complete_dates(t.daily, t.calendar, SERIES_AS_OF, missing=None))


@query("transmission_profile", """
    SELECT *, datediff('day', first_date, last_date) AS span_days, datediff('day', last_sent, DATE '2001-11-05') AS days_since_sent
    FROM (SELECT station, count(*) FILTER (volume = 0) AS silent_days,
                 max(CASE WHEN volume = 0 THEN date ELSE DATE '1900-01-01' END) AS last_silent,
                 max(CASE WHEN volume = 0 THEN DATE '1900-01-01' ELSE date END) AS last_sent,
                 min(date) AS first_date, max(date) AS last_date, count(date) AS rows FROM series GROUP BY 1)""", ["series"])
def _(t):
    return S.transmission_profile(t.series, SERIES_AS_OF)


@query("reporting_gap", """
    SELECT station, max(date) AS last_date, datediff('day', max(date), DATE '2001-11-05') AS gap_days FROM daily
    GROUP BY 1 HAVING datediff('day', max(date), DATE '2001-11-05') < 60""", ["daily"])
def _(t):
    return S.reporting_gap(t.daily, SERIES_AS_OF)


for _period, _expr in (
    ("month_year", "CAST(month(date) AS VARCHAR) || '-' || CAST(year(date) AS VARCHAR)"),
    ("month", "CAST(month(date) AS INTEGER)"), ("year", "CAST(year(date) AS INTEGER)"), ("station", "station"),
):
    query(f"totals_by_{_period}", f"SELECT {_expr} AS {_period}, sum(volume) AS volume FROM daily GROUP BY 1", ["daily"], ["volume"])(
        lambda t, _period=_period: S.period_totals(t.daily, _period)
    )


@query("high_low", """
    (SELECT station, sum(volume) AS volume, 'low' AS side FROM daily GROUP BY 1 ORDER BY 2, 1 LIMIT 5)
    UNION ALL (SELECT station, sum(volume), 'high' FROM daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""", ["daily"], ["volume"])
def _(t):
    return S.high_low(t.daily)


@query("neighbour_days", """
    SELECT *, coalesce(lag(m) OVER w, 0) AS after_bridge, coalesce(lead(m) OVER w, 0) AS before_bridge
    FROM (SELECT *, CASE WHEN holiday = 1 AND weekday = 0 THEN 1 ELSE 0 END AS m FROM series)
    WINDOW w AS (PARTITION BY station ORDER BY date)""".replace("SELECT *, coalesce", "SELECT * EXCLUDE (m), coalesce", 1),
       ["series"], ["volume"])
def _(t):
    return S.neighbour_days(t.series)


_ACF = """
    SELECT station, CAST(lag AS INTEGER) AS lag, acf FROM (
      SELECT a.station, k AS lag, coalesce(sum(a.x * b.x), 0) / max(v) AS acf
      FROM (SELECT station, date, volume - avg(volume) OVER (PARTITION BY station) AS x,
                   sum(volume * volume) OVER (PARTITION BY station) - power(sum(volume) OVER (PARTITION BY station), 2) / count(*) OVER (PARTITION BY station) AS v
            FROM series) a CROSS JOIN range(0, 21) r(k)
      LEFT JOIN (SELECT station, date, volume - avg(volume) OVER (PARTITION BY station) AS x FROM series) b
        ON b.station = a.station AND b.date = a.date - CAST(k AS INTEGER)
      GROUP BY 1, 2)"""


@query("autocorrelation", _ACF, ["series"], ["acf"])
def _(t):
    return S.autocorrelation(t.series).drop("pacf")


# The first two partial autocorrelations have closed forms; the others follow by the same recursion.
@query("partial_autocorrelation_two", f"""
    SELECT station, CAST(unnest([0, 1, 2]) AS INTEGER) AS lag, unnest([1.0::DOUBLE, r1, r2]) AS acf, unnest([1.0::DOUBLE, r1, (r2 - r1 * r1) / (1 - r1 * r1)]) AS pacf
    FROM (SELECT station, max(CASE WHEN lag = 1 THEN acf END) AS r1, max(CASE WHEN lag = 2 THEN acf END) AS r2 FROM ({_ACF}) GROUP BY 1)""",
       ["series"], ["acf", "pacf"])
def _(t):
    return S.autocorrelation(t.series, max_lag=2)


@query("partial_autocorrelation")
def _(t):
    return S.autocorrelation(t.series)


@query("running_sum", """
    SELECT station, date, volume, sum(volume) OVER (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING) AS running FROM daily""",
       ["daily"], ["volume", "running"])
def _(t):
    return R.running_sum(t.daily, "station", "date", "volume")


@query("cumulative_quantiles", """
    SELECT unnest([0.5, 0.8, 0.95, 0.99])::DOUBLE AS p, unnest(quantile_cont(running, [0.5, 0.8, 0.95, 0.99])) AS value
    FROM (SELECT sum(volume) OVER (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING) AS running FROM daily)""",
       ["daily"], ["p", "value"])
def _(t):
    places = [0.5, 0.8, 0.95, 0.99]
    edges = RK.quantiles(R.running_sum(t.daily, "station", "date", "volume"), "running", places)
    pairs = F.arrays_zip(F.array(*map(F.lit, places)).alias("p"), F.col("q").alias("value"))
    return edges.select(F.explode(pairs).alias("e")).select(F.col("e.p").alias("p"), F.col("e.value").alias("value"))


@query("describe_series", """
    SELECT station, count(volume) AS n, avg(volume) AS mean, median(volume) AS median, stddev_samp(volume) AS sd,
           (sum(power(volume - m, 3)) / count(*)) / power(sum(power(volume - m, 2)) / count(*), 1.5) AS skewness,
           (sum(power(volume - m, 4)) / count(*)) / power(sum(power(volume - m, 2)) / count(*), 2) - 3 AS kurtosis
    FROM daily JOIN (SELECT station, avg(volume) AS m FROM daily GROUP BY 1) USING (station) GROUP BY 1""",
       ["daily"], ["mean", "median", "sd", "skewness", "kurtosis"])
def _(t):
    return ST.describe_series(t.daily, "station", "volume")


_T_TEST = """
    SELECT user_type, na AS n_a, ma AS mean_a, nb AS n_b, mb AS mean_b,
           (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t,
           CAST(na + nb - 2 AS DOUBLE) AS dof
    FROM (SELECT user_type, count(volume) FILTER ({a}) AS na, avg(volume) FILTER ({a}) AS ma, var_samp(volume) FILTER ({a}) AS va,
                 count(volume) FILTER ({b}) AS nb, avg(volume) FILTER ({b}) AS mb, var_samp(volume) FILTER ({b}) AS vb
          FROM {source} JOIN stations USING (station) GROUP BY 1)"""
_T_COLS = ["mean_a", "mean_b", "t", "dof"]


def _typed(t: Tables):
    return t.series.join(t.stations, "station")


@query("t_test_holiday", _T_TEST.format(a="holiday = 1", b="holiday = 0", source="series"), ["series", "stations"], _T_COLS)
def _(t):
    out = ST.t_test(_typed(t), F.col("holiday") == 1, F.col("holiday") == 0, "volume", ["user_type"])
    return out.drop("p_value")


@query("t_test_special", _T_TEST.format(a="holiday = 1 AND month(date) = 1", b="holiday = 1 AND month(date) <> 1", source="series"),
       ["series", "stations"], _T_COLS)
def _(t):
    special, plain = F.month("date") == 1, F.month("date") != 1
    feast = F.col("holiday") == 1
    return ST.t_test(_typed(t), feast & special, feast & plain, "volume", ["user_type"]).drop("p_value")


@query("t_test_bridge", _T_TEST.format(
    a="weekday = 1", b="m = 1",
    source="(SELECT *, lag(CASE WHEN holiday = 1 AND weekday = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY date) AS m FROM series)",
), ["series", "stations"], _T_COLS)
def _(t):
    rows = S.neighbour_days(t.series).join(t.stations, "station")
    return ST.t_test(rows, F.col("weekday") == 1, F.col("after_bridge") == 1, "volume", ["user_type"]).drop("p_value")


@query("t_test_before_bridge", _T_TEST.format(
    a="weekday = 6", b="m = 1",
    source="(SELECT *, lead(CASE WHEN holiday = 1 AND weekday = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY date) AS m FROM series)",
), ["series", "stations"], _T_COLS)
def _(t):
    rows = S.neighbour_days(t.series).join(t.stations, "station")
    return ST.t_test(rows, F.col("weekday") == 6, F.col("before_bridge") == 1, "volume", ["user_type"]).drop("p_value")


@query("t_test_p_values", f"""SELECT *, {t_tail('t', 'CAST(dof AS BIGINT)')} AS p_value FROM ({
    _T_TEST.format(a="holiday = 1", b="holiday = 0", source="series")})""", ["series", "stations"], [*_T_COLS, "p_value"])
def _(t):
    return ST.t_test(_typed(t), F.col("holiday") == 1, F.col("holiday") == 0, "volume", ["user_type"])


_LENGTHS = (4, 6, 10, 20, 30, 52)
_POOLED = """(m0 - m{n}) / sqrt(((n0 - 1) * coalesce(v0, 0) + (n{n} - 1) * coalesce(v{n}, 0)) / nullif(n0 + n{n} - 2, 0) * (1.0 / nullif(n0, 0) + 1.0 / nullif(n{n}, 0)))"""


@query("history_length", f"""
    SELECT * FROM (WITH ranked AS (SELECT station, weekday, volume, row_number() OVER (PARTITION BY station, weekday ORDER BY date DESC) AS r
                    FROM (SELECT *, isodow(date) - 1 AS weekday FROM daily)),
         sums AS (SELECT station, weekday, count(volume) AS n0, avg(volume) AS m0, var_samp(volume) AS v0, {", ".join(
             f"count(volume) FILTER (r <= {n}) AS n{n}, avg(volume) FILTER (r <= {n}) AS m{n}, var_samp(volume) FILTER (r <= {n}) AS v{n}" for n in _LENGTHS)}
                  FROM ranked GROUP BY 1, 2),
         tests AS ({" UNION ALL ".join(f"SELECT station, weekday, {n} AS days, {_POOLED.format(n=n)} AS t, n0 + n{n} - 2 AS dof FROM sums" for n in _LENGTHS)}),
         scored AS (SELECT *, {t_tail('t', 'dof')} AS p_value FROM tests)
    SELECT station, CAST(weekday AS INTEGER) AS weekday, CAST(min(days) AS INTEGER) AS days, arg_min(p_value, days) AS p_value
    FROM scored WHERE p_value <= 0.05 GROUP BY 1, 2)""", ["daily"], ["p_value"])
def _(t):
    return ST.history_length(t.daily.withColumn("weekday", F.weekday("date")), "station", "weekday", "date", "volume")


# Forecasts ------------------------------------------------------------------------------------


@query("mean_weights", "SELECT * FROM weights", ["weights"], ["w1", "w2", "rmse"])
def _(t):
    return FC.fit_mean_weights(t.stated)


@query("mean_forecast", """
    SELECT station, 'Media' AS model, CAST(date + 1 AS DATE) AS date,
           CASE WHEN raw < 0 THEN 0 ELSE raw END AS prediction
    FROM (SELECT f.station, date, CASE WHEN state = 'NUEVA' THEN same_day WHEN holiday = 1 THEN holiday_mean
                                       ELSE (same_day * w1 + week_to_date * w2) / 2 END AS raw
          FROM features f LEFT JOIN weights w ON w.station = f.station WHERE back = 1)""", ["features", "weights"], ["prediction"])
def _(t):
    return FC.mean_forecast(t.stated, FC.fit_mean_weights(t.stated))


@query("backtest", "SELECT * FROM backtest", ["backtest"], ["actual", "prediction", "error"])
def _(t):
    return FC.backtest(t.stated)


@query("backtest_summary", """
    SELECT station, sqrt(avg(power(prediction - actual, 2))) AS rmse, avg(CASE WHEN error < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS share5,
           avg(CASE WHEN error < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS share10, avg(CASE WHEN error < 0.15 THEN 1.0::DOUBLE ELSE 0 END) AS share15
    FROM backtest GROUP BY 1""", ["backtest"], ["rmse", "share5", "share10", "share15"])
def _(t):
    return FC.backtest_summary(FC.backtest(t.stated))


@query("simple_mean_forecast", """
    SELECT s.station, DATE '2001-11-06' AS date, CASE state WHEN 'Nueva' THEN avg(volume) WHEN 'Inactiva' THEN 0.0
           WHEN 'Activa' THEN avg(volume) FILTER (back <= 10) END AS prediction, 'Media Movil' AS model, state
    FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS back FROM series) s
    JOIN (SELECT s_suppkey AS station, CASE WHEN s_acctbal > 6000 THEN 'Activa' WHEN s_acctbal > 2000 THEN 'Nueva' ELSE 'Inactiva' END AS state
          FROM supplier) k USING (station) GROUP BY s.station, state""", ["series"], ["prediction"])
def _(t):
    balance = F.col("s_acctbal")
    states = t.supplier.select(
        F.col("s_suppkey").alias("station"),
        F.when(balance > 6000, "Activa").when(balance > 2000, "Nueva").otherwise("Inactiva").alias("state"),
    )
    return FC.simple_mean_forecast(t.series, states, SERIES_AS_OF)


@query("additive_forecast")
def _(t):
    return FC.additive_forecast(t.series)


@query("tune_forecast")
def _(t):
    return FC.tune_forecast(t.series)


@query("tuned_forecast")
def _(t):
    return FC.additive_forecast(t.series, scales=FC.tune_forecast(t.series))


@query("fitted_series")
def _(t):
    return FC.fitted_series(t.series)


@query("category_forecast")
def _(t):
    rows = t.orders.select(
        F.col("o_orderdate").cast("date").alias("close_date"), F.col("o_orderpriority").alias("product_type"),
        F.col("o_orderstatus").alias("classification"), F.col("o_totalprice").alias("amount"),
    )
    return FC.category_forecast(rows, ["product_type", "classification"])


@query("ar_forecast_one", """
    SELECT station, 'ARIMA' AS model, last_date + 1 AS date, b0 + b1 * last_step + last_volume AS prediction FROM (
      SELECT station, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, max(date) AS last_date, arg_max(y, date) AS last_step, arg_max(volume, date) AS last_volume
      FROM (SELECT *, lag(y) OVER (PARTITION BY station ORDER BY date) AS x
            FROM (SELECT station, date, volume, volume - lag(volume) OVER (PARTITION BY station ORDER BY date) AS y FROM series)) GROUP BY 1)
    WHERE b1 IS NOT NULL""", ["series"], ["prediction"])
def _(t):
    return FC.ar_forecast(t.series, p=1)


@query("ar_forecast")
def _(t):
    return FC.ar_forecast(t.series)


@query("arma_forecast_one", """
    SELECT station, 'ARIMA' AS model, last_date + 1 AS date, my - b1 * mx - b2 * me + b1 * last_step + b2 * last_shock + last_volume AS prediction
    FROM (SELECT *, (sxy * see - sey * sxe) / (sxx * see - sxe * sxe) AS b1, (sey * sxx - sxy * sxe) / (sxx * see - sxe * sxe) AS b2 FROM (
      SELECT station, avg(y) FILTER (whole) AS my, avg(x) FILTER (whole) AS mx, avg(e1) FILTER (whole) AS me, var_pop(x) FILTER (whole) AS sxx, var_pop(e1) FILTER (whole) AS see,
             covar_pop(x, y) FILTER (whole) AS sxy, covar_pop(e1, y) FILTER (whole) AS sey, covar_pop(x, e1) FILTER (whole) AS sxe,
             max(date) AS last_date, arg_max(y, date) AS last_step, arg_max(e, date) AS last_shock, arg_max(volume, date) AS last_volume
      FROM (SELECT *, e1 IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AS whole FROM (
        SELECT *, lag(e) OVER (PARTITION BY station ORDER BY date) AS e1 FROM (
          SELECT *, y - (regr_slope(y, x) OVER (PARTITION BY station)) * x - (regr_intercept(y, x) OVER (PARTITION BY station)) AS e
          FROM (SELECT *, lag(y) OVER (PARTITION BY station ORDER BY date) AS x
                FROM (SELECT station, date, volume, volume - lag(volume) OVER (PARTITION BY station ORDER BY date) AS y FROM series)))))
      GROUP BY 1))
    WHERE b1 IS NOT NULL""", ["series"], ["prediction"])
def _(t):
    return FC.arma_forecast(t.series, p=1, d=1, q=1, long=1).drop("coefficients")


@query("arma_forecast")
def _(t):
    return FC.arma_forecast(t.series).drop("coefficients")


@query("boosted_forecast")
def _(t):
    return FC.boosted_forecast(t.series)


@query("boosted_rows", """
    SELECT station, date, label AS actual FROM (
      SELECT *, lead(volume) OVER (PARTITION BY station ORDER BY date) AS label, row_number() OVER (PARTITION BY station ORDER BY date) AS i,
             count(*) OVER (PARTITION BY station) AS n FROM series)
    WHERE label IS NOT NULL AND i > floor(n * 0.9::DOUBLE)""", ["series"], ["actual"])
def _(t):
    """The held-out days of every station with their labels; the predictions differ by no more than the number of trees."""
    return FC.boosted_forecast(t.series, trees=5).select("station", "date", "actual")


@query("gbt_lag_forecast")
def _(t):
    return FC.gbt_lag_forecast(t.series)


def _two_models(t: Tables):
    """Each day of each station predicted by the mean of its last seven days and by its last value."""
    from pyspark.sql import Window

    order = Window.partitionBy("station").orderBy("date")
    rows = t.series.withColumns({
        "Media": F.avg("volume").over(order.rowsBetween(-7, -1)), "Ultimo": F.lag("volume").over(order),
    })
    return rows.select("station", "date", F.col("volume").alias("actual"), "Media", "Ultimo").unpivot(
        ["station", "date", "actual"], ["Media", "Ultimo"], "model", "prediction"
    ).filter(F.col("prediction").isNotNull())


_TWO_MODELS = """
    SELECT * FROM (
      SELECT station, date, volume AS actual, unnest(['Media', 'Ultimo']) AS model, unnest([mean, last]) AS prediction
      FROM (SELECT *, avg(volume) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean,
                   lag(volume) OVER (PARTITION BY station ORDER BY date) AS last FROM series))
    WHERE prediction IS NOT NULL"""


@query("compare_models", f"""
    SELECT station, model, round(avg(abs(actual - prediction)), 2) AS mae,
           round(arg_min(abs(actual - prediction), date), 2) AS first_day_difference,
           round(arg_min(CASE WHEN prediction <> 0 THEN ROW(abs((actual - prediction) / prediction) * 100) ELSE ROW(NULL::DOUBLE) END, date)[1], 2) AS first_day_error
    FROM ({_TWO_MODELS}) GROUP BY 1, 2""", ["series"], ["mae", "first_day_difference", "first_day_error"])
def _(t):
    return FC.compare_models(_two_models(t))


@query("choose_best", f"""
    SELECT station, date, model, abs_error, prediction FROM (
      SELECT *, row_number() OVER (PARTITION BY station ORDER BY abs_error NULLS LAST, model) AS rn FROM (
        SELECT station, date, model, CASE WHEN abs(actual - prediction) >= 0 THEN abs(actual - prediction) END AS abs_error, prediction
        FROM ({_TWO_MODELS}) WHERE date = DATE '2001-11-04')) WHERE rn = 1""", ["series"], ["abs_error", "prediction"])
def _(t):
    rows = _two_models(t).withColumn("abs_error", F.abs(F.col("actual") - F.col("prediction")))
    return FC.choose_best(rows.drop("actual"), dt.date(2001, 11, 3))


def _routing(t: Tables):
    """Two tuning dates over the last days of every series, with the served model read off the volumes."""
    last, before = dt.date(2001, 11, 4), dt.date(2001, 11, 3)
    preds = t.series.filter(F.col("date") >= F.lit(before))
    mean = preds.select("station", F.lit(FC.MEAN).alias("model"), "date", (F.col("volume") + 1).alias("prediction"))
    additive = preds.select("station", F.lit(FC.ADDITIVE).alias("model"), "date", (F.col("volume") * 2).alias("prediction"))
    balance = F.col("s_acctbal")
    share = F.when(balance > 1000, F.abs(balance) / 10000)
    now = t.supplier.select(
        F.col("s_suppkey").alias("station"), share.alias("share15"), F.lit(last).alias("registered_at"), F.lit(True).alias("is_current")
    )
    tuning = now.unionByName(now.withColumns({"registered_at": F.lit(before), "is_current": F.lit(False)}))
    states = t.states.select("station", "state", F.lit(True).alias("is_current"))
    served = F.when(balance > 5000, FC.ADDITIVE).otherwise(FC.MEAN)
    results = t.supplier.select(F.col("s_suppkey").alias("station"), F.lit(before).alias("date"), served.alias("model"))
    return mean, additive, tuning, states, results


_ROUTED = """
    SELECT s.station, CASE WHEN averaged THEN 'Media' ELSE 'Prophet' END AS model, date, CASE WHEN averaged THEN volume + 1 ELSE volume * 2 END AS prediction
    FROM (SELECT s.station, date, volume, CASE WHEN date = DATE '2001-11-04'
                 THEN coalesce(CASE WHEN s_acctbal > 1000 THEN s_acctbal / 10000 END, -1) < 0.4 OR state = 'NUEVA'
                 ELSE s_acctbal <= 5000 END AS averaged
          FROM series s JOIN supplier ON s_suppkey = s.station JOIN states k ON k.station = s.station
          WHERE date >= DATE '2001-11-03') s"""


@query("route_models", _ROUTED, ["series", "states"], ["prediction"])
def _(t):
    return FC.route_models(*_routing(t))


@query("forecast_results", f"""
    SELECT p.station, p.date, model, prediction, station_name, user_type, device, volume, abs(prediction - volume) / nullif(volume, 0) AS error
    FROM ({_ROUTED}) p LEFT JOIN stations ON stations.station = p.station
    LEFT JOIN daily ON daily.station = p.station AND daily.date = p.date""", ["series", "states", "stations", "daily"],
       ["prediction", "volume", "error"])
def _(t):
    return FC.forecast_results(FC.route_models(*_routing(t)), t.daily, t.stations, "2001-11-03")


@query("update_results", """
    SELECT station, date, 'Media' AS model, CASE WHEN date >= DATE '2001-10-01' THEN volume + 1 ELSE volume END AS prediction FROM daily""",
       ["daily"], ["prediction"])
def _(t):
    old = t.daily.filter(F.col("date") < F.lit(dt.date(2001, 10, 20))).select(
        "station", "date", F.lit("Media").alias("model"), F.col("volume").alias("prediction")
    )
    new = t.daily.filter(F.col("date") >= F.lit(dt.date(2001, 10, 1))).select(
        "station", "date", F.lit("Media").alias("model"), (F.col("volume") + 1).alias("prediction")
    )
    return FC.update_results(old, new)


@query("sequences", """
    SELECT station, date, w[1:29] AS inputs, volume AS target FROM (
      SELECT station, date, volume, list(volume) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w FROM daily)
    WHERE len(w) = 30""", ["daily"], ["target"])
def _(t):
    return S.sequences(t.daily)


# Similarity -----------------------------------------------------------------------------------


# A diagonal of the warping tables a round, of which only the last is kept: entry i of `now` is cell (i - 1, diagonal - i + 1), with a
# border in row and column 0.
_TO_STATION = """
    WITH RECURSIVE arrays AS MATERIALIZED (SELECT station, list(CAST(volume AS DOUBLE) ORDER BY date) AS v FROM daily GROUP BY 1),
      pairs AS MATERIALIZED (
        SELECT a.station AS a, b.station AS b, a.v AS x, b.v AS y
        FROM arrays a JOIN arrays b ON b.station = (SELECT station FROM daily GROUP BY 1 ORDER BY sum(volume) DESC, station LIMIT 1)),
      warped(a, diagonal, before, now) USING KEY (a) AS (
        SELECT a, 1, list_concat([0::DOUBLE], list_transform(range(len(x)), lambda i: 'inf'::DOUBLE)), list_transform(range(len(x) + 1), lambda i: 'inf'::DOUBLE)
        FROM pairs
        UNION
        SELECT a, diagonal + 1, now, list_concat(['inf'::DOUBLE], list_transform(range(1, len(x) + 1), lambda i:
                 CASE WHEN diagonal + 1 - i BETWEEN 1 AND len(y)
                      THEN power(x[i] - y[diagonal + 1 - i], 2) + least(now[i], now[i + 1], before[i]) ELSE 'inf'::DOUBLE END))
        FROM warped JOIN pairs USING (a) WHERE diagonal < len(x) + len(y))
    SELECT a, b, sqrt(now[len(x) + 1]) AS distance FROM warped JOIN pairs USING (a)"""


@query("dtw_to_station", f"SELECT * FROM ({_TO_STATION})", ["daily"], ["distance"])
def _(t):
    """Every station against the station with the largest total, as the report reads its distances."""
    reference = R.top_k(S.period_totals(t.daily, "station"), "volume", 1, ties=["station"]).select("station")
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), reference.scalar().alias("b"))
    return SM.dtw_pairs(t.daily, pairs)


@query("dtw_closest_fifth")
def _(t):
    reference = R.top_k(S.period_totals(t.daily, "station"), "volume", 1, ties=["station"]).select("station")
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), reference.scalar().alias("b"))
    distances = SM.dtw_pairs(t.daily, pairs).filter(F.col("a") != F.col("b"))
    edge = RK.quantiles(distances, "distance", [0.2]).select(F.col("q")[0]).scalar()
    return distances.filter(F.col("distance") <= edge)


_QUARTERS = """
    SELECT station, list(volume ORDER BY quarter) AS v FROM (
      SELECT station, date_trunc('quarter', date) AS quarter, sum(volume) AS volume FROM daily GROUP BY 1, 2) GROUP BY 1"""


def _quarters(t: Tables):
    quarter = F.trunc("date", "quarter")
    return t.daily.groupBy("station", quarter.alias("date")).agg(F.sum("volume").alias("volume"))


@query("nearest_quarters", f"""
    SELECT query, station, distance, CAST(place AS INTEGER) AS place FROM (
      WITH RECURSIVE arrays AS MATERIALIZED ({_QUARTERS}),
      pairs AS MATERIALIZED (SELECT a.station AS query, b.station AS station, a.v AS x, b.v AS y FROM arrays a JOIN arrays b ON a.station <> b.station),
      warped(query, station, diagonal, before, now) USING KEY (query, station) AS (
        SELECT query, station, 1, list_concat([0::DOUBLE], list_transform(range(len(x)), lambda i: 'inf'::DOUBLE)),
               list_transform(range(len(x) + 1), lambda i: 'inf'::DOUBLE) FROM pairs
        UNION
        SELECT query, station, diagonal + 1, now, list_concat(['inf'::DOUBLE], list_transform(range(1, len(x) + 1), lambda i:
                 CASE WHEN diagonal + 1 - i BETWEEN 1 AND len(y)
                      THEN power(x[i] - y[diagonal + 1 - i], 2) + least(now[i], now[i + 1], before[i]) ELSE 'inf'::DOUBLE END))
        FROM warped JOIN pairs USING (query, station) WHERE diagonal < len(x) + len(y))
      SELECT query, station, sqrt(now[len(x) + 1]) AS distance,
             row_number() OVER (PARTITION BY query ORDER BY round(sqrt(now[len(x) + 1]), 9), station) AS place
      FROM warped JOIN pairs USING (query, station))
    WHERE place <= 3""", ["daily"], ["distance"])
def _(t):
    quarters = _quarters(t)
    return SM.nearest_series(quarters, None, 3)


@query("nearest_days")
def _(t):
    """The nearest stations, by daily volumes, of every station."""
    return SM.nearest_series(t.daily, t.supplier.select(F.col("s_suppkey").alias("station")), 5)


@query("granger_pairs")
def _(t):
    """Neighbouring stations, both directions, on cumulative volumes."""
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return SM.granger_pairs(R.running_sum(t.series, "station", "date", "volume"), pairs, value="running")


@query("granger_lag_one", """
    SELECT cause, effect, n, n * (syy - sy1 * sy1 / s11) AS ssr_own,
           n * (syy - (sy1 * sy1 * sxx - 2 * sy1 * sxy * s1x + sxy * sxy * s11) / (s11 * sxx - s1x * s1x)) AS ssr_full
    FROM (SELECT cause, effect, count(*) AS n, var_pop(y) AS syy, var_pop(y1) AS s11, var_pop(x1) AS sxx,
                 covar_pop(y, y1) AS sy1, covar_pop(y, x1) AS sxy, covar_pop(y1, x1) AS s1x
          FROM (SELECT station, date, volume AS y, lag(volume) OVER (PARTITION BY station ORDER BY date) AS y1 FROM series) e
          JOIN (SELECT s_suppkey AS cause, s_suppkey + 1 AS effect FROM supplier UNION ALL SELECT s_suppkey + 1, s_suppkey FROM supplier) p ON e.station = p.effect
          JOIN (SELECT station, date, lag(volume) OVER (PARTITION BY station ORDER BY date) AS x1 FROM series) c ON c.station = p.cause AND c.date = e.date
          WHERE y1 IS NOT NULL AND x1 IS NOT NULL GROUP BY 1, 2)""", ["series"], ["ssr_own", "ssr_full"])
def _(t):
    """With one lag both regressions have closed forms."""
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return SM.granger_pairs(t.series, pairs, lag=1).select("cause", "effect", "n", "ssr_own", "ssr_full")


@query("cluster_profiles")
def _(t):
    return SM.cluster_profiles(t.series)


# Merges on series -----------------------------------------------------------------------------


@query("scd2_states", """
    SELECT station, volume_class, registered_at, is_current FROM (
      SELECT station, old AS volume_class, DATE '2001-01-01' AS registered_at, NOT (new IS NOT NULL AND old IS DISTINCT FROM new) AS is_current
      FROM classes WHERE old IS NOT NULL
      UNION ALL SELECT station, new, DATE '2001-11-05', true FROM classes WHERE new IS NOT NULL AND old IS DISTINCT FROM new)""".replace(
    "FROM classes", """FROM (SELECT station, max(CASE WHEN date < DATE '2001-01-01' THEN CASE WHEN volume > 40 THEN 'alto' ELSE 'bajo' END END) FILTER (rn_old = 1) AS old,
               max(CASE WHEN volume > 40 THEN 'alto' ELSE 'bajo' END) FILTER (rn_new = 1) AS new
        FROM (SELECT *, CASE WHEN date < DATE '2001-01-01' THEN row_number() OVER (PARTITION BY station, date < DATE '2001-01-01' ORDER BY date DESC) END AS rn_old,
                     row_number() OVER (PARTITION BY station ORDER BY date DESC) AS rn_new FROM daily) GROUP BY station)"""), ["daily"])
def _(t):
    def snapshot(rows):
        last = R.first_per_key(rows, ["station"], [F.col("date").desc()])
        return last.select("station", F.when(F.col("volume") > 40, "alto").otherwise("bajo").alias("volume_class"))

    first, second = F.lit(dt.date(2001, 1, 1)), F.lit(dt.date(2001, 11, 5))
    dim = snapshot(t.daily.filter(F.col("date") < first)).withColumns({"registered_at": first, "is_current": F.lit(True)})
    return M.scd2_merge(dim, snapshot(t.daily), "station", ["volume_class"], second)


@query("version_history", """
    SELECT station, w1, w2, rmse, DATE '2001-10-05' AS registered_at, false AS is_current FROM weights
    UNION ALL SELECT station, w1 / 2, w2 / 2, rmse, DATE '2001-11-05', true FROM weights""", ["weights"], ["w1", "w2", "rmse"])
def _(t):
    fitted = staged(FC.fit_mean_weights(t.stated))  # one row per station, read as the old and as the new version
    old = fitted.withColumns({"registered_at": F.lit(dt.date(2001, 10, 5)), "is_current": F.lit(True)})
    new = fitted.withColumns({"w1": F.col("w1") / 2, "w2": F.col("w2") / 2})
    return M.append_version(old, new, F.lit(dt.date(2001, 11, 5)))


def _merged(t: Tables) -> KeyedTable:
    """Daily volumes as a table by key; the days from October 2001 on of every third station are then merged into it, negated."""
    table = KeyedTable(f"{shared_folder(t.spark)}/daily-{uuid.uuid4().hex}", ("station",), 16)
    table.create(t.daily.groupBy("station").agg(F.sum("volume").alias("volume"), F.max("date").alias("last_date")))
    late = t.daily.filter((F.col("date") >= F.lit(dt.date(2001, 10, 1))) & (F.col("station") % 3 == 0)).groupBy("station").agg(
        F.sum(-F.col("volume")).alias("volume"), F.max("date").alias("last_date")
    )
    table.merge(late.unionByName(late.limit(1).withColumn("station", F.col("station") + 1_000_000)))
    return table


@query("merged_table", """
    SELECT station, coalesce(n.volume, o.volume) AS volume, last_date FROM (SELECT station, sum(volume) AS volume, max(date) AS last_date FROM daily GROUP BY 1) o
    LEFT JOIN (SELECT station, -sum(volume) AS volume FROM daily WHERE date >= DATE '2001-10-01' AND station % 3 = 0 GROUP BY 1) n USING (station)
    """, ["daily"], ["volume"])
def _(t):
    """An upsert into a living table: only the buckets of the changed stations are read and written."""
    return _merged(t).read(t.spark).filter(F.col("station") < 1_000_000)


@query("history_appends", """
    SELECT station, date, volume, CAST(year(date) AS VARCHAR) AS batch FROM daily WHERE year(date) IN (1997, 1998)""", ["daily"], ["volume"])
def _(t):
    """Yearly batches added to a history of files; 1998 is added twice and is there once."""
    path = f"{shared_folder(t.spark)}/history-{uuid.uuid4().hex}"
    for year in (1997, 1998, 1998):
        TB.append_batch(t.daily.filter(F.year("date") == year), path, str(year))
    return t.spark.read.schema(f"{t.daily._jdf.schema().toDDL()}, batch string").parquet(path)


@query("csv_round_trip", "SELECT station, date, volume FROM daily", ["daily"], ["volume"])
def _(t):
    """Daily volumes written as CSV and read with a declared schema; no line is unreadable, or the query fails."""
    path = f"{shared_folder(t.spark)}/daily-csv-{uuid.uuid4().hex}"
    rows = t.daily.select("station", "date", F.col("volume").cast("double").alias("volume"))
    rows.write.option("header", True).csv(path)
    good, bad = TB.load_csv_checked(t.spark, path, rows.schema)
    failed = bad.select(F.raise_error(F.concat(F.lit("unreadable line: "), F.col(TB.UNREADABLE))).cast("bigint").alias("station"))
    return good.unionByName(failed.select("station", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("volume")))


@query("insert_new", "SELECT station, date, CASE WHEN date < DATE '2001-06-01' THEN volume ELSE -volume END AS volume FROM daily", ["daily"], ["volume"])
def _(t):
    target = t.daily.filter(F.col("date") < F.lit(dt.date(2001, 6, 1)))
    return M.insert_new(target, t.daily.withColumn("volume", -F.col("volume")), ["station", "date"])


@query("upsert_columns", """
    SELECT station, date, volume, CASE WHEN date >= DATE '2000-01-01' THEN 'nuevo' ELSE 'viejo' END AS origin FROM daily""", ["daily"], ["volume"])
def _(t):
    target = t.daily.filter(F.col("date") < F.lit(dt.date(2001, 1, 1))).withColumn("origin", F.lit("viejo"))
    updates = t.daily.filter(F.col("date") >= F.lit(dt.date(2000, 1, 1))).withColumn("origin", F.lit("nuevo"))
    changed = updates.withColumn("volume", F.when(F.col("date") < F.lit(dt.date(2001, 1, 1)), -1.0).otherwise(F.col("volume")))
    return M.upsert(target, changed, ["station", "date"], columns=["origin"])
