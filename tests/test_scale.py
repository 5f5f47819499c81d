"""Steps whose cost must follow the rows they make, not the bytes they are given."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridlytics.operators import boosting as B
from gridlytics.operators import forecast as FC
from gridlytics.operators import outliers as O
from gridlytics.operators import series as S
from gridlytics.plans import registry as RG

DAY = dt.date(2024, 1, 1)


def calendar(spark):
    return spark.createDataFrame([(DAY,)], "date date")


def test_completed_days_are_dealt_by_their_number(spark):
    rows = [(k, DAY, 1.0) for k in range(64)] + [(k, dt.date(2001, 1, 1), 1.0) for k in range(64)]
    df = S.daily(spark.createDataFrame(rows, "station int, date date, volume double"))
    parts = S.series_parts(df, "station", "date", "2024-01-02")
    assert parts >= 1
    dealt = S.complete_dates(df, calendar(spark), "2024-01-02", parts=23)
    assert dealt.rdd.getNumPartitions() == 23
    assert sorted(dealt.collect()) == sorted(S.complete_dates(df, calendar(spark), "2024-01-02").collect())


def test_number_of_parts_follows_stations_and_days(spark, monkeypatch):
    df = spark.createDataFrame([(k, dt.date(2023, 1, 1), 1.0) for k in range(100)], "station int, date date, volume double")
    monkeypatch.setattr(S, "DAYS_PER_TASK", 1000)
    assert 30 <= S.series_parts(df, "station", "date", "2024-01-01") <= 45
    assert S.series_parts(df.filter("station < 0"), "station", "date", "2024-01-01") == 1


def test_recent_features_sort_only_the_days_they_reach(spark):
    """The means are those of all rows, taken one by one, and the rows they can't reach do not come to their windows."""
    rng, rows = np.random.default_rng(3), []
    for station in range(3):
        kept = sorted(rng.choice(400, 250, replace=False))
        for at in kept:
            day = DAY + dt.timedelta(days=int(at))
            rows.append((station, day, float(rng.integers(0, 40)), int(rng.random() < 0.05), day.weekday(), S.ACTIVE))
    df = spark.createDataFrame(rows, "station int, date date, volume double, holiday int, weekday int, state string")
    table = pd.DataFrame(rows, columns=df.columns)
    got = FC.recent_features(df, 15, 4).toPandas()
    assert len(got) == 45
    for r in got.itertuples():
        before = table[(table.station == r.station) & (table.date <= r.date)]
        assert abs(before[before.weekday == r.weekday].volume.tail(4).mean() - r.same_day) < 1e-9
        if r.holiday == 1:
            assert abs(before[before.holiday == 1].volume.tail(4).mean() - r.holiday_mean) < 1e-9
    assert FC._mean_features(df, 4, 16).count() < len(rows) - 100


def test_a_tree_of_one_feature_is_that_of_all_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (500, 1)).astype(float)
    residual, cuts = rng.normal(0, 10, 500), B.cut_points(x, 256)
    codes, size = B.coded(x, cuts), len(cuts[0]) + 1
    whole = B.grow(codes, size, residual, 6, 0.3)
    one, at_code = B.grow_one(codes[:, 0], np.bincount(codes[:, 0], minlength=size), residual, 6, 0.3)
    assert (whole.predict(codes) == one.predict(codes)).all() and (at_code[codes[:, 0]] == one.predict(codes)).all()


def test_flexibilities_share_one_elimination():
    rng = np.random.default_rng(2)
    days, y = np.arange(500.0), rng.normal(50, 10, 500)
    every = FC._Cutoffs(days, y, np.zeros(500))
    gram, cross, row, basis = every.equations(480)
    noise = FC._noise(gram, cross, float(y[:480] @ y[:480]), 480.0)
    for scale, got in zip(FC.SCALE_GRID, FC._by_scale(gram, cross, row, basis, noise, FC.SCALE_GRID)):
        beta = np.linalg.solve(gram + noise * np.diag(basis.penalty(len(cross), scale)), cross)
        assert abs(beta @ row - got) < 1e-6


def test_pooled_trees_are_fitted_to_cells(spark):
    """Trees over cells are the trees over all rows, once both are cut at the same places."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(4)
    values = [(float(a), float(b), float(a * 2 + b + rng.normal())) for a, b in rng.integers(0, 20, (3000, 2))]
    df = spark.createDataFrame(values, "a double, b double, label double")
    cells, bins = FC.binned_cells(df, ["a", "b"], "label")
    assert cells.count() <= 400 and abs(cells.agg(F.sum("weight")).first()[0] - 3000) < 1e-9
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    args = {"maxIter": 5, "maxDepth": 4, "seed": 7}
    coded = df.select(*[c.alias(n) for n, c in bins.items()], "label")
    whole = GBTRegressor(**args).fit(rows.transform(coded)).transform(rows.transform(coded))
    few = GBTRegressor(weightCol="weight", **args).fit(rows.transform(cells)).transform(rows.transform(coded))
    for x, y in zip(whole.collect(), few.collect()):
        assert (x.a, x.b) == (y.a, y.b) and abs(x.prediction - y.prediction) < 1e-6


# ---- fits ----


def test_columns_that_do_not_vary_are_left_out_and_nothing_changes(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from gridlytics.operators import models as MD

    rng = np.random.default_rng(5)
    rows = [(k, float(rng.normal() + k % 2), int(rng.integers(0, 4) * 25), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, code int, label int")
    stages = [OneHotEncoder(inputCols=["code"], outputCols=["c"], handleInvalid="keep"), VectorAssembler(inputCols=["x", "c"], outputCol="assembled"),
              StandardScaler(inputCol="assembled", outputCol="features")]
    whole = Pipeline(stages=stages).fit(df)
    narrow, left = MD.varying_features(whole)
    assert left == [0, 1, 26, 51, 76] and narrow.transform(df).first().features.size == 5
    unseen = df.withColumn("code", F.col("code") + 1)  # what the training rows lack is 0 in both
    for rows in (df, unseen):
        wide = whole.transform(rows).orderBy("k").select(vector_to_array("features")).collect()
        assert [[r[0][k] for k in left] for r in wide] == [r[0] for r in narrow.transform(rows).orderBy("k").select(vector_to_array("features")).collect()]
        assert all(v == 0 for r in wide for k, v in enumerate(r[0]) if k not in left)
    layers = [len(whole.stages[-1].std), 4, 2]
    one = MD.score(MD.fit_classifier("perceptron", whole.transform(df), layers=layers, maxIter=10, seed=7), whole.transform(df), ["k"])
    two = MD.score(MD.fit_perceptron(narrow.transform(df), layers, left, maxIter=10, seed=7), narrow.transform(df), ["k"])
    assert np.allclose([r[1] for r in sorted(one.collect())], [r[1] for r in sorted(two.collect())], atol=1e-6)


def test_a_fit_that_has_converged_stands_for_those_with_more_steps(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from gridlytics.operators import models as MD

    rng = np.random.default_rng(6)
    rows = [(k, float(rng.normal() + k % 2), k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, label int")
    prepare = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")])
    seen, fit = [], MD.fit_classifier
    monkeypatch.setattr(MD, "fit_classifier", lambda kind, train, **p: seen.append(p["maxIter"]) or fit(kind, train, **p))
    points = [{"maxIter": n, "regParam": r} for n in (500, 1, 100) for r in (0.1,)]
    areas = MD.fold_areas("logistic", df, points, prepare, ["k"], 2, "label", 2, 0)
    assert sorted(seen) == [1, 1, 100, 100]  # one step does not converge, 100 do, 500 add nothing
    assert areas[0] == areas[2]


def test_rows_of_a_fit_are_dealt_by_their_number(spark, monkeypatch):
    from gridlytics.operators import models as MD

    monkeypatch.setattr(MD, "ROWS_PER_TASK", 50)
    assert MD.dealt(spark.range(0, 1000, 1, 2)).rdd.getNumPartitions() == 20
    few = MD.dealt(spark.range(0, 100, 1, 3))
    assert few.rdd.getNumPartitions() == 3 and few.count() == 100


# ---- pairs ----


def test_days_of_pairs_are_not_dealt_by_date(spark):
    from gridlytics.operators import similarity as SM

    rng, lag = np.random.default_rng(7), 2
    series = {s: {DAY + dt.timedelta(d): float(rng.normal()) for d in range(60) if s != 2 or d not in (20, 21, 40)} for s in (1, 2, 3)}
    series[3][DAY + dt.timedelta(9)] = None
    df = spark.createDataFrame([(s, d, v) for s, days in series.items() for d, v in days.items()], "station int, date date, volume double")
    out = SM.granger_pairs(df, spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int"), lag=lag)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(effect" in line and "date" in line]
    got = {(r.cause, r.effect): r for r in out.collect()}
    assert set(got) == {(1, 2), (2, 1), (2, 3), (3, 2)}

    def lags(s):
        days = sorted(series[s])
        return {d: [series[s][days[i - k]] for k in range(lag + 1)] for i, d in enumerate(days) if i >= lag and None not in [series[s][days[i - k]] for k in range(lag + 1)]}

    for (cause, effect), row in got.items():
        x, y = lags(cause), lags(effect)
        days = sorted(set(x) & set(y))
        label = np.array([y[d][0] for d in days])
        own = np.array([[1, *y[d][1:]] for d in days])
        full = np.array([[1, *y[d][1:], *x[d][1:]] for d in days])
        left = [float(np.sum((label - m @ np.linalg.lstsq(m, label, rcond=None)[0]) ** 2)) for m in (own, full)]
        assert row.n == len(days) and np.allclose([row.ssr_own, row.ssr_full], left)


def test_series_of_a_search_are_made_once(spark, monkeypatch):
    from gridlytics.operators import similarity as SM

    calls = []
    monkeypatch.setattr(SM, "staged", lambda df: calls.append(1) or df)
    df = spark.createDataFrame([(s, DAY + dt.timedelta(d), float(s * d)) for s in range(4) for d in range(5)], "station int, date date, volume double")
    assert SM.nearest_series(df, df.select("station"), 2).count() == 8 and calls == [1]


def test_a_corrected_series_is_not_shuffled_after_its_fit(spark):
    rows = [(k, DAY + dt.timedelta(days=i), float(i % 7), 0) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "station int, date date, volume double, holiday int")
    text = O.correct_outliers_trend(df)._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above


def test_block_deviations_follow_the_rows(spark):
    """Against a loop over the fit's rows: short last blocks, single rows, a missing volume, rows out of order, a day given twice."""
    rng = np.random.default_rng(8)
    sizes = {1: 1, 2: 2, 3: 15, 4: 16, 5: 31, 6: 64, 7: 62}
    rows = [(k, DAY + dt.timedelta(days=i - (k == 7 and i == 20)), float(rng.integers(0, 9)), 0) for k, n in sizes.items() for i in range(n)]
    rows[80] = (*rows[80][:2], None, 0)
    df = spark.createDataFrame(rows[::-1], "station int, date date, volume double, holiday int")
    got = O.correct_outliers_trend(df).toPandas()
    assert len(got) == len(rows) - 1 and list(got.columns[4:]) == ["trend", "yhat", "lower", "upper", "deviation", "sd1", "sd2", "outlier", "corrected"]
    for _, part in got.groupby("station"):
        part = part.sort_values("date", kind="stable").reset_index(drop=True)
        assert np.allclose(part.deviation, part.volume - part.trend)
        for name, size in (("sd1", 30), ("sd2", 15)):
            for start in range(0, len(part), size):
                inside = part.deviation[start : min(start + size, len(part) - 1)]
                want = np.sqrt((inside**2).sum() / (len(inside) - 1)) if len(inside) > 1 else np.nan
                assert np.allclose(part[name][start : start + size].astype(float), want, equal_nan=True)


def test_shared_seasons_are_those_of_the_days():
    seasons, rng = FC._Seasons(), np.random.default_rng(9)
    cases = [np.arange(9000.0, 11500.0), np.arange(-600.0, 700.0), np.sort(rng.choice(40000, 1500)).astype(float), np.array([3.0, 3.0, 90000.0])]
    for days in (*cases, *(np.arange(k * 5000.0, k * 5000.0 + 900) for k in range(40))):
        holiday = (days % 30 == 0).astype(float)
        basis = FC._Basis(days, True)
        shared, lead = basis.columns(days, holiday, seasons)
        assert np.allclose(shared, basis.columns(days, holiday)[0], rtol=0, atol=1e-12) and lead == 2 + len(basis.hinges)
        assert len(seasons.blocks) <= FC.SEASON_BLOCKS
    fewer = FC._Basis(np.arange(30.0), False).columns(np.arange(30.0), np.zeros(30), seasons)[0]
    assert fewer.shape == (30, 2 + 23 + 6) and np.allclose(fewer[:, -6], np.sin(2 * np.pi * np.arange(30) / 7))


def test_quick_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(10)
    values = [float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-7, -5e-7, 1e308, 5e-324, 9999999.9999995, 1e7, 0.0000015, 2.5e-6, None]
    values += [float(v) for v in [*rng.normal(size=500), *(rng.integers(0, 10**9, 500) * 2 + 1) / 2e6, *rng.random(500) * 1e9, *rng.random(500) * 1e-5]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    both = df.select("x", (F.round("x", 6) + F.lit(0.0)).alias("plain"), (RG._places(F.col("x")) + F.lit(0.0)).alias("quick"))
    assert both.filter(~F.col("plain").eqNullSafe(F.col("quick"))).count() == 0
    text = RG.rounded(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in text.lower()


def test_rows_of_a_feed_are_dealt_by_key_before_they_are_added_up(spark, monkeypatch):
    rows = [(f"s{k % 9}", None if k % 5 == 0 else f"d{k % 3}", "R0", DAY + dt.timedelta(days=k % 11) if k % 13 else None, float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "station_name string, device string, user_type string, date date, volume double")
    monkeypatch.setattr(S, "ROWS_PER_TASK", 20)
    assert S.feed_parts(df) == 20 and S.feed_parts(df.limit(0)) == 1
    dealt = S.merge_feeds(df, S.feed_totals(df, 20), {"s1": "D-99"}, 20)
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in text
    plain = S.merge_feeds(df, S.feed_totals(df), {"s1": "D-99"})
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(dealt.collect(), key=key) == sorted(plain.collect(), key=key)
    assert dealt.rdd.getNumPartitions() >= 20
