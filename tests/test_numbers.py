"""Numerical operators against brute force on small fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlytics.functions import special as SP
from gridlytics.operators import forecast as FC
from gridlytics.operators import models as MD
from gridlytics.operators import outliers as O
from gridlytics.operators import portfolio as P
from gridlytics.operators import ranks as RK
from gridlytics.operators import segments as G
from gridlytics.operators import series as S
from gridlytics.operators import similarity as SM
from gridlytics.operators import stats as ST

START = dt.date(2022, 1, 1)


def frame(spark, table):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, vs in table.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "station int, date date, volume double").withColumn("holiday", F.lit(0))


def test_special_functions_known_values():
    assert np.isclose(SP.gamma_upper(0.5, 3.841458820694124 / 2), 0.05, atol=1e-10)
    assert np.isclose(SP.gamma_upper(10, 31.410432844230918 / 2), 0.05, atol=1e-10)
    t = 2.2281388519649385  # two-sided 5 % point with 10 degrees of freedom
    assert np.isclose(SP.beta_lower(5.0, 0.5, 10 / (10 + t * t)), 0.05, atol=1e-10)
    assert np.isclose(SP.f_cdf(np.array([4.102821]), 2, 10)[0], 0.95, atol=1e-6)
    assert np.isclose(SP.kolmogorov_sf(np.array([0.0]), 100)[0], 1.0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=60))
def test_quantile_arithmetic(values):
    array = np.sort(np.array(values))
    for p in (0.2, 0.5, 0.99):
        place = (len(array) - 1) * p
        low = math.floor(place)
        high = min(low + 1, len(array) - 1)
        assert np.isclose(array[low] + (array[high] - array[low]) * (place - low), np.quantile(array, p))


def test_ranks_with_a_hot_value_and_a_hot_key(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(4000, 7.0), rng.lognormal(3, 2, 4000), 1e6 + rng.random(2000) * 1e-3])
    keys = np.where(np.arange(len(values)) % 10 < 7, 1, np.arange(len(values)) % 5 + 2)
    pdf = pd.DataFrame({"k": keys, "v": values})
    df = spark.createDataFrame(pdf)
    out = {r.k: r.q for r in RK.quantiles(df, "v", [0.0, 0.2, 0.5, 0.95, 1.0], ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        assert np.allclose(out[k], np.quantile(part.v, [0.0, 0.2, 0.5, 0.95, 1.0]), rtol=1e-12)
    ranked = RK.ranked_values(df, "v").toPandas().sort_values("value")
    assert ranked.below.tolist() == np.searchsorted(np.sort(values), ranked.value, side="left").tolist()


def test_quantile_scores_equal_qcut(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 500, 800).astype(float), "y": rng.lognormal(2, 1, 800)})
    out = G.quantile_scores(spark.createDataFrame(pdf), ["x", "y"], reverse=["x"]).toPandas()
    assert (6 - out.x_score == pd.qcut(out.x, 5, labels=False) + 1).all()
    assert (out.y_score == pd.qcut(out.y, 5, labels=False) + 1).all()


def test_width_score_equals_cut(spark):
    pdf = pd.DataFrame({"x": np.random.default_rng(6).integers(3, 200, 300).astype(float)})
    out = G.width_score(spark.createDataFrame(pdf), "x").toPandas()
    assert (5 - out.x_score == pd.cut(out.x, 5, labels=False)).all()


def test_hampel_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    table = {1: rng.normal(50, 5, 60), 2: rng.normal(50, 5, 15), 3: [4.0] * 30}
    table[1][20] = 400.0
    for w in (7, 20):
        out = O.correct_outliers_hampel(frame(spark, table), w=w).toPandas().sort_values(["station", "date"])
        for k, values in table.items():
            got, v = out[out.station == k], np.asarray(values)
            day = np.array([(START + dt.timedelta(days=i)).weekday() for i in range(len(v))])
            for i in range(len(v)):
                part = v[max(0, i - w) : min(len(v), i + w)]
                mid = np.median(part)
                far = abs(v[i] - mid) > 3 * 1.4826 * np.median(np.abs(part - mid))
                expected = v[day == day[i]][-4:].sum() / 4 if far else v[i]
                assert np.isclose(got.corrected.iloc[i], expected)


def test_weights_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    values = rng.uniform(10, 30, 60)
    df = frame(spark, {1: values}).withColumn("weekday", F.weekday("date")).withColumn("state", F.lit(S.ACTIVE))
    w = FC.fit_mean_weights(df).first()
    rows, target = [], []
    day = np.array([(START + dt.timedelta(days=i)).weekday() for i in range(60)])
    for i in range(44, 59):
        past, week = values[: i + 1], day[: i + 1]
        rows.append([past[week == day[i]][-4:].mean() / 2, past[-(day[i] + 1):].mean() / 2])
        target.append(values[i + 1])
    beta, *_ = np.linalg.lstsq(np.array(rows), np.array(target), rcond=None)
    assert np.allclose([w.w1, w.w2], beta)
    assert np.isclose(w.rmse, np.sqrt(np.mean((np.array(rows) @ beta - target) ** 2)))


def test_grouped_ols_with_large_offsets(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.repeat([1, 2], 200), "a": 1e7 + rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = np.where(pdf.g == 1, 3 * pdf.a - pdf.b, -2 * pdf.a + 5 * pdf.b) + 11
    fit = {r.g: r for r in ST.grouped_ols(spark.createDataFrame(pdf), ["g"], ["a", "b"], "y").collect()}
    assert np.allclose(fit[1].coefficients[:2], [3, -1], atol=1e-5) and np.allclose(fit[2].coefficients[:2], [-2, 5], atol=1e-5)


def test_pca_score_equals_svd(spark):
    rng = np.random.default_rng(7)
    rows = []
    for kind in (7014, 7055):
        for interval in (6, 12):
            x = rng.random((80, 3))
            rows += [(i, kind, interval, *map(float, x[i]), float(x[i, 0] * 0.5), float(x[i, 1] * 0.3), float(i % 4) / 4) for i in range(80)]
    cols = "product_id int, product_type int, interval int, v_payment double, v_arrears double, v_refinancing double, v_suspension double, v_desync double, v_writeoff double"
    out = P.pca_score(spark.createDataFrame(rows, cols))
    pdf = out.toPandas()
    assert pdf.scaled.between(0, 1).all() and pdf.score.between(0, 1).all()
    for _, part in pdf.groupby(["product_type", "interval"]):
        x = part[["v_payment", "v_arrears", "v_refinancing", "v_fourth"]].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        pc = z @ np.linalg.svd(z, full_matrices=False)[2][0]
        pc = pc if np.corrcoef(pc, x[:, 1])[0, 1] > 0 else -pc
        assert np.allclose(part.scaled, (pc - pc.min()) / (pc.max() - pc.min()), atol=1e-9)
    weights = P.score_weights(out).toPandas().merge(pdf, on=["product_type", "interval"])
    fitted = weights.intercept + sum(weights[f"w_{c}"] * weights[f"v_{c}"] for c in ("payment", "arrears", "refinancing", "fourth"))
    assert np.allclose(fitted, weights.scaled, atol=1e-6)


def test_anderson_darling_equals_the_sorted_sum(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(10, 2, 120).round(1), [10.0] * 30])
    got = ST.anderson_darling(spark.createDataFrame(pd.DataFrame({"k": 1, "v": values})), "k", "v").first()
    z = np.sort((values - values.mean()) / values.std(ddof=1))
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i, n = np.arange(1, len(z) + 1), len(z)
    assert np.isclose(got.statistic, -n - np.sum((2 * i - 1) * (np.log(phi) + np.log(1 - phi[::-1]))) / n)


def test_distributions_find_the_true_family(spark):
    rng = np.random.default_rng(9)
    for name, values in (("lognorm", rng.lognormal(2, 0.9, 4000)), ("gamma", rng.gamma(4, 3, 4000))):
        df = spark.createDataFrame(pd.DataFrame({"v": values}))
        assert ST.best_distribution(df, "v").first().distribution == name
    gamma = {r.distribution: r for r in ST.fit_distributions(df, "v").collect()}["gamma"]
    assert abs(gamma.shape - 4) < 0.4 and np.isclose(gamma.aic, 4 + 2 * gamma.nll)


def test_ks_scan_distance(spark):
    values = np.array([0.1, 0.4, 0.4, 1.0, 2.0, 5.0])
    out = ST.ks_f_scan(spark.createDataFrame(pd.DataFrame({"v": values})), "v", [2], [4]).first()
    cdf = 1 - (1 + 2 * np.sort(values) / 4) ** -2.0  # the F(2, 4) law in closed form
    i = np.arange(1, 7)
    assert np.isclose(out.distance, max((i / 6 - cdf).max(), (cdf - (i - 1) / 6).max()))


def test_dtw_equals_the_table(spark):
    rng = np.random.default_rng(10)
    table = {1: rng.random(12), 2: rng.random(9), 3: [0.5]}
    pairs = spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "a int, b int")
    got = {(r.a, r.b): r.distance for r in SM.dtw_pairs(frame(spark, table), pairs).collect()}

    def slow(x, y):
        t = np.full((len(x) + 1, len(y) + 1), np.inf)
        t[0, 0] = 0
        for i, u in enumerate(x, 1):
            for j, v in enumerate(y, 1):
                t[i, j] = (u - v) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
        return t[-1, -1] ** 0.5

    for (a, b), distance in got.items():
        assert np.isclose(distance, slow(table[a], table[b]))


def test_granger_finds_the_cause(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=200)
    y = np.concatenate([[0, 0], 0.8 * x[1:-1]]) + 0.1 * rng.normal(size=200)
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    got = {(r.cause, r.effect): r.p_value for r in SM.granger_pairs(frame(spark, {1: x, 2: y}), pairs).collect()}
    assert got[(1, 2)] < 1e-6 < got[(2, 1)]


def test_ar_forecast_continues_a_linear_recursion(spark):
    steps = [1.0, 0.5]
    for _ in range(60):
        steps.append(0.6 * steps[-1] + 0.3 * steps[-2] + 0.2)
    level = np.cumsum(steps)
    got = FC.ar_forecast(frame(spark, {1: level[:-1]}), p=2).first()
    assert np.isclose(got.prediction, level[-1], atol=1e-4)


def test_additive_model_follows_trend_and_week(spark):
    n = 400
    values = [100 + 0.2 * i + 10 * math.sin(2 * math.pi * i / 7) for i in range(n)]
    table = {1: values, 2: [-5.0] * 100, 3: [0.0] * 50}
    got = {r.station: r for r in FC.additive_forecast(frame(spark, table)).collect()}
    assert abs(got[1].prediction - (100 + 0.2 * n + 10 * math.sin(2 * math.pi * n / 7))) < 1.5
    assert got[1].date == START + dt.timedelta(days=n)
    assert got[2].prediction == 0.0 and got[3].prediction == 0.0
    tuned = {r.station: r for r in FC.tune_forecast(frame(spark, {1: values, 4: [1.0] * 10})).collect()}
    assert tuned[1].changepoint_scale in FC.SCALE_GRID and tuned[1].rmse < 2 and tuned[1].share5 == 1.0
    assert tuned[4].changepoint_scale is None


def test_trend_correction_removes_one_spike(spark):
    rng = np.random.default_rng(12)
    values = 100 + rng.normal(0, 3, 200)
    values[77] = 900
    out = O.correct_outliers_trend(frame(spark, {1: values})).filter("outlier").collect()
    assert [r.date for r in out] == [START + dt.timedelta(days=77)] and 60 < out[0].corrected < 200
    residual = O.correct_outliers_residual(frame(spark, {1: values})).filter("outlier").collect()
    assert START + dt.timedelta(days=77) in [r.date for r in residual]


def test_category_forecast_weights_duplicate_days(spark):
    rows = [(START + dt.timedelta(days=i), "gas", "A", 10.0 + i) for i in range(50) for _ in range(3)]
    df = spark.createDataFrame(rows, "close_date date, product_type string, classification string, amount double")
    out = FC.category_forecast(df, ["product_type", "classification"], horizon=5).toPandas()
    assert set(zip(out.kind, out.category)) == {("product_type", "gas"), ("classification", "A")}
    assert len(out) == 2 * 55 and abs(out.yhat.max() - 64) < 1.5


def test_partial_autocorrelation_of_ar1(spark):
    rng = np.random.default_rng(13)
    x = [0.0]
    for _ in range(3000):
        x.append(0.7 * x[-1] + rng.normal())
    got = {r.lag: r for r in S.autocorrelation(frame(spark, {1: x}), 4).collect()}
    assert got[0].acf == 1.0 and abs(got[1].pacf - 0.7) < 0.05 and abs(got[3].pacf) < 0.06


def test_auc_and_history_length(spark):
    rng = np.random.default_rng(14)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 500)})
    pdf["probability"] = (pdf.label * 0.3 + rng.random(500)).round(2)
    pos, neg = pdf[pdf.label == 1].probability.to_numpy(), pdf[pdf.label == 0].probability.to_numpy()
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert np.isclose(MD.roc_auc(spark.createDataFrame(pdf)).first().auc, wins)
    jump = frame(spark, {1: [10 + (i % 3) for i in range(700)] + [300 + (i % 3) for i in range(35)]}).withColumn("weekday", F.weekday("date"))
    assert {r.days for r in ST.history_length(jump, "station", "weekday", "date", "volume").collect()} == {4}


def _poisson_tail(a, x):
    """Q(a, x) of a whole a as the finite sum of Poisson weights, by logarithms around the peak."""
    k = np.arange(max(0, int(a - 60 * math.sqrt(a) - 100)), int(a), dtype=float)
    if a < 10_000:
        logs = [-x + v * math.log(x) - math.lgamma(v + 1) for v in k]
    else:
        logs = -k * (x / k - 1 - np.log(x / k)) - 0.5 * np.log(2 * np.pi * k) - 1 / (12 * k)
    return math.fsum(np.exp(logs))


def test_gamma_tail_does_not_depend_on_size():
    for a in (1, 2, 5, 50, 500, 5000, 30_000, 99_999, 100_001, 300_000, 3_000_000):
        for z in (-4, -1, 0, 0.5, 2, 5):
            x = a + z * math.sqrt(a)
            if x > 0:
                assert np.isclose(SP.gamma_upper(a, x), _poisson_tail(a, x), rtol=1e-8, atol=1e-12), (a, z)
    for a in (3e7, 3e8, 5e8, 1e12):
        assert np.isclose(SP.gamma_upper(a, a), 0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), atol=1e-12)


def test_log_tail_of_the_normal_law():
    for z in (-36, -20, -5, -2.9, -2.8, -1, 0, 1, 3):
        assert np.isclose(SP.normal_log_cdf(z), math.log(0.5 * math.erfc(-z / math.sqrt(2))), rtol=1e-11)
    for z in (40.0, 50.0, 1e4):  # the first terms of the asymptotic series
        expected = -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4)
        assert np.isclose(SP.normal_log_cdf(-z), expected, rtol=1e-10)


def test_t_tail_tends_to_the_normal_law():
    for dof in (1e6, 1e8, 1e9):
        tail = SP.beta_lower(dof / 2, 0.5, dof / (dof + 1.96**2), 1.96**2 / (dof + 1.96**2))
        assert np.isclose(tail, math.erfc(1.96 / math.sqrt(2)), atol=2 / dof + 1e-9)


def test_unsettled_elements_are_not_numbers():
    assert np.isnan(SP._masked(np.array([np.nan, 0.5]), pd.Series([1.0, 1.0])).astype(float)[0])


def test_rank_cells_stay_small_beside_an_outlier(spark):
    values = [1000 + k / 200_000 for k in range(200_000)] + [1e9, -1e9, 0.0, 0.5, 1e-300, float("inf")]
    cells = spark.createDataFrame([(v,) for v in values], "value double").select("value", *[c.alias(n) for c, n in zip(RK._cells(F.col("value")), "wg")])
    largest = cells.groupBy("w", "g").count().agg(F.max("count")).first()[0]
    assert largest <= len(values) / 1000
    ordered = cells.orderBy("value").collect()
    assert all((a.w, a.g) <= (b.w, b.g) for a, b in zip(ordered, ordered[1:]))


def test_rank_cells_never_decrease(spark):
    rng = np.random.default_rng(8)
    powers = 2.0 ** np.arange(-60, 60)
    values = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, 1e300), rng.normal(0, 1, 500), 10 ** rng.uniform(-300, 300, 500)])
    values = np.concatenate([values, -values])
    ordered = spark.createDataFrame(pd.DataFrame({"value": values})).select("value", *[c.alias(n) for c, n in zip(RK._cells(F.col("value")), "wg")]).toPandas()
    ordered = ordered.sort_values("value")
    pairs = list(zip(ordered.w, ordered.g))
    assert pairs == sorted(pairs)


def test_a_day_given_twice_makes_no_day_up(spark):
    days = [START, START + dt.timedelta(days=2), START + dt.timedelta(days=2), START + dt.timedelta(days=5)]
    df = spark.createDataFrame([(1, d, 1.0) for d in days], "station int, date date, volume double")
    calendar = spark.createDataFrame([(START,)], "date date")
    out = S.complete_dates(df, calendar.withColumn("holiday", F.lit(1)).select("date", "holiday")).groupBy("date").count().collect()
    assert {((r.date - START).days, r["count"]) for r in out} == {(0, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 1)}


def test_deviation_of_large_steady_volumes(spark):
    volumes = [1e9 + (k % 3) * 1e-3 for k in range(60)]
    df = frame(spark, {1: volumes}).withColumn("start", F.lit(START))
    found = S.series_metrics(df).first()
    assert np.isclose(found.sd, np.std(np.array(volumes) - 1e9, ddof=1), rtol=1e-3) and np.isclose(found["mean"], np.mean(volumes), rtol=1e-12)


def test_a_station_in_many_pairs_is_spread(spark, monkeypatch):
    monkeypatch.setattr(SM, "PAIRS_PER_SHARE", 8)
    rng = np.random.default_rng(5)
    df = frame(spark, {k: rng.random(12) for k in range(60)})
    pairs = spark.createDataFrame([(k, 0) for k in range(60)] + [(0, 3)], "a int, b int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SM.dtw_pairs(df, pairs)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        found = {(r.a, r.b): r.distance for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    series = {r.station: r.series for r in SM.series_arrays(df).collect()}
    assert len(found) == 61 and found[0, 0] == 0
    assert all(np.isclose(d, SM._dtw(np.array(series[a]), np.array(series[b]))) for (a, b), d in found.items())


def test_no_hold_out_row_reaches_a_fit(spark, sf_dir):
    from gridlytics.plans import segment_queries as Q
    from gridlytics.plans.bases import Tables

    tables = Tables(spark, sf_dir)
    train, held = Q._sides(tables)
    assert train.join(held, "order_id").count() == 0
    assert all(r[0] for r in train.select(*[F.col(c) <= v for c, v in MD.DEBT_LIMITS.items()]).select(F.expr("true")).distinct().collect())
    assert train.select(*[F.max(F.col(c) - v) for c, v in MD.DEBT_LIMITS.items()]).first() <= (0.0,) * len(MD.DEBT_LIMITS)
    only = held.withColumn("place", F.lit("only in the hold-out"))
    prepared = Q._prep().fit(train)
    labels = [x for stage in prepared.stages[0].labelsArray for x in stage]
    assert "only in the hold-out" not in labels and prepared.transform(only).count() == held.count()


def test_folds_are_balanced_inside_and_scored_as_they_are(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = [(k, float(k % 7), float(k % 11), int(k % 10 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label int")
    seen = []
    fit = MD.fit_classifier
    monkeypatch.setattr(MD, "fit_classifier", lambda kind, train, **p: seen.append({r.label: r["count"] for r in train.groupBy("label").count().collect()}) or fit(kind, train, **p))
    prepare = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features")])
    best, area = MD.grid_search("logistic", df, {"maxIter": [5], "regParam": [0.01, 0.1]}, prepare, ["id"], folds=3, parallelism=1)
    assert best["maxIter"] == 5 and 0 <= area <= 1 and len(seen) == 6
    assert all(abs(counts[0] - counts[1]) <= 0.2 * counts[0] for counts in seen)
