"""Edge rules on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridlytics.functions import columns as X
from gridlytics.operators import credit as C
from gridlytics.operators import forecast as FC
from gridlytics.operators import models as MD
from gridlytics.operators import outliers as O
from gridlytics.operators import portfolio as P
from gridlytics.operators import relational as R
from gridlytics.operators import review as V
from gridlytics.operators import segments as G
from gridlytics.operators import series as S
from gridlytics.sources import features as FT
from gridlytics.sources import merge as M
from gridlytics.sources import tables as TB

D = dt.date


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def days(start, volumes, station=1):
    return [(station, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(volumes)]


def series(spark, rows, holidays=()):
    df = spark.createDataFrame(rows, "station int, date date, volume double")
    calendar = spark.createDataFrame([(h,) for h in holidays], "date date")
    return S.with_holidays(df, calendar).withColumn("weekday", F.weekday("date"))


def test_month_end():
    assert X.month_end("2024-03-15", -1) == D(2024, 2, 29)
    assert X.month_end(D(2023, 1, 31), -2) == D(2022, 11, 30)
    assert X.month_end("2023-12-01", 1) == D(2024, 1, 31)


def test_units_and_text_numbers(spark):
    df = spark.createDataFrame([("M3", 10.0, "12,5"), ("FT3", 35.3147, "x"), ("KPC", 35.3147, None), ("GAL", 1.0, "3.25")], "u string, v double, s string")
    rows = df.select("u", X.to_cubic_meters("v", "u", F.lit(-1)).cast("double").alias("m"), X.parse_decimal("s").alias("n")).collect()
    assert {r.u: r.m for r in rows} == {"M3": -10.0, "FT3": -1.0, "KPC": -1000.0, "GAL": None}
    assert {r.u: r.n for r in rows} == {"M3": 12.5, "FT3": None, "KPC": None, "GAL": 3.25}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (999.0,)], "x double")
    assert [r[0] for r in df.select(X.clip("x", 0.0, 480.0)).collect()] == [None, 0.0, 480.0]


def test_suspension_days(spark):
    lo, hi = D(2024, 1, 1), D(2024, 6, 30)
    bounds = spark.createDataFrame([(i, 7014, 6, lo, hi) for i in range(1, 7)], "product_id int, product_type int, interval int, lower date, upper date")
    open_end = D(1900, 1, 1)
    rows = [
        (1, 1, 2, D(2023, 12, 1), D(2024, 1, 11)),   # started before, ended inside
        (2, 2, 2, D(2024, 6, 20), open_end),         # still open: runs to the end
        (3, 3, 2, D(2023, 1, 1), D(2025, 1, 1)),     # covers the interval
        (4, 4, 1, D(2024, 2, 1), D(2024, 2, 9)),     # another type
        (5, 5, 2, D(2024, 3, 10), D(2024, 3, 1)),    # reconnected before it began
    ]
    susp = spark.createDataFrame(rows, "product_id int, suspension_id int, suspension_type int, applied_date date, reconnected_date date")
    out = values(P.suspensions(bounds, susp), "product_id", "suspensions", "suspended_days")[:5:1]
    assert out[:3] == [(1, 1, 10), (2, 1, 10), (3, 1, 181)]
    assert [r[:2] for r in out[3:]] == [(4, 0), (5, 1)] and out[4][2] == 0


def test_aging_edges(spark):
    base = spark.createDataFrame(
        [(1, 7014, 6, 1, a, 0) for a in (-1, 0, 1, 30, 31, 60, 61, 90, 91)],
        "product_id int, product_type int, interval int, contract_id int, arrears_days int, written_off int",
    )
    assert values(P.aging_buckets(base), "e30", "e60", "e90", "em90") == [(2, 2, 2, 1)]


def test_portfolio_base_intervals_and_entry_date(spark):
    products = spark.createDataFrame([(1, 7014, 1, D(2020, 1, 1)), (2, 7055, 1, D(2024, 8, 1)), (3, 7014, 2, D(2020, 1, 1))],
                                     "product_id int, product_type int, category int, entry_date date")
    closes = spark.createDataFrame(
        [(p, 9, d, 5, 0.0) for p in (1, 2, 3) for d in (D(2023, 7, 31), D(2023, 8, 31), D(2024, 2, 29), D(2024, 7, 31), D(2024, 7, 30))],
        "product_id int, contract_id int, close_date date, arrears_days int, written_off double",
    )
    out = values(P.portfolio_base(products, closes, "2024-08-15"), "product_id", "interval", "close_date")
    assert out == [(1, 6, D(2024, 2, 29)), (1, 6, D(2024, 7, 31)), (1, 12, D(2023, 8, 31)), (1, 12, D(2024, 2, 29)), (1, 12, D(2024, 7, 31))]


def test_segment_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.55, 0.7, 0.85, 0.99, 1.0)] + [(None,)], "score double")
    assert [r.segment_name for r in P.score_segments(df).collect()] == ["Pesimo", "Malo", "Regular", "Bueno", "Excelente", None]


def _inputs(**change):
    base = dict(contract_id=1, stratum=1, gas_class=C.ON_TIME, gas_e0=13, gas_e60=0, gas_em90=0, gas_pending=10,
                credit_e0=None, credit_e30=None, credit_e60=None, credit_pending=None)
    return {**base, **change}


TREE = [
    (dict(credit_e0=9, credit_e30=0, credit_e60=0), 1, "bajo", 111, 5225000),
    (dict(credit_e0=9, credit_e30=1, credit_e60=0, credit_pending=7), 2, "bajo", 111, 5225000),
    (dict(credit_e0=9, credit_e30=0, credit_e60=0, credit_pending=8), 3, "medio", 101, 3960000),
    (dict(credit_e0=8, credit_e30=0, credit_e60=0, credit_pending=34), 4, "medio", 101, 3960000),
    (dict(credit_e0=2, credit_e30=0, credit_e60=0, credit_pending=35), 5, "medio", 101, 3960000),
    (dict(credit_e0=1, credit_e30=0, credit_e60=0), 6, "medio", 101, 3960000),
    (dict(credit_e0=9, credit_e30=0, credit_e60=1), 7, "alto", 101, 3340000),
    (dict(), 8, "medio", 100, 3735000),
    (dict(gas_pending=None), 9, "medio", 100, 3735000),
    (dict(gas_e0=12, gas_pending=35), 10, "medio", 100, 3735000),
    (dict(gas_e0=8, stratum=6), 11, "medio", 600, 6850000),
    (dict(gas_e0=9, gas_pending=36), 12, "medio", 100, 3735000),
    (dict(gas_e0=8, gas_pending=None), 13, "medio", 100, 3735000),
    (dict(gas_class=C.LATE, gas_e60=1), 14, "medio", 100, 3735000),
    (dict(gas_class=C.LATE, gas_e60=2), 15, "medio", 100, 3735000),
    (dict(gas_class=C.UNPAID, gas_em90=2, stratum=5), 16, "alto", 500, 6530000),
    (dict(gas_class="4-Otro"), None, None, 100, 0),
]


def test_rule_tree_and_quota(spark):
    schema = ("contract_id int, stratum int, gas_class string, gas_e0 int, gas_e60 int, gas_em90 int, gas_pending int, "
              "credit_e0 int, credit_e30 int, credit_e60 int, credit_pending int")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [[{**_inputs(**change), "contract_id": i}[n] for n in names] for i, (change, *_) in enumerate(TREE)]
    df = spark.createDataFrame(rows, schema)
    out = {r.contract_id: (r.node, r.risk, r.coded_node, r.quota) for r in C.assign_quota(C.combine_risk(df)).collect()}
    for i, (_, *expected) in enumerate(TREE):
        assert out[i] == tuple(expected), i
    split = {r.contract_id: (r.node, r.risk, r.quota) for r in C.assign_quota(C.combine_risk(df, split_unpaid=True)).collect()}
    # The variant leaves its high-risk node 17 without a quota.
    assert split[15] == (17, "alto", 0)


def test_review_zero_average_and_missing_text(spark):
    row = dict(work_type=12620, last_cause=None, lower_band=None, upper_band=None, executed_on=D(2024, 1, 20), last_valid_on=D(2024, 1, 1),
               read_on=D(2024, 1, 21), last_valid_reading="100,0", local_avg="10", reading="118", previous_reading=None,
               two_months_reading=None, product_avg="0", estimated="12,5", first_valid_reading=120.0, order_reading=119.0,
               volume=500.0, suspended_days=3, category=1)
    types = ("work_type int, last_cause int, lower_band double, upper_band double, executed_on date, last_valid_on date, read_on date, "
             "last_valid_reading string, local_avg string, reading string, previous_reading string, two_months_reading string, "
             "product_avg string, estimated string, first_valid_reading double, order_reading double, volume double, suspended_days int, category int")
    order = [c.split()[0] for c in types.split(", ")]
    justified = [row[c] for c in order]
    sentinel = [{**row, "executed_on": D(1900, 1, 1)}[c] for c in order]
    out = V.review_rules(spark.createDataFrame([justified, sentinel], types)).collect()
    assert [r.deviation for r in out] == [500.0, 500.0] and [r.rule_band for r in out] == [0, 0]
    # Reading 118 at day 20 does not exceed the order's 119, extrapolated; but it is later and smaller, so it is not consistent.
    assert [r.rule_1 for r in out] == ["NO", "NO"] and [r.rule_2 for r in out] == ["Yes", "Yes"]
    assert [r.rule_4 for r in out] == ["Aplica Regla 2"] * 2


def test_complete_dates_is_gap_free(spark):
    rows = [(1, D(2024, 1, 1), 5.0), (1, D(2024, 1, 4), None), (2, D(2024, 1, 6), 2.0), (3, D(2024, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "station int, date date, volume double")
    cal = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 2),)], "date date")
    out = values(S.complete_dates(df, cal, "2024-01-08"), "station", "date", "volume", "holiday", "weekday")
    assert out == [(1, D(2024, 1, d), 5.0 if d == 1 else 0.0, int(d == 2), D(2024, 1, d).weekday()) for d in range(1, 8)] + [
        (2, D(2024, 1, 6), 2.0, 0, 5), (2, D(2024, 1, 7), 0.0, 0, 6)]
    assert S.complete_dates(df, cal).filter("station = 1").count() == 4


@pytest.mark.parametrize("zeros, expected", [(30, 30), (29, 29), (0, 0)])
def test_effective_start(spark, zeros, expected):
    out = S.effective_start(series(spark, days(D(2024, 1, 1), [0] * zeros + [4] * 3))).select("start").distinct().collect()
    # Fewer leading zeros qualify as well: the window is shorter there.
    assert [r.start for r in out] == [D(2024, 1, 1) + dt.timedelta(days=expected)]


def test_effective_start_needs_thirty_zeros_inside(spark):
    quiet = [3] * 5 + [0] * 29 + [2] * 5
    assert S.effective_start(series(spark, days(D(2024, 1, 1), quiet))).first().start == D(2024, 1, 1)
    quiet = [3] * 5 + [0] * 30 + [2] * 5
    assert S.effective_start(series(spark, days(D(2024, 1, 1), quiet))).first().start == D(2024, 1, 1) + dt.timedelta(days=35)


def test_series_state(spark):
    as_of = D(2024, 7, 1)

    def one(station, volumes):
        return days(as_of - dt.timedelta(days=len(volumes)), volumes, station)

    rows = one(1, [5] * 100) + one(2, [5] * 70 + [0] * 30) + one(3, [5] * 61) + one(4, [5] * 62) + one(5, [5] * 40 + [0] * 35 + [5] * 10)
    out = dict(values(S.series_state(S.effective_start(series(spark, rows)), as_of), "station", "state"))
    # Station 3 is 60 days old on the last day, station 4 is 61; station 5 woke ten days ago after a silence.
    assert out == {1: S.ACTIVE, 2: S.INACTIVE, 3: S.NEW, 4: S.ACTIVE, 5: S.NEW}


def test_legacy_state(spark):
    rows = days(D(2024, 1, 1), [1] * 30, 1) + days(D(2024, 1, 1), [1] * 17 + [0] * 13, 2) + days(D(2024, 1, 1), [1] * 14, 3)
    rows += days(D(2024, 1, 1), [1] * 28 + [0] * 2, 4) + days(D(2024, 1, 1), [1] * 27 + [0] * 3, 5)
    states = spark.createDataFrame([(1, "Activa"), (2, "Activa"), (3, "Activa"), (4, "Inactiva"), (5, "Inactiva"), (6, "Activa")], "station int, state string")
    out = dict(values(S.legacy_state(series(spark, rows), states), "station", "state"))
    assert out == {1: "Activa", 2: "Inactiva", 3: "Inactiva", 4: "Activa", 5: "Nueva", 6: "Inactiva"}
    assert dict(values(S.legacy_state(series(spark, rows), states, check_length=False), "station", "state"))[3] == "Activa"


def test_neighbour_days_stay_inside_a_station(spark):
    rows = days(D(2024, 1, 7), [1, 1, 1], 1) + days(D(2024, 1, 9), [1], 2)
    out = values(S.neighbour_days(series(spark, rows, [D(2024, 1, 8)])), "station", "date", "before_bridge", "after_bridge")
    assert out == [(1, D(2024, 1, 7), 1, 0), (1, D(2024, 1, 8), 0, 0), (1, D(2024, 1, 9), 0, 1), (2, D(2024, 1, 9), 0, 0)]


def test_impute_uses_last_known_same_days(spark):
    rows = [(1, D(2024, 1, 1) + dt.timedelta(days=7 * i), float(i)) for i in range(6)] + [(1, D(2024, 2, 12), None)]
    df = spark.createDataFrame(rows, "station int, date date, volume double").withColumn("holiday", F.lit(0))
    assert O.impute_missing(df).filter("volume is null").first().imputed == (2 + 3 + 4 + 5) / 4


def test_mean_model_rules(spark):
    rows = days(D(2024, 1, 1), [float(i) for i in range(30)])
    frame = series(spark, rows, [D(2024, 1, 30)])
    weights = spark.createDataFrame([(1, 1.0, 1.0)], "station int, w1 double, w2 double")
    holiday = FC.mean_forecast(frame.withColumn("state", F.lit(S.ACTIVE)), weights).first()
    new = FC.mean_forecast(frame.withColumn("state", F.lit(S.NEW)), weights).first()
    plain = FC.mean_forecast(series(spark, rows).withColumn("state", F.lit(S.ACTIVE)), weights).first()
    # 30 January 2024 is a Tuesday: same days are 9, 16, 23 and 30 January; the week to date is the 29th and 30th.
    assert (holiday.prediction, new.prediction) == (29.0, (8 + 15 + 22 + 29) / 4)
    assert plain.prediction == ((8 + 15 + 22 + 29) / 4 + 28.5) / 2 and plain.date == D(2024, 1, 31)


def test_weights_need_a_full_history(spark):
    rows = days(D(2024, 1, 1), range(15), 1) + days(D(2024, 1, 1), range(40), 2) + days(D(2024, 1, 1), [0] * 40, 3)
    out = {r.station: r for r in FC.fit_mean_weights(series(spark, rows).withColumn("state", F.lit(S.ACTIVE))).collect()}
    assert out[1].w1 is None and out[2].rmse is not None
    assert (out[3].w1, out[3].w2, out[3].rmse) == (0.5, 0.5, 0.0)


def test_choose_best_ignores_failures(spark):
    rows = [(1, D(2024, 1, 2), "a", -1.0), (1, D(2024, 1, 2), "b", 3.0), (2, D(2024, 1, 2), "c", None), (3, D(2024, 1, 1), "d", 1.0)]
    df = spark.createDataFrame(rows, "station int, date date, model string, abs_error double")
    assert values(FC.choose_best(df, "2024-01-01"), "station", "model") == [(1, "b"), (2, "c")]


def test_zero_actual_gives_no_error(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "p double, a double")
    assert [r[0] for r in df.select(X.percent_error("p", "a")).collect()] == [None, 0.5]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    out = sorted(M.upsert(target, updates, ["k"]).collect(), key=str)
    assert sorted((r.k or 0, r.v) for r in out) == [(0, "N"), (0, "n"), (1, "a"), (2, "B"), (3, "C")]
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string")
    with pytest.raises(Exception, match="several update rows"):
        M.upsert(target, twice, ["k"]).collect()


def test_insert_new_always_inserts_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(1, "x"), (None, "m"), (2, "b")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in M.insert_new(target, rows, ["k"]).collect()) == [(0, "m"), (0, "n"), (1, "a"), (2, "b")]


def test_scd2_is_idempotent(spark):
    dim = spark.createDataFrame([(1, "A", D(2023, 1, 1), False), (1, "B", D(2024, 1, 1), True), (2, "A", D(2024, 1, 1), True), (4, "A", D(2024, 1, 1), True)],
                                "station int, state string, registered_at date, is_current boolean")
    now = spark.createDataFrame([(1, "C"), (2, "A"), (3, "N")], "station int, state string")
    day = F.lit(D(2024, 6, 1))
    once = M.scd2_merge(dim, now, "station", ["state"], day)
    expected = [(1, "A", D(2023, 1, 1), False), (1, "B", D(2024, 1, 1), False), (1, "C", D(2024, 6, 1), True),
                (2, "A", D(2024, 1, 1), True), (3, "N", D(2024, 6, 1), True), (4, "A", D(2024, 1, 1), True)]
    cols = ("station", "state", "registered_at", "is_current")
    assert values(once, *cols) == expected
    assert values(M.scd2_merge(once, now, "station", ["state"], F.lit(D(2024, 7, 1))), *cols) == expected


def test_quantile_score_ties_and_duplicate_edges(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 1, 1, 1, 1, 2, 3, 4, 5)], "x int")
    with pytest.raises(Exception, match="not unique"):
        G.quantile_score(df, "x").collect()
    out = G.quantile_score(df, "x", drop_duplicates=True)
    assert sorted((r.x, r.x_score) for r in out.collect()) == [(1, 1)] * 6 + [(2, 2), (3, 2), (4, 3), (5, 3)]


def test_frequency_and_activity(spark):
    df = spark.createDataFrame([(f, r) for f, r in ((0, 49), (1, 50), (3, 1), (4, 1), (5, 1), (6, 1))], "frequency int, recency int")
    assert [r[0] for r in df.select(G.frequency_score("frequency")).collect()] == [None, 1, 3, 4, 4, 5]
    active, idle = G.split_activity(df, frequency="frequency")
    assert (active.count(), idle.count()) == (4, 1)
    partners = spark.createDataFrame([(100_000,), (100_001,)], "monetary int")
    assert [p.count() for p in G.split_partners(partners)] == [1, 1]


def test_names_are_a_bijection(spark):
    rows = [(i, float(i + 1), float(i + 1), float(5 - i)) for i in range(5)]
    centers = spark.createDataFrame(rows, ["cluster", "r_score", "m_score", "f_score"])
    assert len({r.name for r in G.name_by_magnitude(centers).collect()}) == 5
    assert {r.cluster: r.name for r in G.name_by_amount(centers, "m_score").collect()}[4] == "Diamante"


def test_relief_rules(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (10, 37), (10, 38)], "arrears_days int, final_arrears_days int")
    assert [r[0] for r in df.select(MD.relief_label()).collect()] == [1, 0, 1, 0]


def test_oversample_minority_of_one(spark):
    df = spark.createDataFrame([(i, 0) for i in range(50)] + [(99, 1)], "id int, label int")
    counts = dict(values(MD.oversample(df, ["id"]).groupBy("label").count(), "label", "count"))
    assert counts == {0: 50, 1: 50}


def test_split_and_sample_are_repeatable(spark):
    df = spark.range(5000)
    a, b = R.split(df, ["id"], 0.8, 1)
    assert a.count() + b.count() == 5000 and abs(a.count() - 4000) < 200
    assert a.join(b, "id").count() == 0
    picked = R.sample_cap(df, 700, ["id"], 1)
    assert picked.count() == picked.distinct().count() == 700
    assert R.sample_cap(df, 9000, ["id"]).count() == 5000


def test_ordinal_by_first_appearance(spark):
    rows = [("b", 1), ("a", 2), ("c", 1), ("a", 5), ("b", 9)]
    df = spark.createDataFrame(rows, "name string, day int")
    assert sorted({(r.name, r.name_code) for r in R.ordinal(df, "name", "day").collect()}) == [("a", 2), ("b", 0), ("c", 1)]


def test_conform_and_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("FechaCierre,Cartera\n2024-01-31,10.5\n2024-02-29,x\n")
    df = TB.load_csv(spark, str(tmp_path / "in.csv"), "FechaCierre date, Cartera string")
    out = TB.conform(df, spark.createDataFrame([], "Cartera double").schema)
    assert [r.Cartera for r in out.collect()] == [10.5, None]


def test_tables_and_models_round_trip(spark, tmp_path):
    df = spark.createDataFrame([Row(id=1, x=1.0), Row(id=2, x=5.0), Row(id=3, x=9.0), Row(id=4, x=9.5)])
    FT.feature_write(spark, df, "features_t", "id")
    TB.save(spark.createDataFrame([Row(id=5, x=0.5)]), "features_t", "append")
    assert TB.load(spark, "features_t").count() == 5
    FT.feature_write(spark, spark.createDataFrame([Row(id=5, x=7.0)]), "features_t", "id", merge=True)
    assert TB.load(spark, "features_t").filter("id = 5").first().x == 7.0
    model, _ = G.fit_segments(df, ["x"], 2)
    MD.save_model(model, str(tmp_path / "m"))
    out = FT.score_batch(MD.load_model(str(tmp_path / "m")), df.select("id"), df, "id", ["x"])
    assert len({r.cluster for r in out.collect()}) == 2


def test_staging_keeps_the_rows(spark):
    from gridlytics.sources.staging import staged

    out = staged(spark.range(100).withColumn("x", F.col("id") * 2))
    assert out.agg(F.sum("x")).first()[0] == 9900
    assert spark.sparkContext.getCheckpointDir() is not None
