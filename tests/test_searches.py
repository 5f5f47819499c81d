"""Series searches, forecasts, tables by key and model searches against brute force on small fixtures."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.operators import boosting as B
from gridlytics.operators import forecast as FC
from gridlytics.operators import models as MD
from gridlytics.operators import relational as R
from gridlytics.operators import similarity as SM
from gridlytics.sources import features as FT
from gridlytics.sources import tables as TB
from gridlytics.sources.keyed import KeyedTable

START = dt.date(2022, 1, 1)


def frame(spark, table):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, vs in table.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "station int, date date, volume double").withColumn("holiday", F.lit(0))


# ---- nearest series ----


def slow_dtw(x, y):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            t[i, j] = (u - v) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[-1, -1] ** 0.5


def walks(rng, n):
    return {k: np.round(np.cumsum(rng.normal(size=rng.integers(1, 40))), 1) for k in range(n)}


def test_distances_side_by_side_are_those_of_the_table():
    rng = np.random.default_rng(1)
    series = list(walks(rng, 90).values())
    pairs = [(series[a], series[b]) for a, b in rng.integers(0, 90, (150, 2))]
    want = np.array([slow_dtw(x, y) for x, y in pairs])
    assert np.allclose(SM.dtw_distances([x for x, _ in pairs], [y for _, y in pairs]), want)
    limits = want * rng.choice([0.5, 0.999, 1.0, 2.0], len(want))
    limited = SM.dtw_distances([x for x, _ in pairs], [y for _, y in pairs], limits)
    assert np.array_equal(np.isinf(limited), want > limits * (1 + 1e-8))
    assert np.isnan(SM.dtw_distances([np.zeros(0)], [np.ones(3)])[0]) and not len(SM.dtw_distances([], []))


def test_lower_bounds_hold():
    rng = np.random.default_rng(2)
    series = list(walks(rng, 60).values())
    for a, b in rng.integers(0, 60, (400, 2)):
        x, y = series[a], series[b]
        assert SM.lower_bound(x, y, np.sort(x), np.sort(y), np.inf) <= slow_dtw(x, y) ** 2 + 1e-9


@pytest.mark.parametrize("k", [1, 3, 100])
def test_nearest_series_are_those_of_brute_force(spark, monkeypatch, k):
    rng = np.random.default_rng(3)
    table = walks(rng, 50)
    table[50] = table[7].copy()  # a tie
    monkeypatch.setattr(SM, "BLOCK_BYTES", 2000)  # several blocks of queries
    df, queries = frame(spark, table), spark.createDataFrame([(q,) for q in (0, 7, 7, 11, 50, 999)], "station int")
    for parts in (1, 5):
        got = {}
        for r in SM.nearest_series(df.repartition(parts), queries, k).collect():
            got.setdefault(r.query, []).append((r.place, r.station, r.distance))
        assert set(got) == {0, 7, 11, 50}
        for q, its in got.items():
            want = sorted((slow_dtw(table[q], table[s]), s) for s in table if s != q)[:k]
            assert [p for p, _, _ in sorted(its)] == list(range(1, len(want) + 1))
            assert np.allclose([d for _, _, d in sorted(its)], [d for d, _ in want])
            assert {s for _, s, d in its if d < want[-1][0] - 1e-9} == {s for d, s in want if d < want[-1][0] - 1e-9}


def test_search_refuses_and_gives_up():
    """Series in a few shapes and levels: most distances are never computed."""
    rng = np.random.default_rng(4)
    level = np.repeat(rng.uniform(0, 100, 25), 8)
    series = [level[k] + 3 * np.sin(np.arange(60) / 9 + k) + rng.normal(0, 0.3, 60) for k in range(200)]
    tally = {}
    found = SM.nearest_of(list(range(200)), series, series[0], 5, math.inf, skip=0, tally=tally)
    assert [s for _, s in found] == [s for _, s in sorted((slow_dtw(series[0], s), k) for k, s in enumerate(series) if k)[:5]]
    assert tally["computed"] < 100


def test_index_words(spark):
    df = frame(spark, {1: range(16), 2: [5.0] * 3, 3: [1.0]})
    got = {r.station: (r.word, r.means) for r in SM.series_index(SM.series_arrays(df)).collect()}
    assert got[1][0] == "aabbccdd" and np.allclose(got[1][1], np.arange(8) * 2 + 0.5)
    assert got[2][0] == got[3][0] == "cccccccc" and got[2][1] == [5.0] * 8
    for station, values in ((1, np.arange(16.0)), (2, np.full(3, 5.0)), (3, np.ones(1))):
        assert np.allclose(SM._segment_means(values), got[station][1])


def test_search_makes_no_pairs(spark):
    df = frame(spark, {k: [1.0, 2.0] for k in range(4)})
    text = SM.nearest_series(df, df.select("station"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def lines(spark, folder, table):
    """The given tables from which `daily` is made: one line a station and day."""
    rows = [(k, dt.datetime.combine(START + dt.timedelta(days=i), dt.time()), float(v)) for k, vs in table.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in table], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_nearest_days_are_searched_for_every_station(spark, tmp_path):
    from gridlytics.plans.registry import QUERIES

    rng = np.random.default_rng(8)
    table = {k: rng.integers(1, 50, rng.integers(5, 12)) for k in (1, 2, 3, 49, 50, 51, 52, 100)}
    got = {}
    for r in QUERIES["nearest_days"](spark, lines(spark, tmp_path, table)).collect():
        got.setdefault(r.query, []).append((r.place, r.station, r.distance))
    assert set(got) == set(table)
    for q, its in got.items():
        want = sorted((slow_dtw(table[q], table[s]), s) for s in table if s != q)[:5]
        assert [s for _, s, _ in sorted(its)] == [s for _, s in want] and np.allclose([d for _, _, d in sorted(its)], [d for d, _ in want], atol=1e-6)


def batch(names, series):
    return SM._Batch(names, np.concatenate(series), np.array([len(x) for x in series]))


@pytest.mark.parametrize("case", range(12))
def test_pairs_are_measured_once_and_exactly(monkeypatch, case):
    """Against brute force: ties, equal series, single values, small steps at a high level, very small and large values; some or all asked for."""
    rng = np.random.default_rng(case)
    kind, n, k = case % 6, 24, 1 + case % 4
    make = [
        lambda m: rng.integers(0, 3, m).astype(float), lambda m: np.cumsum(rng.normal(size=m)), lambda m: rng.integers(1, 50, m).astype(float),
        lambda m: np.full(m, float(rng.integers(0, 3))), lambda m: 1e9 + np.round(rng.normal(size=m), 3), lambda m: rng.normal(size=m) * 10.0 ** rng.integers(-25, 26),
    ][kind]
    series = [make(int(rng.integers(1, [5, 20, 80, 3, 40, 20][kind] + 1))) for _ in range(n)]
    series += [series[j].copy() for j in range(0, n, 4)]
    far_apart = np.array([[slow_dtw(x, y) for y in series] for x in series])
    asked = [j for j in range(len(series)) if case < 6 or rng.random() < 0.6]
    if case % 2:
        for name, size in (("PAIRS_AT_ONCE", 30), ("STATIONS_AT_ONCE", 2), ("FIRST_ROUND", 2), ("SIDE_BY_SIDE", 100)):
            monkeypatch.setattr(SM, name, size)
    met, distances = [], SM._distances
    monkeypatch.setattr(SM, "_distances", lambda near, far, a, b, *more: met.extend((near.names[x], far.names[y]) for x, y in zip(a, b)) or distances(near, far, a, b, *more))
    near = batch(asked, [series[j] for j in asked])
    limits, found = np.full(len(asked), np.inf), []
    for part in np.array_split(rng.permutation(len(series)), 3):
        far = batch(part.tolist(), [series[j] for j in part])
        sides = SM._nearest_pairs(near, far, limits, np.array([np.inf if j in asked else -1.0 for j in part]), k)
        for (owner, other, apart), one, two in zip(sides, (near, far), (far, near)):
            found += [(one.names[x], d, two.names[y]) for x, y, d in zip(owner, other, apart)]
    assert len({(*sorted(pair),) for pair in met}) == len(met)
    for q in asked:
        want = sorted((far_apart[q, s], s) for s in range(len(series)) if s != q)[:k]
        assert sorted((d, s) for o, d, s in found if o == q)[:k] == want


def test_equal_series_need_no_table(monkeypatch):
    x = np.random.default_rng(6).normal(size=300)
    monkeypatch.setattr(SM, "_dtw_together", lambda *_: pytest.fail("a table was filled"))
    assert SM.dtw_distances([x, x], [x.copy(), x]).tolist() == [0.0, 0.0]


def test_tiles_beyond_all_limits_are_not_looked_at(monkeypatch):
    """Series of few levels within small limits: only those of a like level meet."""
    rng = np.random.default_rng(7)
    series = [100.0 * (k % 8) + rng.normal(size=80) for k in range(800)]
    seen, bounds = [], SM._Batch.bounds
    monkeypatch.setattr(SM._Batch, "bounds", lambda self, x, left, *more: seen.append(len(left)) or bounds(self, x, left, *more))
    monkeypatch.setattr(SM, "STATIONS_AT_ONCE", 50)
    whole = batch(list(range(800)), series)
    SM._nearest_pairs(whole, whole, np.full(800, 900.0), np.full(800, 900.0), 3)
    assert 0 < sum(seen) <= 8 * 100 * 99 / 2


def test_nearest_quarters_read_the_lines_once(spark, tmp_path, monkeypatch):
    """Nothing but the staged series is read once they are there."""
    import shutil

    from gridlytics.plans.registry import QUERIES

    rng = np.random.default_rng(9)
    table = {k: rng.integers(1, 50, 400) for k in range(1, 6)}
    folder, staged = lines(spark, tmp_path, table), SM.staged
    monkeypatch.setattr(SM, "staged", lambda df: (staged(df), shutil.rmtree(f"{folder}/lineitem.parquet"))[0])
    got = {}
    for r in QUERIES["nearest_quarters"](spark, folder).collect():
        got.setdefault(r.query, []).append((r.place, r.station, r.distance))
    days = [START + dt.timedelta(days=i) for i in range(400)]
    quarter = np.array([(d.year - 2022) * 4 + (d.month - 1) // 3 for d in days])
    sums = {k: np.bincount(quarter, v) for k, v in table.items()}
    for q in table:
        want = sorted((slow_dtw(sums[q], sums[s]), s) for s in table if s != q)[:3]
        assert [s for _, s, _ in sorted(got[q])] == [s for _, s in want] and np.allclose([d for _, _, d in sorted(got[q])], [d for d, _ in want], atol=1e-6)


# ---- forecasts ----


def test_tuning_equals_separate_fits():
    """Each cutoff and flexibility against a model that is built from the days before the cutoff alone."""
    rng = np.random.default_rng(5)
    for n, gap in ((60, 1), (750, 1), (400, 3)):
        days = 19000.0 + np.cumsum(rng.integers(1, gap + 1, n))
        y = 50 + 0.02 * np.arange(n) + 5 * np.sin(days * 2 * np.pi / 7) + rng.normal(0, 1, n)
        holiday = (rng.random(n) < 0.03).astype(float)
        grid, cutoffs = [0.005, 0.5], 12
        got = FC._tuning(days, y, holiday, grid, cutoffs)
        for step in range(cutoffs):
            m = n - cutoffs + step
            basis = FC._Basis(days[:m], True)
            x, _ = basis.columns(days[:m], holiday[:m])
            unit = np.max(np.abs(y[:m]))
            z = y[:m] / unit
            at, _ = basis.columns(days[m : m + 1], holiday[m : m + 1])
            for g, scale in enumerate(grid):
                beta, _ = FC._ridge(x.T @ x, x.T @ z, float(z @ z), float(m), basis.penalty(x.shape[1], scale))
                assert abs(got[g, step] - (at @ beta)[0] * unit) < 1e-4, (n, step, scale)


def test_moving_average_terms_are_recovered(spark):
    rng = np.random.default_rng(6)
    shocks = rng.normal(size=6000)
    level = np.zeros(6000)
    for t in range(1, 6000):
        level[t] = 0.6 * level[t - 1] + shocks[t] + 0.5 * shocks[t - 1] + 0.2
    table = {1: level, 2: [1.0] * 5, 3: list(range(40))}
    found = {r.station: r for r in FC.arma_forecast(frame(spark, table), p=1, d=0, q=1).collect()}
    ar, ma, _ = found[1].coefficients
    assert abs(ar - 0.6) < 0.05 and abs(ma - 0.5) < 0.06 and 2 not in found
    assert abs(found[1].prediction - (0.6 * level[-1] + 0.5 * shocks[-1] + 0.2)) < 0.2
    line = {r.station: r.prediction for r in FC.arma_forecast(frame(spark, table), p=2, d=1, q=1).collect()}
    assert abs(line[3] - 40) < 1e-6


def slow_tree(x, residual, depth):
    """The prediction of an exact greedy tree for its own rows."""
    def value(rows):
        return residual[rows].sum() / (len(rows) + B.PENALTY)

    def score(rows):
        return residual[rows].sum() ** 2 / (len(rows) + B.PENALTY)

    out = np.zeros(len(x))

    def split(rows, left):
        best = None
        for f in range(x.shape[1]):
            for edge in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                gain = score(a) + score(b) - score(rows)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, a, b)
        if left and best:
            split(best[1], left - 1)
            split(best[2], left - 1)
        else:
            out[rows] = value(rows)

    split(np.arange(len(x)), depth)
    return out


def test_boosting_equals_exact_splits():
    rng = np.random.default_rng(7)
    for width in (1, 3):
        x, y = rng.normal(size=(80, width)).round(2), rng.normal(size=80)
        fitted = np.full(80, y.mean())
        for _ in range(6):
            fitted += 0.3 * slow_tree(x, y - fitted, 3)
        model = B.fit(x, y, trees=6, depth=3)
        assert np.allclose(model.predict(x), fitted)
    constant = B.fit(np.ones((9, 1)), np.arange(9.0), trees=5)
    assert np.allclose(constant.predict(np.ones((2, 1))), 4.0)


def test_boosting_stops_where_the_watched_rows_say(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, (600, 1))
    y = np.sin(x[:, 0]) + rng.normal(0, 0.3, 600)
    watched = B.fit(x[:500], y[:500], trees=400, watched=(x[500:], y[500:]), patience=20)
    whole = B.fit(x[:500], y[:500], trees=400)
    error = lambda m: np.mean((m.predict(x[500:]) - y[500:]) ** 2)
    assert 0 < len(watched.trees) < 100 and error(watched) < error(whole)
    volumes = [[1, 4, 2, 8, 5, 7, 3][i % 7] for i in range(300)]  # a day's volume says the next one's
    out = FC.boosted_forecast(frame(spark, {1: volumes, 2: [1.0, 2.0], 3: [5.0] * 40})).toPandas()
    assert set(out.station) == {1, 3} and (out.groupby("station").size() == [29, 3]).all()
    one = out[out.station == 1]
    assert one.trees.nunique() == 1 and np.mean(np.abs(one.actual - one.prediction)) < 0.5
    assert np.allclose(out[out.station == 3].prediction, 5.0)


# ---- tables by key ----


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("named", [False, True])
def test_merge_rewrites_touched_buckets_only(spark, tmp_path, named):
    name = "keyed_volumes" if named else str(tmp_path / "volumes")
    table = KeyedTable(name, ("id",), 8)
    assert not table.exists(spark)
    table.create(spark.range(200).select("id", F.lit(1.0).alias("x"), F.lit("a").alias("note")))
    folder = spark.sql("DESCRIBE EXTENDED keyed_volumes").filter("col_name = 'Location'").first()[1].removeprefix("file:") if named else name
    before = files(folder)
    updates = spark.createDataFrame([(5, 9.0, "b"), (1000, 2.0, "b")], "id long, x double, note string")
    touched = table.merge(updates)
    after = files(folder)
    assert table.exists(spark) and 1 <= len(touched) <= 2
    kept = before & after
    assert kept == {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched} and len(kept) >= 6
    want = sorted([(k, 1.0, "a") for k in range(200) if k != 5] + [(5, 9.0, "b"), (1000, 2.0, "b")])
    assert rows_of(table.read(spark), "id", "x", "note") == want
    assert table.merge(updates) == touched and rows_of(table.read(spark), "id", "x", "note") == want  # again: the same
    assert table.merge(updates.limit(0)) == []
    table.merge(spark.createDataFrame([(5, -1.0, "c"), (6, -1.0, "c")], "id long, x double, note string"), columns=["note"])
    assert rows_of(table.read(spark).filter("id in (5, 6)"), "id", "x", "note") == [(5, 9.0, "c"), (6, 1.0, "c")]
    if named:
        spark.sql("DROP TABLE keyed_volumes")


def test_a_merge_that_fails_leaves_the_table(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), 4)
    table.create(spark.range(50).select("id", F.col("id").cast("double").alias("x")))
    before, rows = files(table.name), rows_of(table.read(spark), "id", "x")
    for bad in (
        spark.createDataFrame([(1, 1.0), (1, 2.0), (30, 5.0)], "id long, x double"),  # two rows for a key
        spark.range(40).select("id", F.when(F.col("id") < 39, 1.0).otherwise(F.raise_error(F.lit("broken")).cast("double")).alias("x")),
    ):
        with pytest.raises(Exception, match="several update rows|broken"):
            table.merge(bad)
        assert files(table.name) == before and rows_of(table.read(spark), "id", "x") == rows


def test_a_merge_reads_the_touched_buckets(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), 16)
    table.create(spark.range(100).select("id", F.lit(1).alias("x")))
    text = table._rows(spark).where(F.col("_bucket").isin([3, 5]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in text


def test_null_keys_in_a_keyed_table(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), 4)
    rows = "id long, x double"
    table.create(spark.createDataFrame([(None, 1.0), (1, 1.0)], rows))
    table.merge(spark.createDataFrame([(None, 2.0), (None, 3.0), (1, 4.0)], rows))
    assert sorted(r.x for r in table.read(spark).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_feature_tables_by_bucket(spark, tmp_path):
    name = str(tmp_path / "f")
    df = spark.createDataFrame([Row(id=k, x=float(k)) for k in range(20)])
    FT.feature_write(spark, df, name, "id", merge=True, buckets=4)
    FT.feature_write(spark, spark.createDataFrame([Row(id=3, x=7.0)]), name, "id", merge=True, buckets=4)
    got = {r.id: r.x for r in FT.feature_read(spark, name, "id").collect()}
    assert got[3] == 7.0 and len(got) == 20 and FT.feature_read(spark, name, "id").columns == ["id", "x"]


def test_appending_a_batch_twice_adds_it_once(spark, tmp_path):
    path = str(tmp_path / "h")
    for batch, n in (("a", 3), ("b", 4), ("a", 2)):
        TB.append_batch(spark.range(n), path, batch)
    assert rows_of(spark.read.parquet(path).groupBy("batch").count(), "batch", "count") == [("a", 2), ("b", 4)]


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2024-01-31\nx,2024-02-01\n3\n4,2024-02-02,9\n5,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType())])
    good, bad = TB.load_csv_checked(spark, str(tmp_path / "in.csv"), schema)
    assert rows_of(good, "a") == [(1,), (5,)]
    assert rows_of(bad, TB.UNREADABLE) == [("3",), ("4,2024-02-02,9",), ("x,2024-02-01",)]


def test_warehouse_scans_are_split():
    """The options only: no database is at hand."""
    one = TB.jdbc_options("jdbc:x", "SELECT 1")
    assert one["query"] == "SELECT 1" and "dbtable" not in one and one["fetchsize"] == "10000"
    many = TB.jdbc_options("jdbc:x", "SELECT * FROM t", "id", 0, 100, 8, user="u")
    assert many["dbtable"] == "(SELECT * FROM t) AS scanned" and many["numPartitions"] == "8" and "query" not in many and many["user"] == "u"
    assert (many["partitionColumn"], many["lowerBound"], many["upperBound"]) == ("id", "0", "100")
    with pytest.raises(ValueError):
        TB.jdbc_options("jdbc:x", "SELECT 1", "id", parts=4)


def test_warehouse_predicates_cover_every_row_once():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CASE WHEN i % 10 = 0 THEN NULL ELSE i END AS v, CAST(i AS VARCHAR) || '''' AS s FROM range(100) r(i)")
    for column, bounds in (("v", [20, 50, 51]), ("s", ["3'", "7"]), ("v", [5]), ("v", [])):
        parts = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in TB.jdbc_predicates(column, bounds)]
        assert sum(parts) == 100 and len(parts) == len(bounds) + 1


# ---- numbering and model searches ----


def test_numbering_deals_one_common_date(spark):
    """All labels appear first on one day: no task numbers more than a few of them."""
    rows = [(f"s{k:05d}", START, 1) for k in range(3000)] + [(f"s{k:05d}", START + dt.timedelta(1), 2) for k in range(0, 3500, 2)] + [(None, START, 3)]
    df = spark.createDataFrame(rows, "label string, day date, x int")
    codes = {(r.label, r.day): r.code for r in R.ordinal(df, "label", "day", "code", parts=16).collect()}
    first = {}
    for label, day, _ in rows:
        first[label] = min(first.get(label, day), day)
    labels = sorted((x for x in first if x is not None), key=lambda x: (first[x], x))
    # a label without a name is numbered with the first range, and matches no row
    assert codes[(None, START)] is None
    got = [codes[(x, first[x])] for x in labels]
    assert got == sorted(got) and len(set(got)) == len(got) and got[-1] - got[0] == len(got) - 1
    plan = R.ordinal(df, "label", "day", "code", parts=16)
    ranges = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in ranges


def test_halving_keeps_the_better_third(spark):
    assert MD.halving_rungs(18000, 9) == [(9, 1 / 9), (3, 1 / 3), (1, 1.0)]
    assert MD.halving_rungs(100, 9) == [(9, 1.0)] and MD.halving_rungs(500, 9) == [(9, 0.4), (3, 0.4), (1, 1.0)] and MD.halving_rungs(10, 1) == [(1, 1.0)]
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("label"))
    inner, outer = ({r.k for r in MD.rung_rows(df, ["k"], s).collect()} for s in (1 / 9, 1 / 3))
    assert inner < outer and abs(len(outer) - 1000) < 120


def test_halving_finds_the_winner_of_the_whole_grid(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x = rng.normal(size=900)
    rows = [(int(k), float(v), int(rng.random() < 1 / (1 + np.exp(-3 * v)))) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x double, label int")
    prep = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")])
    grid = {"maxIter": [0, 20], "regParam": [0.0]}  # a model that is not fitted at all cannot win
    best, area, history = MD.halving_search("logistic", df, grid, prep, ["k"], folds=2, least=50)
    whole, whole_area = MD.grid_search("logistic", df, grid, prep, ["k"], folds=2)
    assert best == whole == {"maxIter": 20, "regParam": 0.0} and abs(area - whole_area) < 1e-9
    assert [h["points"] for h in history] == [2, 1] and history[-1]["share"] == 1.0


def test_adaptive_boosting_equals_a_plain_loop(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(10)
    x = rng.integers(0, 30, (120, 2)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 30) ^ (rng.random(120) < 0.1)).astype(int)
    df = spark.createDataFrame([(int(k), *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))], "k long, a double, b double, label int")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = MD.fit_adaptive(df, rounds=7)
    got = {r.k: r.probability_1 for r in model.transform(df).collect()}

    weights, says, votes = np.ones(120), [], np.zeros(120)
    for stump in model.stumps:
        predicted = np.array([r.prediction for r in stump.transform(df).orderBy("k").collect()])
        wrong = predicted != y
        error = weights[wrong].sum() / weights.sum()
        says.append(0.5 * math.log((1 - error) / error))
        votes += says[-1] * predicted
        weights *= np.exp(np.where(wrong, 1, -1) * says[-1])
        weights *= 120 / weights.sum()
    assert np.allclose(says, model.says) and np.allclose([got[k] for k in range(120)], votes / sum(says))
    first = np.mean([r.prediction == r.label for r in model.stumps[0].transform(df).collect()])
    assert np.mean([(got[k] > 0.5) == y[k] for k in range(120)]) > first
    # the first stump is the best one
    best = max(max(np.mean((x[:, f] > c) == y), np.mean((x[:, f] <= c) == y)) for f in (0, 1) for c in np.unique(x[:, f]))
    assert first >= best - 0.02


def test_a_learner_without_mistakes_ends_the_rounds(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.range(20).selectExpr("double(id) AS a", "int(id >= 10) AS label"))
    model = MD.fit_adaptive(df, rounds=9)
    assert len(model.stumps) == 1 and {r.prediction == r.label for r in model.transform(df).collect()} == {True}


# ---- fits with a location ----


def test_free_locations_equal_a_scan(spark):
    import pandas as pd

    from gridlytics.operators import stats as ST

    rng = np.random.default_rng(11)
    x = 40 + rng.lognormal(1.5, 0.4, 3000)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    free = {r.distribution: r for r in ST.fit_free_distributions(df, "v").collect()}
    fixed = {r.distribution: r for r in ST.fit_distributions(df, "v").collect()}

    def nll(location):
        logs = np.log(x - location)
        return logs.sum() + len(x) / 2 * math.log(2 * math.pi * logs.var()) + len(x) / 2

    gaps = x.std() * np.logspace(-3, 2, 4000)
    assert free["lognorm"].nll <= min(nll(x.min() - g) for g in gaps) + 0.05
    assert abs(free["lognorm"].nll - nll(free["lognorm"].location)) < 1e-6 and abs(free["lognorm"].location - 40) < 0.6
    assert all(free[d].nll <= fixed[d].nll + 1e-6 for d in fixed) and free["expon"].location == x.min()
    assert ST.fit_free_distributions(df.filter("v < 0"), "v").count() == 0
    one = {r.distribution: r for r in ST.fit_free_distributions(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v").collect()}
    assert set(one) == {"gamma", "lognorm", "expon"}


# ---- partner channels ----


def test_channels_are_scored_and_named_apart(spark):
    from gridlytics.operators import segments as G

    rng = np.random.default_rng(12)
    rows = []
    for channel, scale in ((0, 1e6), (1, 1e7), (2, 1e8)):
        for k in range(60):
            rows.append((k, channel, int(rng.integers(0, 90)), int(scale * rng.random()) + 200_000, float(rng.integers(1, 9)), float(rng.integers(1, 36)),
                         int(scale * rng.random()), int(rng.integers(5, 50)), int(rng.integers(0, 3)), float(rng.random())))
    names = "partner_id int, channel int, recency int, monetary long, ticket double, term double, monetary_6m long, sales long, returns long, insured double"
    df = spark.createDataFrame(rows, names)
    together = {(r.partner_id, r.channel): r for r in G.partner_scores(df, by="channel").collect()}
    for channel in range(3):
        for r in G.partner_scores(df.filter(F.col("channel") == channel)).collect():
            assert tuple(together[r.partner_id, channel]) == tuple(r)
    one = G.segment_channel(G.partner_scores(df, by="channel").filter("channel = 1"), ["monetary_score"], 4, G.FOUR_TIERS).collect()
    order = {name: np.mean([r.monetary_score for r in one if r.name == name]) for name in {r.name for r in one}}
    assert list(order) and [n for n in G.FOUR_TIERS if n in order] == sorted(order, key=lambda n: -order[n])
