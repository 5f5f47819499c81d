"""Statistics: moments, correlations, tests and fits from aggregated sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions.special import chi2_sf, f_cdf, kolmogorov_sf, normal_log_tail, t_two_sided
from gridlytics.operators.ranks import mode_by, quantiles_of, ranked_values

# Anderson-Darling critical values for a normal law with estimated mean and variance,
# before the small-sample factor 1 + 4/n - 25/n^2, at these significance levels in percent.
AD_CRITICAL = (0.576, 0.656, 0.787, 0.918, 1.092)
AD_LEVELS = (15.0, 10.0, 5.0, 2.5, 1.0)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs as rows ``(a, b, r)``; one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        for x, y in sorted({(a, b), (b, a)})
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def select_correlated(df: DataFrame, cols: Sequence[str], label: str, threshold: float = 0.2) -> DataFrame:
    """Columns whose correlation with the label reaches the threshold in absolute value."""
    others = [c for c in cols if c != label]
    row = df.agg(*[F.corr(c, label).alias(c) for c in others])
    return row.unpivot([], others, "feature", "r").filter(F.abs("r") >= threshold)


def describe_series(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, sample deviation, population skewness and excess kurtosis per series."""
    moments = df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    medians = quantiles_of(ranked_values(df, value, [key]), [0.5], [key])
    return moments.join(medians, key).select(
        key, "n", "mean", F.col("q")[0].alias("median"), "sd", "skewness", "kurtosis"
    )


def upper_limit(df: DataFrame, value: str, k: float) -> DataFrame:
    """Accepted upper limits: mode + k·sd and mean + k·sd."""
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    mode = mode_by(df, [], value).scalar()
    return stats.withColumn("mode", mode.cast("double")).withColumns(
        {"mode_limit": F.col("mode") + k * F.col("sd"), "mean_limit": F.col("mean") + k * F.col("sd")}
    )


def upper_limit_by(df: DataFrame, group: str, value: str, factors: Mapping, otherwise: float) -> DataFrame:
    """Accepted upper limits per group, each with a factor of its own."""
    stats = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    factor = F.coalesce(*[F.when(F.col(group) == g, F.lit(float(k))) for g, k in factors.items()], F.lit(float(otherwise)))
    out = stats.join(mode_by(df, [group], value), group).withColumn("mode", F.col("mode").cast("double"))
    return out.withColumns({"mode_limit": F.col("mode") + factor * F.col("sd"), "mean_limit": F.col("mean") + factor * F.col("sd")})


_FIT_SCHEMA = "distribution string, shape double, scale double, location double, nll double, aic double"


def _fit_rows(n: float, total: float, logs: float, logs2: float, low: float) -> list[dict]:
    """Closed-form maximum likelihood from sufficient statistics; a scalar Newton step for the gamma shape."""
    mean, mean_log = total / n, logs / n
    gap = max(math.log(mean) - mean_log, 1e-12)
    shape = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)

    def digamma(x: float) -> float:
        out = 0.0
        while x < 8:
            out -= 1 / x
            x += 1
        y = 1 / (x * x)
        return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))

    for _ in range(50):
        slope = (digamma(shape * (1 + 1e-5)) - digamma(shape * (1 - 1e-5))) / (2e-5 * shape)
        step = (math.log(shape) - digamma(shape) - gap) / (1 / shape - slope)
        shape = max(shape - step, 1e-8)
        if abs(step) < 1e-12 * shape:
            break
    scale = mean / shape
    var = max(logs2 / n - mean_log**2, 1e-300)
    gamma = -((shape - 1) * logs - total / scale - n * shape * math.log(scale) - n * math.lgamma(shape))
    lognormal = logs + n / 2 * math.log(2 * math.pi * var) + n / 2
    rate_mean = max(mean - low, 1e-300)
    exponential = n * math.log(rate_mean) + n
    rows = [
        ("gamma", shape, scale, 0.0, gamma, 2),
        ("lognorm", math.sqrt(var), math.exp(mean_log), 0.0, lognormal, 2),
        ("expon", None, rate_mean, low, exponential, 2),
    ]
    return [
        dict(distribution=d, shape=s, scale=c, location=loc, nll=v, aic=2 * k + 2 * v) for d, s, c, loc, v, k in rows
    ]


def fit_distributions(df: DataFrame, value: str) -> DataFrame:
    """Gamma, log-normal and exponential fits of positive values with their negative log-likelihoods.

    The facts are read once for five sums; the fit sees only that one row. Gamma and log-normal
    have location 0, the exponential starts at the smallest value.
    """
    x = F.col(value).cast("double")
    sums = df.filter(x > 0).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("s"), F.sum(F.ln(x)).alias("l"),
        F.sum(F.ln(x) * F.ln(x)).alias("l2"), F.min(x).alias("low"),
    )

    def fit(batches):
        for pdf in batches:
            rows = [r for one in pdf.itertuples(index=False) if one.n > 0 for r in _fit_rows(*one)]
            yield pd.DataFrame(rows, columns=["distribution", "shape", "scale", "location", "nll", "aic"])

    return sums.mapInPandas(fit, _FIT_SCHEMA)


def best_distribution(df: DataFrame, value: str) -> DataFrame:
    return fit_distributions(df, value).orderBy("nll").limit(1)


#: Candidate locations of one pass over the values, and passes.
LOCATIONS, LOCATION_PASSES = 24, 3


def location_profile(df: DataFrame, value: str, locations: Sequence[float]) -> DataFrame:
    """Per candidate location what the fits need of the positive values above it, and the log-normal's negative log-likelihood there.

    All locations are columns of one aggregate, so the values are read once. A location that is not below every value has NULLs.
    """
    x = F.col(value).cast("double")
    logs = [F.ln(x - F.lit(float(at))) for at in locations]
    sums = df.filter(x > 0).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"),
        *[F.sum(e).alias(f"l{i}") for i, e in enumerate(logs)], *[F.sum(e * e).alias(f"q{i}") for i, e in enumerate(logs)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(at)).alias("location"), F.col(f"l{i}").alias("logs"), F.col(f"q{i}").alias("logs2")) for i, at in enumerate(locations)
    ])
    each = sums.select("n", "total", "low", F.explode(rows).alias("e")).select("e.location", "n", "total", "low", "e.logs", "e.logs2")
    inside, n = F.col("location") < F.col("low"), F.col("n")
    var = F.greatest(F.col("logs2") / n - F.pow(F.col("logs") / n, 2), F.lit(1e-300))
    nll = F.col("logs") + n / 2 * F.ln(2 * math.pi * var) + n / 2
    each = each.withColumn("nll", F.when(inside, nll))
    return each.withColumns({c: F.when(inside, F.col(c)) for c in ("logs", "logs2")})


def fit_free_distributions(df: DataFrame, value: str, locations: int = LOCATIONS, passes: int = LOCATION_PASSES) -> DataFrame:
    """Gamma, log-normal and exponential fits of positive values with a location of their own, as :func:`fit_distributions` otherwise.

    The likelihood has no maximum as the location nears the smallest value, so the search stays a thousandth of the standard deviation
    below it, as far as a hundred deviations, by distances that grow geometrically; location 0 is tried as well, so no fit is worse
    than the one without a location. Every pass reads the values once for all candidates and narrows the search to the
    neighbours of the best; the driver sees one row per candidate.
    """
    x = F.col(value).cast("double")
    known = df.filter(x > 0).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")).first()
    if not known["n"]:
        return df.sparkSession.createDataFrame([], _FIT_SCHEMA)
    low, spread = known["low"], known["sd"] or max(abs(known["low"]), 1.0)
    best: dict[str, dict] = {}
    ranges = {name: (spread * 1e-3, spread * 1e2) for name in ("gamma", "lognorm")}
    for _ in range(passes):
        gaps = sorted({low} | {a * (b / a) ** (k / (locations - 1)) for a, b in ranges.values() for k in range(locations)})
        for row in location_profile(df, value, [low - gap for gap in gaps]).collect():
            if row.logs is None:
                continue
            for fit in _fit_rows(row.n, row.total - row.n * row.location, row.logs, row.logs2, low - row.location):
                if fit["distribution"] != "expon":
                    found = fit | {"location": row.location, "aic": 6 + 2 * fit["nll"]}
                    best[fit["distribution"]] = min(best.get(fit["distribution"], found), found, key=lambda f: f["nll"])
        for name, (a, b) in ranges.items():
            step = (b / a) ** (1 / (locations - 1))
            gap = min(max(low - best[name]["location"], spread * 1e-3), spread * 1e2)
            ranges[name] = (max(gap / step, spread * 1e-3), min(gap * step, spread * 1e2))
    rate = max(known["mean"] - low, 1e-300)
    nll = known["n"] * math.log(rate) + known["n"]
    best["expon"] = dict(distribution="expon", shape=None, scale=rate, location=low, nll=nll, aic=4 + 2 * nll)
    columns = ("distribution", "shape", "scale", "location", "nll", "aic")
    rows = [tuple(best[name][c] for c in columns) for name in ("gamma", "lognorm", "expon")]
    return df.sparkSession.createDataFrame(rows, _FIT_SCHEMA)


def anderson_darling(df: DataFrame, key: str, value: str) -> DataFrame:
    """Anderson-Darling normality statistic per series with critical values.

    With ``c`` copies of a value above ``b`` smaller rows the rank weights of its copies add up to
    (b+c)² - b² and (n-b)² - (n-b-c)², so only distinct values are visited.
    """
    moments = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    ranked = ranked_values(df, value, [key]).join(moments, key).filter(F.col("_s") > 0)
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    tails = ranked.select(
        key, "n", "below", "total", normal_log_tail(z).alias("_lower"), normal_log_tail(-z).alias("_upper")
    )
    b, c, n = (F.col(x).cast("double") for x in ("below", "n", "total"))
    left = ((b + c) * (b + c) - b * b) * F.col("_lower")
    right = ((n - b) * (n - b) - (n - b - c) * (n - b - c)) * F.col("_upper")
    out = tails.groupBy(key).agg(F.first("total").cast("double").alias("n"), F.sum(left + right).alias("_sum"))
    factor = 1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))
    return out.select(
        key, F.col("n").cast("long").alias("n"), (-F.col("n") - F.col("_sum") / F.col("n")).alias("statistic"),
        *[F.round(F.lit(c) / factor, 3).alias(f"critical_{str(level).replace('.', '_')}") for c, level in zip(AD_CRITICAL, AD_LEVELS)],
    )


def chi_square_uniform(df: DataFrame, value: str, ddof: int = 1) -> DataFrame:
    """Goodness of fit against equal expected counts, from the sums of x and x²."""
    x = F.col(value).cast("double")
    sums = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    stat = F.try_divide(F.col("v") * F.col("n"), F.col("m"))
    return sums.select("n", stat.alias("statistic"), (F.col("n") - 1 - ddof).alias("dof")).withColumn(
        "p_value", chi2_sf("statistic", F.col("dof").cast("double"))
    )


def ks_f_scan(df: DataFrame, value: str, dfn=range(1, 20), dfd=range(1, 20)) -> DataFrame:
    """Kolmogorov-Smirnov distance to every F(dfn, dfd) law of a grid, with asymptotic p-values.

    Each task takes the largest distance over its own distinct values, so the shuffle carries
    one row per grid point and batch.
    """
    grid = [(int(a), int(b)) for a in dfn for b in dfd]

    def largest(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x, n = pdf["value"].to_numpy(float), pdf["total"].to_numpy(float)
            low = pdf["below"].to_numpy(float) / n
            high = low + pdf["n"].to_numpy(float) / n
            gaps = []
            for a, b in grid:
                cdf = f_cdf(x, a, b)
                gaps.append(float(np.max(np.maximum(high - cdf, cdf - low))))
            yield pd.DataFrame(
                {"dfn": [g[0] for g in grid], "dfd": [g[1] for g in grid], "distance": gaps, "n": int(n[0])}
            )

    def tail(batches):
        for pdf in batches:
            yield pdf.assign(p_value=kolmogorov_sf(pdf["distance"].to_numpy(float), pdf["n"].to_numpy(float)))

    partial = ranked_values(df, value).mapInPandas(largest, "dfn int, dfd int, distance double, n long")
    best = partial.groupBy("dfn", "dfd").agg(F.max("distance").alias("distance"), F.max("n").alias("n"))
    return best.mapInPandas(tail, "dfn int, dfd int, distance double, n long, p_value double")


def _pooled(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    dof = (n1 + n2 - 2).cast("double")
    # A side of one row has no variance; its weight in the pool is zero.
    spread = F.coalesce(v1, F.lit(0.0)) * (n1 - 1) + F.coalesce(v2, F.lit(0.0)) * (n2 - 1)
    pooled = F.try_divide(spread, dof)
    stat = F.try_divide(m1 - m2, F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    return stat, dof


def t_test(df: DataFrame, first: Column, second: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample pooled t-test of the rows meeting ``first`` against those meeting ``second``, per group.

    Count, mean and variance of both sides come from one aggregate; NULL values are left out.
    """
    sides = {"a": F.when(first, F.col(value)), "b": F.when(second, F.col(value))}
    sums = df.groupBy(*by).agg(
        *[
            f(side).alias(f"{name}_{tag}")
            for tag, side in sides.items()
            for f, name in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))
        ]
    )
    stat, dof = _pooled(*[F.col(f"{name}_{tag}") for tag in "ab" for name in ("n", "mean", "var")])
    return sums.withColumns({"t": stat, "dof": dof}).withColumn("p_value", t_two_sided("t", "dof")).drop("var_a", "var_b")


def history_length(
    df: DataFrame, key: str, day: str, date: str, value: str,
    lengths: Sequence[int] = (4, 6, 10, 20, 30, 52), level: float = 0.05,
) -> DataFrame:
    """Smallest number of latest same-weekday values whose mean differs from the whole history.

    The comparison for every length comes from one aggregate over the ranked rows.
    """
    rank = F.row_number().over(Window.partitionBy(key, day).orderBy(F.col(date).desc()))
    ranked = df.withColumn("_r", rank)
    aggs = [F.count(value).alias("n0"), F.avg(value).alias("m0"), F.var_samp(value).alias("v0")]
    for length in lengths:
        side = F.when(F.col("_r") <= length, F.col(value))
        aggs += [F.count(side).alias(f"n{length}"), F.avg(side).alias(f"m{length}"), F.var_samp(side).alias(f"v{length}")]
    sums = ranked.groupBy(key, day).agg(*aggs)
    tests = []
    for length in lengths:
        stat, dof = _pooled(*[F.col(f"{x}{i}") for i in (0, length) for x in "nmv"])
        tests.append(F.struct(F.lit(length).alias("days"), stat.alias("t"), dof.alias("dof")))
    long = sums.select(key, day, F.explode(F.array(*tests)).alias("e")).select(key, day, "e.*")
    scored = long.withColumn("p_value", t_two_sided("t", "dof")).filter(F.col("p_value") <= level)
    best = scored.groupBy(key, day).agg(F.min(F.struct("days", "p_value")).alias("b"))
    return best.select(key, day, F.col("b.days").alias("days"), F.col("b.p_value").alias("p_value"))


def grouped_ols(
    df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, nested: Sequence[str] | None = None
) -> DataFrame:
    """Least squares with intercept per group: ``coefficients`` (intercept last), ``ssr`` and ``n``.

    ``nested`` names a subset of the features; ``ssr_nested`` is then the squared error of the fit on them alone,
    from the same sums.

    One aggregate collects means and covariances, so a hot group is added up map-side like any sum; only
    one small matrix per group reaches Python. Covariances are merged around running means, which keeps them
    accurate for large values.
    """
    names = [*features, label]
    k = len(names)
    known = df.dropna(subset=names).select(*by, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = known.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(f"x{i}") for i in range(k)]).alias("means"),
        F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs]).alias("cov"),
    )

    return ols_of_sums(sums, by, k, None if nested is None else [list(features).index(c) for c in nested])


def ols_of_sums(sums: DataFrame, by: Sequence[str], k: int, nested: Sequence[int] | None = None) -> DataFrame:
    """The fits of :func:`grouped_ols` from ``n``, ``means`` and ``cov`` (upper triangle, row by row) of k columns, the label last;
    ``nested``: places of the features of the smaller fit."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    subset = list(range(k - 1)) if nested is None else list(nested)

    def least(spread: np.ndarray, cols: list[int]) -> tuple[np.ndarray, float]:
        inner, cross = spread[np.ix_(cols, cols)], spread[cols, -1]
        beta, *_ = np.linalg.lstsq(inner, cross, rcond=1e-12)
        return beta, max(float(spread[-1, -1] - 2 * beta @ cross + beta @ inner @ beta), 0.0)

    def solve(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        coefs, ssr, small = [], [], []
        for count, mean, flat in zip(n, means, cov):
            spread = np.zeros((k, k))
            for (i, j), value in zip(pairs, flat):
                spread[i, j] = spread[j, i] = value * count
            beta, left = least(spread, list(range(k - 1)))
            coefs.append([*beta.tolist(), float(mean[-1] - beta @ np.asarray(mean[:-1]))])
            ssr.append(left)
            small.append(left if nested is None else least(spread, subset)[1])
        return pd.DataFrame({"coefficients": coefs, "ssr": ssr, "ssr_nested": small})

    solved = F.pandas_udf(solve, T.StructType([
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("ssr", T.DoubleType()),
        T.StructField("ssr_nested", T.DoubleType()),
    ]))
    out = sums.select(*by, "n", solved("n", "means", "cov").alias("fit")).select(*by, "n", "fit.*")
    return out if nested is not None else out.drop("ssr_nested")


def principal_axis(df: DataFrame, by: Sequence[str], cols: Sequence[str], orient: str) -> DataFrame:
    """First principal axis of standardised columns per group: arrays ``mean``, ``sd`` and ``axis``.

    The correlation matrix of a group is an aggregate; only that matrix is decomposed in Python. The
    sign makes the ``orient`` column load positively. A constant column loads 0.
    """
    k = len(cols)
    sums = df.groupBy(*by).agg(
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("sd"),
        F.array(*[F.covar_pop(a, b) for a in cols for b in cols]).alias("cov"),
    )
    lead = list(cols).index(orient)

    def decompose(cov: pd.Series, sd: pd.Series) -> pd.Series:
        out = []
        for c, s in zip(cov, sd):
            s = np.asarray(s, float)
            scale = np.where(s > 0, s, 1.0)
            matrix = np.asarray(c, float).reshape(k, k) / np.outer(scale, scale)
            axis = np.linalg.eigh(matrix)[1][:, -1]
            pivot = axis[lead] if abs(axis[lead]) > 1e-12 else axis[np.argmax(np.abs(axis))]
            out.append((axis * (1.0 if pivot >= 0 else -1.0)).tolist())
        return pd.Series(out)

    solved = F.pandas_udf(decompose, T.ArrayType(T.DoubleType()))
    return sums.select(*by, "mean", "sd", solved("cov", "sd").alias("axis"))


def project_axis(cols: Sequence[str]) -> Column:
    """Score of a row on the axis columns added by joining :func:`principal_axis`."""
    terms = [
        F.when(F.col("sd")[i] > 0, (F.col(c) - F.col("mean")[i]) / F.col("sd")[i] * F.col("axis")[i]).otherwise(0.0)
        for i, c in enumerate(cols)
    ]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out
