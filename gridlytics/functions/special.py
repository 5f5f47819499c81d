"""Probability functions in numpy, applied to summary rows or to distinct values only.

The tails use the standard series and continued fractions of the incomplete gamma and beta functions, run until every
element has settled; beyond the shapes for which that is quick, the gamma tail uses its uniform asymptotic expansion. An element that
has not settled is NaN, which becomes NULL. Everything is vectorised over the Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_LARGE = 1e5  # shape from which the gamma tail is expanded


def _rounds(largest: float) -> int:
    """Terms after which series and fractions have settled: they grow with the root of the shape."""
    return int(300 + 40 * np.sqrt(min(largest, 1e8)))


def _stirling(x: np.ndarray) -> np.ndarray:
    """What the logarithm of the gamma function has beyond (x - 1/2) ln x - x + ln(2 pi) / 2, for x of 10 or more."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x


def _lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    shift = x < 10
    up = np.where(shift, x + 10, x)
    out = (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + _stirling(up)
    below = np.ones_like(x)
    for k in range(10):
        below = below * np.where(shift, x + k, 1.0)
    return np.where(x > 0, out - np.log(np.where(x > 0, below, 1.0)), np.nan)


def _excess(m: np.ndarray) -> np.ndarray:
    """m - ln(1 + m), without loss of digits near 0."""
    near = np.abs(m) < 0.01
    small = np.where(near, m, 0.0)
    series = sum((-1) ** k * small**k / k for k in range(2, 10))
    return np.where(near, series, m - np.log1p(np.maximum(np.where(near, 0.0, m), -1 + 1e-16)))


def _settle(c):
    return np.where(np.abs(c) < _TINY, _TINY, c)


def log_erfc(x) -> np.ndarray:
    """Logarithm of the complementary error function: a series below 2, a continued fraction above."""
    x = np.asarray(x, float)
    size = np.abs(x)
    near = np.where(size < 2, size, 0.0)
    term = total = near
    for k in range(1, 60):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    erf = 2 / np.sqrt(np.pi) * np.exp(-near * near) * total
    far = np.where(size < 2, 2.0, size)
    tail = far
    for k in range(120, 0, -1):  # from the inside out; settled well before 120 from 2 on
        tail = far + k / 2 / tail
    log_tail = -far * far - np.log(tail) - 0.5 * np.log(np.pi)
    positive = np.where(size < 2, np.log1p(-np.minimum(erf, 1 - 1e-16)), log_tail)
    negative = np.where(size < 2, np.log1p(erf), np.log(2.0) + np.log1p(-0.5 * np.exp(log_tail)))
    return np.where(x >= 0, positive, negative)


def _gamma_front(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x^a e^-x / gamma(a), from the distance of x and a where both are large."""
    big = np.maximum(a, 10.0)
    close = np.sqrt(big / (2 * np.pi)) * np.exp(-big * _excess((x - big) / big) - _stirling(big))
    plain = np.exp(a * np.log(np.maximum(x, _TINY)) - x - _lgamma(a))
    return np.where(a >= 10, close, plain)


def _gamma_expanded(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Uniform expansion of Q(a, x) for large a: a normal tail and two terms of its correction."""
    m = (x - a) / a
    eta = np.sign(m) * np.sqrt(2 * np.maximum(_excess(m), 0.0))
    near = np.abs(eta) < 0.05
    e = np.where(near, eta, 0.0)
    # The expansions of the two terms around 0.
    first = -1 / 3 + e / 12 - 2 * e**2 / 135 + e**3 / 864 + e**4 / 2835
    second = -1 / 540 - e / 288
    em, mm = np.where(near, 1.0, eta), np.where(near, 1.0, m)
    first = np.where(near, first, 1 / mm - 1 / em)
    second = np.where(near, second, 1 / em**3 - 1 / mm**3 - 1 / mm**2 - 1 / (12 * mm))
    correction = np.exp(-a * eta * eta / 2) / np.sqrt(2 * np.pi * a) * (first + second / a)
    return 0.5 * np.exp(log_erfc(eta * np.sqrt(a / 2))) + correction


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    large = a > _LARGE
    b_, y = np.where(large, 1.0, a), np.where(large, 1.0, x)
    scale = _gamma_front(b_, np.maximum(y, _TINY))
    # Each side is evaluated only where it converges: the power series below a + 1, the fraction above.
    below = y < b_ + 1.0
    near, far = np.where(below, y, b_), np.where(below, b_ + 1.0, y)
    rounds = _rounds(float(b_.max())) if b_.size else 0
    term = total = 1.0 / b_
    series_done = np.zeros(b_.shape, bool)
    for k in range(1, rounds):
        term = term * near / (b_ + k)
        total = total + term
        series_done = np.abs(term) <= 1e-16 * np.abs(total)
        if series_done.all():
            break
    b = far + 1.0 - b_
    c = np.full_like(far, 1.0 / _TINY)
    d = 1.0 / _settle(b)
    h = d
    fraction_done = np.zeros(b_.shape, bool)
    for k in range(1, rounds):
        an = -k * (k - b_)
        b = b + 2.0
        d = 1.0 / _settle(an * d + b)
        c = _settle(b + an / c)
        h = h * d * c
        fraction_done = np.abs(d * c - 1.0) < 1e-14
        if fraction_done.all():
            break
    out = np.where(below, np.where(series_done, 1.0 - scale * total, np.nan), np.where(fraction_done, scale * h, np.nan))
    out = np.where(large, _gamma_expanded(np.where(large, a, 1e6), np.where(large, np.maximum(x, 0.0), 1e6)), out)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


def _beta_front(p, q, z, rest) -> np.ndarray:
    """z^p (1-z)^q / B(p, q); `rest` is 1 - z, kept apart so that neither loses digits."""
    big, small = np.maximum(p, q), np.minimum(p, q)
    safe = np.maximum(big, 10.0)
    ratio = (safe - 0.5) * np.log1p(small / safe) + small * np.log(safe + small) - small + _stirling(safe + small) - _stirling(safe)
    log_beta = _lgamma(small) - np.where(big >= 10, ratio, _lgamma(big + small) - _lgamma(big))
    log_z = np.where(rest < 0.5, np.log1p(-np.minimum(rest, 0.5)), np.log(np.maximum(z, _TINY)))
    log_rest = np.where(z < 0.5, np.log1p(-np.minimum(z, 0.5)), np.log(np.maximum(rest, _TINY)))
    return np.exp(p * log_z + q * log_rest - log_beta)


def beta_lower(a, b, x, rest=None) -> np.ndarray:
    """Regularised lower incomplete beta I_x(a, b); `rest` is 1 - x where the caller has it in full."""
    rest = 1.0 - np.asarray(x, float) if rest is None else rest
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z, other = np.clip(np.where(swap, rest, x), 0.0, 1.0), np.clip(np.where(swap, x, rest), 0.0, 1.0)
    front = _beta_front(p, q, z, other) / p
    c = np.ones_like(z)
    d = 1.0 / _settle(1.0 - (p + q) * z / (p + 1.0))
    h = d
    done = np.zeros(z.shape, bool)
    for m in range(1, _rounds(float(max(a.max(), b.max()))) if a.size else 0):
        step = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / _settle(1.0 + step * d)
        c = _settle(1.0 + step / c)
        h = h * d * c
        step = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / _settle(1.0 + step * d)
        c = _settle(1.0 + step / c)
        h = h * d * c
        done = np.abs(d * c - 1.0) < 1e-14
        if done.all():
            break
    inner = np.where(done, np.clip(front * h, 0.0, 1.0), np.nan)
    out = np.where(swap, 1.0 - inner, inner)
    return np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, out))


def f_cdf(x, dfn, dfd) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0.0)
    return beta_lower(np.asarray(dfn, float) / 2, np.asarray(dfd, float) / 2, dfn * x / (dfn * x + dfd), dfd / (dfn * x + dfd))


def kolmogorov_sf(d, n) -> np.ndarray:
    """Asymptotic two-sided Kolmogorov tail with the usual small-sample argument."""
    root = np.sqrt(np.asarray(n, float))
    t = (root + 0.12 + 0.11 / root) * np.asarray(d, float)
    k = np.arange(1, 101)[:, None]
    series = 2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * k**2 * np.ravel(t) ** 2), axis=0)
    return np.where(np.ravel(t) < 0.2, 1.0, np.clip(series, 0.0, 1.0)).reshape(np.shape(t))


def _masked(values: np.ndarray, *inputs: pd.Series) -> pd.Series:
    bad = np.isnan(values)
    for one in inputs:
        bad |= one.isna().to_numpy()
    return pd.Series(np.where(bad, None, values), dtype=object)


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    s, d = stat.fillna(1.0).to_numpy(float), dof.fillna(1.0).to_numpy(float)
    return _masked(gamma_upper(np.maximum(d, 1e-9) / 2, s / 2), stat, dof)


@F.pandas_udf(T.DoubleType())
def t_two_sided(stat: pd.Series, dof: pd.Series) -> pd.Series:
    s, d = stat.fillna(1.0).to_numpy(float), dof.fillna(1.0).to_numpy(float)
    d = np.maximum(d, 1e-9)
    return _masked(beta_lower(d / 2, 0.5, d / (d + s * s), s * s / (d + s * s)), stat, dof)


@F.pandas_udf(T.DoubleType())
def f_sf(stat: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    s = np.maximum(stat.fillna(1.0).to_numpy(float), 0.0)
    n, d = dfn.fillna(1.0).to_numpy(float), dfd.fillna(1.0).to_numpy(float)
    return _masked(beta_lower(d / 2, n / 2, d / (d + n * s), n * s / (d + n * s)), stat, dfn, dfd)


def normal_log_cdf(z) -> np.ndarray:
    """Logarithm of the normal distribution function, also where the function itself is 0 as a double."""
    return log_erfc(-np.asarray(z, float) / np.sqrt(2.0)) - np.log(2.0)


@F.pandas_udf(T.DoubleType())
def normal_log_tail(z: pd.Series) -> pd.Series:
    return _masked(normal_log_cdf(z.fillna(0.0).to_numpy(float)), z)
