"""Tail probabilities, as Arrow UDFs for rows that are already aggregated (one for each group)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import normal_quantiles


def _each_of(f, x: np.ndarray) -> np.ndarray:
    return np.array([f(v) for v in x.tolist()])


def beta_incs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of each row, by its continued fraction, all rows a step at a time."""
    a, b, x = (np.asarray(v, np.float64) for v in (a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    out = np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, (x >= 1).astype(np.float64))
    a, b, x = a[inside], b[inside], x[inside]
    front = np.exp(_each_of(math.lgamma, a + b) - _each_of(math.lgamma, a) - _each_of(math.lgamma, b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, f, c, d = 1e-300, np.ones(len(a)), np.ones(len(a)), np.zeros(len(a))
    going = np.arange(len(a))
    for i in range(2000):
        if not len(going):
            break
        p, q, z, m = a[going], b[going], x[going], i // 2
        if i == 0:
            term = np.ones(len(going))
        elif i % 2 == 0:
            term = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            term = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        below, above = 1 + term * d[going], 1 + term / c[going]
        d[going] = 1 / np.where(np.abs(below) > tiny, below, tiny)
        c[going] = np.where(np.abs(above) > tiny, above, tiny)
        step = c[going] * d[going]
        f[going] *= step
        going = going[np.abs(1 - step) >= 1e-15]
    out[inside] = front * (f - 1)
    return np.where(turned, 1 - out, out)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if math.isnan(x) or x < 0:
        return math.nan
    if x == 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of t."""
    t, df = np.asarray(t, np.float64), np.asarray(df, np.float64)
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return np.where(np.isnan(t) | np.isnan(df), np.nan, beta_incs(df / 2, np.full(len(df), 0.5), x))


def f_tails(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper p-values of F."""
    f, d1, d2 = (np.asarray(v, np.float64) for v in (f, d1, d2))
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    return np.where(np.isnan(f), np.nan, beta_incs(d2 / 2, d1 / 2, x))


def t_two_sided(t: float, df: float) -> float:
    return float(t_tails(np.array([t]), np.array([df]))[0])


def f_upper(f: float, d1: float, d2: float) -> float:
    return float(f_tails(np.array([f]), np.array([d1]), np.array([d2]))[0])


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@cache
def _rank_sums(n1: int, n2: int) -> np.ndarray:
    """How many of the choices of n1 of n1 + n2 ranks give each U, as shares."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for k in range(1, n1 + n2 + 1):  # rank k taken as the j-th: adds k - j to U
        for j in range(min(k, n1), 0, -1):
            shift = k - j
            if shift <= n2:
                ways[j, shift:] += ways[j - 1, : ways.shape[1] - shift]
    return ways[n1] / ways[n1].sum()


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided: exact where a sample has at most 8 values and there are no ties, else normal with continuity correction. ties: the sum of t^3 - t."""
    if not n1 or not n2 or math.isnan(u):
        return math.nan
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and ties == 0:
        # the smaller sample first: U's distribution is the same
        return min(1.0, 2 * float(_rank_sums(min(n1, n2), max(n1, n2))[math.ceil(top) :].sum()))
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    return math.nan if var <= 0 else min(1.0, 2 * normal_upper((top - n1 * n2 / 2 - 0.5) / math.sqrt(var)))


#: Royston's polynomials, highest power first, for W's weights and for the mean and spread of its transform.
LAST_WEIGHT = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
NEXT_WEIGHT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SMALL_MEAN, SMALL_SPREAD = (-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822)
LARGE_MEAN, LARGE_SPREAD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


def shapiro_p(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The p-values of W, by Royston's approximations; NaN below three values."""
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(1 - w)
        gamma = 0.459 * n - 2.273
        few, x = n <= 11, np.log(n)
        place = np.where(few, -np.log(gamma - y), y)
        mean = np.where(few, np.polyval(SMALL_MEAN, n), np.polyval(LARGE_MEAN, x))
        spread = np.exp(np.where(few, np.polyval(SMALL_SPREAD, np.minimum(n, 11)), np.polyval(LARGE_SPREAD, x)))
        p = _each_of(normal_upper, (place - mean) / spread)
        three = np.maximum(0.0, 6 / math.pi * (np.arcsin(np.sqrt(w)) - math.asin(math.sqrt(0.75))))
    p = np.where(n == 3, three, np.where(few & (y >= gamma), 0.0, p))
    return np.where((n < 3) | np.isnan(w), np.nan, np.where(w >= 1, 1.0, p))


def _each(f, *columns: pd.Series) -> pd.Series:
    rows = zip(*(c.to_numpy() for c in columns), strict=True)
    return pd.Series([None if any(x is None or x != x for x in r) else f(*map(float, r)) for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tails(t, df)).where(t.notna().to_numpy() & df.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_tails(f, d1, d2)).where(f.notna().to_numpy() & d1.notna().to_numpy() & d2.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def mann_whitney_pvalue(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return _each(lambda a, b, c, d: mann_whitney_p(a, int(b), int(c), d), u, n1, n2, ties)


SCORES = 1 << 20  # normal scores at a time


@F.pandas_udf(T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("squares", T.DoubleType())]))
def score_sums(before: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The sum of the normal scores (i - 3/8) / (n + 1/4) of the places i after `before`, as many as cnt, and of their squares."""
    first, of = (x.to_numpy(np.float64) for x in (before, n))
    size = cnt.to_numpy(np.int64)
    ends, total, squares, at = np.cumsum(size), np.zeros(len(size)), np.zeros(len(size)), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SCORES, "right")))
        starts = ends[at:stop] - size[at:stop] - (ends[at] - size[at])
        for piece in range(0, int(size[at]) if stop == at + 1 else 1, SCORES):  # a value that is there more often comes in pieces
            many = np.minimum(size[at:stop] - piece, SCORES)
            places = np.repeat(first[at:stop] + piece - starts, many) + np.arange(1, int(many.sum()) + 1)
            scores = normal_quantiles((places - 0.375) / (np.repeat(of[at:stop], many) + 0.25))
            total[at:stop] += np.add.reduceat(scores, starts)
            squares[at:stop] += np.add.reduceat(scores * scores, starts)
        at = stop
    return pd.DataFrame({"sum": total, "squares": squares})


def shapiro_w(n: np.ndarray, m2: np.ndarray, mx: np.ndarray, ss: np.ndarray, x2: np.ndarray, y2: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """W of each row's n values, at least three: m2 and mx are the sums of the squared scores and of scores times values; ss the sum of squares about the mean.

    Values are distances from the least one; x2, y2 and y1 are the second, the last but one and the last.
    """
    top, second = (normal_quantiles((n - k) / (n + 0.25)) for k in (0.375, 1.375))
    u, c = n**-0.5, m2**0.5
    last, near = np.polyval(LAST_WEIGHT, u) + top / c, np.polyval(NEXT_WEIGHT, u) + second / c
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = (m2 - 2 * top**2) / (1 - 2 * last**2)
        five = last * y1 + (mx - top * y1) / phi**0.5
        phi = (m2 - 2 * top**2 - 2 * second**2) / (1 - 2 * last**2 - 2 * near**2)
        more = last * y1 + near * (y2 - x2) + (mx - top * y1 - second * (y2 - x2)) / phi**0.5
        b = np.where(n == 3, y1 * 0.5**0.5, np.where(n <= 5, five, more))
        return np.where(ss == 0, 1.0, np.minimum(b * b / ss, 1.0))


@F.pandas_udf(T.StructType([T.StructField("statistic", T.DoubleType()), T.StructField("pvalue", T.DoubleType())]))
def shapiro_test(n: pd.Series, m2: pd.Series, mx: pd.Series, ss: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """W and its p-value; null below three values, or with one that isn't finite."""
    all_ = np.stack([c.to_numpy(np.float64, na_value=math.nan) for c in (n, m2, mx, ss, x2, y2, y1)])
    known = (all_[0] >= 3) & np.isfinite(all_).all(0)
    w, p = np.full(len(known), np.nan), np.full(len(known), np.nan)
    w[known] = shapiro_w(*all_[:, known])
    p[known] = shapiro_p(w[known], all_[0, known])
    return pd.DataFrame({"statistic": w, "pvalue": p})
