"""Box-Cox transform, and the data behind histograms, normal curves, Q-Q plots and box plots."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inverse_normal
from .ranks import value_ranks
from .selection import values_along, values_at


def box_cox_of(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else F.expm1(lam * F.log(x)) / lam


LAMBDAS = 33  # tried at once
BINS = 1 << 14  # of the logarithms
STEP = 1e-3  # distance at which a found lambda is held against its neighbours


def _likelihoods(logs: DataFrame, n: int, mean: float, lambdas: Sequence[float]) -> list[float]:
    """The log-likelihood of each lambda but for a constant, in one pass over the logarithms (column l, of this mean)."""
    z = F.col("l") - mean
    forms = [F.var_pop(z if abs(lam) < 1e-12 else F.expm1(F.lit(lam) * z) / lam) for lam in lambdas]
    return [-n / 2 * math.log(s) if s is not None and s > 0 and math.isfinite(s) else -math.inf for s in logs.agg(*forms).first()]


def _summary(logs: DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms from low to high as at most 2 * BINS points and their weights.

    A bin's points are its mean plus and minus its deviation, so its count, mean and variance are exact; what a smooth
    function's sum over it misses comes from third moments: below its third derivative times the bin's width cubed, a row.
    """
    place = F.least(F.floor((F.col("l") - low) / (high - low) * BINS), F.lit(BINS - 1))
    bins = logs.groupBy(place.alias("bin")).agg(F.count("l"), F.avg("l"), F.var_pop("l")).collect()  # at most BINS rows
    count, mean, var = np.array([r[1:] for r in bins], float).T
    return np.r_[mean - var**0.5, mean + var**0.5], np.r_[count, count] / 2


def _likeliest(scores: Callable[[Sequence[float]], Sequence[float]], lo: float = -2.0, hi: float = 2.0) -> float:
    for _ in range(60):
        lambdas = [lo + (hi - lo) * k / (LAMBDAS - 1) for k in range(LAMBDAS)]
        found = scores(lambdas)
        k = max(range(LAMBDAS), key=found.__getitem__)
        width = hi - lo
        if k in (0, LAMBDAS - 1) and width > 1:  # the edge isn't a bound
            lo, hi = lambdas[k] - width, lambdas[k] + width
            continue
        lo, hi = lambdas[max(k - 1, 0)], lambdas[min(k + 1, LAMBDAS - 1)]
        if hi - lo < 1e-8:
            break
    return (lo + hi) / 2


def box_cox(df: DataFrame, column: str, lambdas: Sequence[float] | None = None, digits: int | None = None) -> tuple[DataFrame, float]:
    """Adds {column}_boxcox with the likeliest lambda (of these, if given; rounded to so many digits, if any), and that lambda.

    Values are moved above zero if any isn't; constant ones raise ValueError. Without values the column is null and lambda NaN. NaN and infinities
    take no part in the search. Three passes over the column: its range, a summary of its logarithms in BINS bins, in which
    lambda is searched on the driver, and the exact likelihoods of what was found and its neighbours; only if these disagree are exact passes made until they don't.
    """
    v, name = F.col(column).cast("double"), f"{column}_boxcox"
    finite = F.when(F.abs(v) < float("inf"), v)
    n, low, high = df.agg(F.count(finite), F.min(finite), F.max(finite)).first()
    if not n:
        return df.withColumn(name, F.lit(None).cast("double")), math.nan
    if low == high:
        raise ValueError("Box-Cox needs values that differ")
    shift = 0.0 if low > 0 else 1e-6 - low
    x = v if low > 0 else v - low + 1e-6
    logs = df.where(finite.isNotNull()).select(F.log(x).alias("l"))
    if lambdas is not None:
        mean = logs.agg(F.avg("l")).first()[0]
        scores = _likelihoods(logs, n, mean, lambdas)
        lam = lambdas[max(range(len(lambdas)), key=scores.__getitem__)]
        return df.withColumn(name, box_cox_of(x, lam)), lam
    points, weight = _summary(logs, math.log(low + shift), math.log(high + shift))
    mean = float((points * weight).sum() / n)

    def scores(some: Sequence[float]) -> list[float]:
        out = []
        for lam in some:
            with np.errstate(over="ignore", invalid="ignore"):
                y = points - mean if abs(lam) < 1e-12 else np.expm1(lam * (points - mean)) / lam
                m = (y * weight).sum() / n
                s = ((y - m) ** 2 * weight).sum() / n
            out.append(-n / 2 * math.log(s) if s > 0 and math.isfinite(s) else -math.inf)
        return out

    lam = _likeliest(scores)
    near = _likelihoods(logs, n, mean, [lam - STEP, lam, lam + STEP])
    if near[1] < max(near):
        lam = _likeliest(lambda some: _likelihoods(logs, n, mean, some), lam - 0.5, lam + 0.5)
    lam = lam if digits is None else round(lam, digits)
    return df.withColumn(name, box_cox_of(x, lam)), lam


def _span(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, left, right, count, density of equal bins from min to max, the last one closed; equal values spread half a unit to each side."""
    one = F.broadcast(_span(df, column))  # one row
    lo = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) / bins
    place = F.least(F.floor((F.col(column).cast("double") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).join(one).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(one).join(counts, "bin", "left")
    return every.select(
        "bin",
        (lo + F.col("bin") * width).alias("left"),
        (lo + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.nullif(F.col("n"), F.lit(0)) * width)).alias("density"),
    )


def normal_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """i, x, density of the normal with the column's mean and population deviation, at equal steps from min to max."""
    x = F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / (points - 1)
    sd = F.nullif(F.col("sd"), F.lit(0.0))  # divided by before the filter, for all that's known
    z = (F.col("x") - F.col("mean")) / sd
    curve = df.sparkSession.range(points).join(F.broadcast(_span(df, column)))
    return curve.withColumn("x", x).where("sd > 0").select(
        F.col("id").cast("int").alias("i"), "x", (F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))).alias("density")
    )


def _filliben(i: Column, n: Column) -> Column:
    """The normal quantile of the i-th of n order statistics' median."""
    end = F.pow(F.lit(0.5), 1 / n)
    return inverse_normal(F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365)))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """i, theoretical, sample: normal quantiles of Filliben's medians beside the sorted values."""
    ranked = value_ranks(df.select(column), [], column)
    each = ranked.withColumn("i", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("cnt"))))
    return each.select("i", _filliben(F.col("i"), F.col("n")).alias("theoretical"), F.col(column).cast("double").alias("sample"))


def qq_picked(df: DataFrame, column: str, points: int = 256) -> DataFrame:
    """At most `points` of qq_points, at equal steps of i, the first and the last among them; found by bracketing, so that no large column is sorted."""
    picked = values_along(df.select(column), column, points).withColumn("i", F.col("place") + 1)
    return picked.select("i", _filliben(F.col("i"), F.col("n")).alias("theoretical"), F.col("v").alias("sample"))


def qq_line(points: DataFrame) -> DataFrame:
    """The first and last point."""
    return points.agg(
        F.min_by(F.struct("theoretical", "sample"), "i").alias("a"), F.max_by(F.struct("theoretical", "sample"), "i").alias("b")
    ).select(F.explode(F.array("a", "b")).alias("p")).select("p.*")


def box_statistics(df: DataFrame, column: str) -> DataFrame:
    """q1, median, q3 (linear), whisker_low and whisker_high (the last values within 1.5 times q3 - q1), fliers (how many are beyond)."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    along = lambda n, q: (n - 1) * q
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    places = {f"{name}_{side}": lambda n, f=f, q=q: f(along(n, q)) for name, q in quartiles.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    box = values_at(values, [], "v", places)
    n = F.col("n")
    linear = lambda name, q: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (along(n, q) - F.floor(along(n, q)))
    box = box.select(*[linear(name, q).alias(name) for name, q in quartiles.items()])  # one row
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    return values.join(F.broadcast(box)).groupBy(*quartiles).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def marks(df: DataFrame, column: str, steps: int = 512) -> DataFrame:
    """v: of the values beyond the whiskers, the least of each of so many equal steps from min to max; enough for a picture."""
    v = F.col("v")
    one = F.broadcast(_span(df, column).select("lo", "hi"))  # one row
    step = F.floor((v / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0)) * steps)
    return fliers(df, column).join(one).groupBy(step.alias("step")).agg(F.min("v").alias("v")).select("v")


def fliers(df: DataFrame, column: str) -> DataFrame:
    """The values beyond the whiskers."""
    one = F.broadcast(box_statistics(df, column))
    return df.select(F.col(column).cast("double").alias("v")).join(one).where("v < whisker_low OR v > whisker_high").select("v")
