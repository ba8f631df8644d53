"""Variance components and repeatability per chromosome and window: one-way ANOVA and a Bayesian mixed model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import divide

WINDOW = ["chra", "windowa"]


RESULTS = (
    "anova_sigma_alpha_sq",
    "anova_sigma_epsilon_sq",
    "anova_repeatability",
    "anova_f_value",
    "bayes_sigma_alpha_sq",
    "bayes_sigma_epsilon_sq",
    "bayes_repeatability",
)
CATEGORIES = ("P", "M")


def category_codes(group: Column, categories: Sequence[str] = CATEGORIES) -> Column:
    """A group's place among the categories, from 0; null for any other."""
    return F.coalesce(*[F.when(group == c, k) for k, c in enumerate(categories)])


def _summaries(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row for each window: rows, values (not null), trait_id, groups with values, how many of them are known, whether all values are equal, and g, the known groups (in order, at most two) with n, mean and ss."""
    v = F.col(value).cast("double")
    g = df.groupBy(*WINDOW, group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("n"),
        F.avg(v).alias("m"),
        (F.var_pop(v) * F.count(v)).alias("ss"),
        F.min(F.when(v.isNotNull(), F.col("trait_id"))).alias("trait_id"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    some = F.col("n") > 0
    g = g.withColumn("code", F.when(some, category_codes(F.col(group))))
    only = g.groupBy(*WINDOW).agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("values"),
        F.min("trait_id").alias("trait_id"),
        F.count_if(some).alias("groups"),
        F.count("code").alias("known"),
        (F.min("low") == F.max("high")).alias("constant"),
        *[F.max(F.when(F.col("code") == k, F.struct("n", "m", "ss"))).alias(f"g{k}") for k in range(len(CATEGORIES))],
    )
    listed = F.filter(F.array(*[f"g{k}" for k in reversed(range(len(CATEGORIES)))]), lambda x: x.isNotNull())
    return only.select(*WINDOW, "rows", "values", "trait_id", "groups", "known", "constant", listed.alias("g"))


def _windows(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row for each window with values: trait_id and g. Windows with a group other than P and M are left out; window_reasons names them."""
    return _summaries(df, value, group).where((F.col("values") > 0) & (F.col("groups") == F.col("known"))).select(*WINDOW, "trait_id", "g")


#: Why a window has no result, or only NaN and null in it; the first that holds is given.
UNLISTED, NO_ROWS, NO_VALUES, UNKNOWN, ONE_GROUP, CONSTANT = "no dictionary row", "no rows", "no values", "unknown group", "one group", "constant"


def window_reasons(df: DataFrame, value: str, group: str = "origin", windows: DataFrame | None = None) -> DataFrame:
    """chra, windowa, rows and reason of each window: null for those with a result.

    windows: a dictionary (chra, windows); its windows without rows are named too, and those beyond it. 'unknown group' and what is above it leave no
    result; one group gives NaN and a constant null in some columns.
    """
    found = _summaries(df, value, group)
    if windows is not None:
        listed = windows.where("windows > 0").select(
            F.col("chra"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("windowa"), F.lit(True).alias("listed")
        )
        found = found.join(listed, WINDOW, "full")
    else:
        found = found.withColumn("listed", F.lit(True))
    reason = F.when(F.col("listed").isNull(), UNLISTED).when(F.col("rows").isNull(), NO_ROWS).when(F.col("values") == 0, NO_VALUES).when(
        F.col("groups") > F.col("known"), UNKNOWN
    ).when(F.col("groups") == 1, ONE_GROUP).when(F.col("constant"), CONSTANT)
    return found.select(*WINDOW, F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))


def _with_anova(g: DataFrame) -> DataFrame:
    """Adds ssb, ssw and the first four of RESULTS to _windows. At most two groups are summed."""
    over = lambda f: F.aggregate("g", F.lit(0.0), lambda acc, x: acc + f(x))
    g = g.withColumn("N", over(lambda x: x["n"])).withColumn("k", F.size("g")).withColumn("ssw", over(lambda x: x["ss"]))
    g = g.withColumn("mean", over(lambda x: x["n"] * x["m"]) / F.col("N"))
    g = g.withColumn("ssb", over(lambda x: x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean"))))
    nan, one = F.lit(float("nan")), F.col("k") < 2
    msb, msw = divide(F.col("ssb"), F.col("k") - 1), divide(F.col("ssw"), F.col("N") - F.col("k"))
    alpha = F.greatest((msb - msw) / (F.col("N") / F.col("k")), F.lit(0.0))
    g = g.withColumn(RESULTS[0], F.when(one, nan).otherwise(alpha)).withColumn(RESULTS[1], msw)
    g = g.withColumn(RESULTS[2], F.when(one, nan).otherwise(divide(F.col(RESULTS[0]), F.col(RESULTS[0]) + F.col(RESULTS[1]))))
    return g.withColumn(RESULTS[3], F.when(one, nan).otherwise(divide(msb, msw)))


def anova(df: DataFrame, value: str, group: str = "origin") -> DataFrame:
    """chra, windowa, trait_id, ssb, ssw and the anova columns of RESULTS; NaN where only one group is there. N / k is used for unequal groups too."""
    return _with_anova(_windows(df, value, group)).select(*WINDOW, "trait_id", "ssb", "ssw", *RESULTS[:4])


def posterior_sds(n: np.ndarray, mean: np.ndarray, ssw: float, points: int = 300) -> tuple[float, float]:
    """Posterior means of the two standard deviations of standardised data, by quadrature; mu and group effects are integrated out."""

    def log_p(sa, se):
        va = sa[:, None, None] ** 2 + se[None, :, None] ** 2 / n
        inv = 1 / va
        a, b, c = inv.sum(-1), (inv * mean).sum(-1), (inv * mean**2).sum(-1)
        one = 1 + 0.25 * a
        return -(n.sum() - len(n)) * np.log(se)[None] - ssw / (2 * se[None] ** 2) - 0.5 * (np.log(va).sum(-1) + np.log(one)) - 0.5 * (c - 0.25 * b**2 / one) - (
            sa[:, None] ** 2 + se[None] ** 2
        ) / 0.5

    grid = np.geomspace(1e-3, 3, points)
    p = log_p(grid, grid)
    rows, cols = np.nonzero(p > p.max() - 40)
    sides = []
    for hit in (rows, cols):
        lo, hi = grid[max(hit.min() - 1, 0)] if hit.min() else 0.0, grid[min(hit.max() + 1, points - 1)]
        sides.append(lo + (np.arange(points) + 0.5) / points * (hi - lo))
    p = log_p(*sides)
    p = np.exp(p - p.max())
    return float((p.sum(1) * sides[0]).sum() / p.sum()), float((p.sum(0) * sides[1]).sum() / p.sum())


@F.pandas_udf(T.StructType([T.StructField("sa", T.DoubleType()), T.StructField("se", T.DoubleType())]))
def _posterior(n: pd.Series, m: pd.Series, ss: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, c in zip(n, m, ss, strict=True):
        a, b, c = (np.asarray(x, float) for x in (a, b, c))
        total = a.sum()
        mean = (a * b).sum() / total
        scale = ((c.sum() + (a * (b - mean) ** 2).sum()) / total) ** 0.5
        if not scale > 0:
            out.append((np.nan, np.nan))
            continue
        sa, se = posterior_sds(a, (b - mean) / scale, c.sum() / scale**2)
        out.append(((sa * scale) ** 2, (se * scale) ** 2))
    return pd.DataFrame(out, columns=["sa", "se"])


def _with_bayes(g: DataFrame) -> DataFrame:
    g = g.withColumn("p", _posterior("g.n", "g.m", "g.ss"))
    a, e = F.col("p.sa"), F.col("p.se")
    return g.withColumn(RESULTS[4], a).withColumn(RESULTS[5], e).withColumn(RESULTS[6], divide(a, a + e))


def bayes(df: DataFrame, value: str, group: str = "origin") -> DataFrame:
    """chra, windowa, trait_id and the bayes columns of RESULTS: squares of posterior mean deviations; null for constant values."""
    return _with_bayes(_windows(df, value, group)).select(*WINDOW, "trait_id", *RESULTS[4:])


def windows_of(df: DataFrame, windows: DataFrame, chromosome: int | None = None) -> DataFrame:
    """Rows of windows 0 to the number that a dictionary (chra, windows) gives for their chromosome; of one chromosome, if asked for."""
    if chromosome is not None:
        df, windows = df.where(F.col("chra") == chromosome), windows.where(F.col("chra") == chromosome)
    return df.join(windows, "chra").where((F.col("windowa") >= 0) & (F.col("windowa") < F.col("windows"))).drop("windows")


def variance_components(df: DataFrame, value: str, group: str = "origin") -> DataFrame:
    """chra, windowa, trait_id and RESULTS for each window."""
    return _with_bayes(_with_anova(_windows(df, value, group))).select(*WINDOW, "trait_id", *RESULTS)
