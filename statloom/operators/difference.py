"""Tests per trait: normality, equal variances, two-group differences, and the choice among them.

Input: trait_id, a value, and origin (P and M). Null values are left out; NaN
makes a trait's results NaN. All traits are computed at once; p-values are
functions of one aggregated row for each trait.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.columns import divide, inverse_normal
from . import selection
from .ranks import by_size, join_groups, value_ranks
from .selection import median, median_places, with_values_at

KEY = ["trait_id"]
NAN = float("nan")


def _scored(ranked: DataFrame, value: str) -> DataFrame:
    """Adds d, the distance from the trait's least value (sums of distances lose few digits), and the sums of each value's normal scores."""
    ranked = ranked.withColumn("d", F.col(value).cast("double") - F.col("least").cast("double"))
    return ranked.withColumn("scores", tails.score_sums("before", "cnt", "n"))


def _normality() -> list[Column]:
    """Aggregates over _scored that tails.shapiro_test takes. Scores of tied values are summed, not spread over rows."""
    d, cnt, n = F.col("d"), F.col("cnt"), F.col("n")
    at = lambda k: F.max(F.when((F.col("before") < k) & (k <= F.col("before") + cnt), d))
    total = F.sum(cnt * d)
    ss = F.greatest(F.sum(cnt * d * d) - total * total / F.max(n), F.lit(0.0))
    sums = [F.sum("scores.squares").alias("w_squares"), F.sum(F.col("scores.sum") * d).alias("w_sum"), ss.alias("ss")]
    return [F.max(n).alias("n"), *sums, at(2).alias("x2"), at(n - 1).alias("y2"), at(n).alias("y1")]


def _shapiro() -> Column:
    """A struct of statistic and pvalue, over a row with the aggregates of _normality."""
    return tails.shapiro_test("n", "w_squares", "w_sum", "ss", "x2", "y2", "y1")


def shapiro(df: DataFrame, value: str) -> DataFrame:
    """trait_id, n, statistic (W), pvalue; null below three values, and 1 for equal ones."""
    ranked = value_ranks(df.select(*KEY, value), KEY, value)
    agg = _scored(ranked, value).groupBy(*KEY).agg(*_normality()).withColumn("w", _shapiro())
    statistic = F.when(F.isnan("ss"), F.lit(NAN)).otherwise(F.col("w.statistic"))
    return agg.select(*KEY, "n", statistic.alias("statistic"), F.col("w.pvalue").alias("pvalue"))


def _sides() -> tuple[Column, Column]:
    return F.count_if(F.col("origin") == "P").alias("p"), F.count_if(F.col("origin") == "M").alias("m")


def _rank_sums(value: str) -> list[Column]:
    """Aggregates over values with p, m and their running sums: the rank sum of P, ties, and whether a value is NaN."""
    both, before = F.col("p") + F.col("m"), F.col("before_p") + F.col("before_m")
    ties = F.sum((both * both * both - both).cast("double"))
    return [F.sum(F.col("p") * (before + (both + 1) / 2)).alias("r"), ties.alias("ties"), F.max(F.isnan(F.col(value).cast("double"))).alias("nan")]


def _u() -> Column:
    """U of P over a row with n1, n2 and the aggregates of _rank_sums."""
    n1 = F.col("n1")
    return F.when((n1 == 0) | (F.col("n2") == 0) | F.col("nan"), F.lit(NAN)).otherwise(F.col("r") - n1 * (n1 + 1) / 2)


def mann_whitney(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic (U of P), pvalue (two-sided). NaN where a group is empty."""
    rows = df.where(F.col("origin").isin("P", "M")).select(*KEY, "origin", value)
    agg = value_ranks(rows, KEY, value, *_sides(), counts=("cnt", "p", "m"))
    agg = agg.groupBy(*KEY).agg(F.sum("p").alias("n1"), F.sum("m").alias("n2"), *_rank_sums(value))
    return agg.select(*KEY, _u().alias("statistic"), tails.mann_whitney_pvalue(_u(), "n1", "n2", "ties").alias("pvalue"))


def _two(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    part = lambda f, g: f(F.when(F.col("origin") == g, v))
    return df.groupBy(*KEY).agg(
        *[part(f, g).alias(f"{name}{k}") for k, g in ((1, "P"), (2, "M")) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )


def _student() -> tuple[Column, Column]:
    """t and its degrees of freedom over a row with n1, m1, v1, n2, m2, v2."""
    n1, n2, free = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2") - 2
    pooled = divide((n1 - 1) * F.coalesce("v1", F.when(n1 == 1, 0.0)) + (n2 - 1) * F.coalesce("v2", F.when(n2 == 1, 0.0)), free)
    t = divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (divide(F.lit(1), n1) + divide(F.lit(1), n2))))
    return t, free.cast("double")


def _welch() -> tuple[Column, Column]:
    s1, s2 = divide(F.col("v1"), F.col("n1")), divide(F.col("v2"), F.col("n2"))
    t = divide(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))
    return t, divide((s1 + s2) * (s1 + s2), divide(s1 * s1, F.col("n1") - 1) + divide(s2 * s2, F.col("n2") - 1))


def _t_test(df: DataFrame, value: str, form: tuple[Column, Column]) -> DataFrame:
    out = _two(df, value).select(*KEY, form[0].alias("statistic"), form[1].alias("df"))
    return out.withColumn("pvalue", tails.t_pvalue("statistic", "df"))


def student(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic, df, pvalue with one variance for both groups; P first."""
    return _t_test(df, value, _student())


def welch(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic, df, pvalue with a variance for each group; P first."""
    return _t_test(df, value, _welch())


def _by_trait(df: DataFrame, value: str, f: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """f of trait_id, origin and v, and whether all traits are small: small ones are dealt to tasks once, for all that f does."""
    rows = df.select(*KEY, "origin", F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return by_size(rows, KEY, selection.WHOLE, f)


def _deviations(rows: DataFrame, whole: bool) -> DataFrame:
    """trait_id, origin, z: distances of v from the median of trait and origin."""
    rows = with_values_at(rows, [*KEY, "origin"], "v", median_places(), whole)
    return rows.select(*KEY, "origin", F.abs(F.col("v") - median()).alias("z"))


def _levene(g: DataFrame) -> DataFrame:
    """trait_id, statistic, k, N from a row for each trait and group: n, m (mean distance) and ss (squares about it)."""
    n, m = F.col("n"), F.col("m")
    g = g.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("N"),
        F.sum("ss").alias("within"),
        F.sum(n * m).alias("s"),
        F.sum(n * m * m).alias("q"),
    )
    between = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("N"), F.lit(0.0))
    f = divide(divide(between, F.col("k") - 1), divide(F.col("within"), F.col("N") - F.col("k")))
    return g.select(*KEY, f.alias("statistic"), "k", "N")


def levene(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic, pvalue: equal variances, about medians. Equal if pvalue > 0.05."""
    sums = [F.count("z").alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("z")).alias("ss")]
    g = _by_trait(df, value, lambda some, whole: _levene(_deviations(some, whole).groupBy(*KEY, "origin").agg(*sums)))
    return g.select(*KEY, "statistic", tails.f_pvalue("statistic", F.col("k") - 1, F.col("N") - F.col("k")).alias("pvalue"))


def bartlett(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic, pvalue: equal variances of normal groups."""
    g = df.groupBy(*KEY, "origin").agg(F.count(value).alias("n"), F.var_samp(F.col(value).cast("double")).alias("v"))
    f, v = F.col("n") - 1, F.col("v")
    sums = [F.sum(f).alias("f"), F.sum(f * v).alias("fv"), F.sum(f * F.when(v > 0, F.log("v"))).alias("fl"), F.sum(divide(F.lit(1), f)).alias("r")]
    g = g.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), *sums, F.min(v).alias("least"), F.count("v").alias("c"))
    spread = 1 + (F.col("r") - divide(F.lit(1), F.col("f"))) / (3 * (F.greatest(F.col("k"), F.lit(2)) - 1))
    stat = (F.col("f") * F.log(divide(F.col("fv"), F.col("f"))) - F.col("fl")) / spread
    stat = F.when((F.col("k") > 1) & (F.col("c") == F.col("k")) & (F.col("least") > 0), stat).otherwise(F.lit(NAN))
    return g.select(*KEY, stat.alias("statistic"), tails.chi2_pvalue(stat, F.col("k") - 1).alias("pvalue"))


def fligner(df: DataFrame, value: str) -> DataFrame:
    """trait_id, statistic, pvalue: equal variances by normal scores of the ranks of distances from medians. P and M are compared; other rows are left out."""
    place = 0.5 + (F.col("before") + (F.col("cnt") + 1) / 2) / (2 * (F.col("n") + 1))
    a = F.col("a")
    sides = [F.sum(F.when(F.col(c) > 0, F.col(c) * y)).alias(f"{c}_{name}") for c in "pm" for name, y in (("c", F.lit(1)), ("s", a), ("q", a * a))]

    def summed(some: DataFrame, whole: bool) -> DataFrame:
        ranked = value_ranks(_deviations(some, whole), KEY, "z", *_sides(), whole=whole)
        return ranked.withColumn("a", inverse_normal(place)).groupBy(*KEY).agg(*sides)

    g = _by_trait(df.where(F.col("origin").isin("P", "M")), value, summed)
    none = lambda name: [F.coalesce(f"{c}_{name}", F.lit(0)) for c in "pm"]
    total, count = sum(none("s")), sum(none("c"))
    between = sum(F.coalesce(F.col(f"{c}_s") * F.col(f"{c}_s") / F.col(f"{c}_c"), F.lit(0.0)) for c in "pm")
    mean = total * total / count
    stat = divide(between - mean, divide(sum(none("q")) - mean, count - 1))
    k = F.col("p_c").isNotNull().cast("int") + F.col("m_c").isNotNull().cast("int")
    stat = F.when(k > 1, stat).otherwise(F.lit(NAN))
    return g.select(*KEY, stat.alias("statistic"), tails.chi2_pvalue(stat, k - 1).alias("pvalue"))


VARIANCE_TESTS = {"bartlett": bartlett, "fligner": fligner}


def difference_test(df: DataFrame, value: str, variances: str = "levene") -> DataFrame:
    """trait_id, statistic, pvalue, method: t or Welch for normal traits by equality of variances, else Mann-Whitney.

    Traits whose normality p-value is exactly 0.05, or null or NaN, are in neither part and left out. Normality is that
    of all of a trait's values; the other tests take P and M. Values are ranked once, and one aggregate over
    them gives normality, U, t and Levene's F. variances: levene, bartlett or fligner (these two are joined by trait).
    """
    if variances not in ("levene", *VARIANCE_TESTS):
        raise ValueError(f"variances must be levene, {' or '.join(VARIANCE_TESTS)}")
    values = value_ranks(df.select(*KEY, "origin", value), KEY, value, *_sides(), counts=("cnt", "p", "m"), medians=("p", "m"))
    x, d = F.col(value).cast("double"), F.col("d")
    sums = [F.sum(F.col(c) * y).alias(f"{c}_{name}") for c in "pm" for name, y in (("n", F.lit(1)), ("d", d), ("dd", d * d))]
    for c in "pm":
        z = F.when(F.col(c) > 0, F.abs(x - F.col(f"med_{c}")))
        sums += [F.coalesce(F.sum(F.col(c) * y), F.lit(0.0)).alias(f"{c}_{name}") for name, y in (("z", z), ("zz", z * z))]
    out = _scored(values, value).groupBy(*KEY).agg(*_normality(), *_rank_sums(value), *sums, F.max("least").cast("double").alias("least"))
    for k, c in ((1, "p"), (2, "m")):
        n, total, squares = (F.col(f"{c}_{x}") for x in ("n", "d", "dd"))
        mean = divide(total, F.when(n > 0, n))
        var = F.when(n > 1, F.greatest((squares - total * mean) / (n - 1), F.lit(0.0)))
        out = out.withColumns({f"n{k}": n, f"m{k}": mean + F.col("least"), f"v{k}": var})
    if variances == "levene":
        sides = [[F.col(f"{c}_{name}") for name in ("n", "z", "zz")] for c in "pm"]
        within = [F.when(n > 0, F.greatest(zz - z * z / n, F.lit(0.0))).otherwise(0.0) for n, z, zz in sides]
        squares = [F.when(n > 0, z * z / n).otherwise(0.0) for n, z, _ in sides]
        k, rows, total = (sides[0][0] > 0).cast("int") + (sides[1][0] > 0).cast("int"), sides[0][0] + sides[1][0], sides[0][1] + sides[1][1]
        out = out.withColumns({"k": k, "N": rows, "within": sum(within), "between": F.greatest(sum(squares) - total * total / F.when(rows > 0, rows), F.lit(0.0))})
        out = out.withColumn("f", divide(divide(F.col("between"), F.col("k") - 1), divide(F.col("within"), F.col("N") - F.col("k"))))
        out = out.withColumn("equal", tails.f_pvalue("f", F.col("k") - 1, F.col("N") - F.col("k")))
    else:
        equal = VARIANCE_TESTS[variances](df.where(F.col("origin").isin("P", "M")), value).select(*KEY, F.col("pvalue").alias("equal"))
        out = join_groups(out, equal, KEY, "left")
    out = out.withColumn("normal", _shapiro()["pvalue"]).where("normal <> 0.05")
    is_normal, same = F.col("normal") > 0.05, F.coalesce(F.col("equal") > 0.05, F.lit(False))
    pick = lambda k: F.when(same, _student()[k]).otherwise(_welch()[k])
    out = out.withColumns({
        "method": F.when(is_normal & same, "T-test").when(is_normal, "Welchs-test").otherwise("MannwhitneyU-test"),
        "t": pick(0),
        "df": pick(1),
        "u": _u(),
    })
    out = out.withColumns({"t_p": tails.t_pvalue("t", "df"), "u_p": tails.mann_whitney_pvalue("u", "n1", "n2", "ties")})
    chosen = lambda a, b: F.when(F.col("method") == "MannwhitneyU-test", F.col(b)).otherwise(F.col(a))
    return out.select(*KEY, chosen("t", "u").alias("statistic"), chosen("t_p", "u_p").alias("pvalue"), "method")


def significance(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds significant: true below the level, false above it, null at it exactly or for NaN."""
    p = F.col("pvalue")
    return tested.withColumn("significant", F.when(F.isnan(p), None).when(p < level, True).when(p > level, False))
