"""Values at chosen places of each group's order, by bracketing: exact medians and quantiles without sorting a large group.

One pass counts each group's rows. Groups of at most WHOLE rows are sorted, each in one task, of which there are more when the input grows. Of the larger ones, which
are fewer than one in WHOLE rows and broadcast for that reason, no row is shuffled: a pass cuts the bracket
around each wanted place into CUTS parts, counts their rows (with the least and the largest value of each, on the map side first) and goes on in the part that holds
the place. Parts are equal in logarithms where the bracket spans several magnitudes, else in values; both only decide
where parts end, as they grow with the value, so places are exact. After PASSES passes the distinct values that are left in a
bracket are counted, and the one that holds the place is the answer. All groups and places go through a pass together. Where
no group is large, Spark finds the broadcast table empty and runs none of the passes; inputs that surely have at most WHOLE rows are planned without them.

Values are taken as doubles; nulls are left out. NaN comes last, behind infinity, and each of them is a bracket of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import surely_at_most
from .ranks import by_size, join_groups

WHOLE = 1 << 20  # rows of a group that a task sorts
CUTS, PASSES = 4096, 3
Places = Mapping[str, Callable[[Column], Column]]


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.ceil((n - 1) / 2)


def nearest(q: float) -> Callable[[Column], Column]:
    """The place (from 0) nearest to the q-quantile's; halves go up."""
    return lambda n: F.floor((n - 1) * q + 0.5)


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Joins on keys, null with null; the right side, which is small, is broadcast. Keeps the left's keys."""
    renamed = F.broadcast(right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]))
    on = F.lit(True) if also is None else also
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _rows(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, list[str]]:
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    return df.withColumn("_v", F.col(value).cast("double")).where("_v IS NOT NULL"), list(keys)


def _large(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than WHOLE rows: how many, how many infinities and NaN, and the range of the others."""
    v, infinite = F.col("_v"), float("inf")
    finite = F.when(F.abs(v) < infinite, v)
    counts = [F.count_if(v == x).alias(name) for name, x in (("_below", -infinite), ("_above", infinite), ("_nan", float("nan")))]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts, F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    return sizes.where(F.col("n") > WHOLE)


def _brackets(large: DataFrame, keys: list[str], places: Places) -> DataFrame:
    """A row for each group and place: n, _place (its name), _rank in the bracket from _lo to _hi."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in places.items()]))
    out = large.withColumn("_p", named).withColumn("_place", F.col("_p.name")).withColumn("_rank", F.col("_p.rank"))
    n, rank, special = F.col("n"), F.col("_rank"), F.lit(None).cast("double")
    special = F.when(rank < F.col("_below"), F.lit(float("-inf"))).when(rank >= n - F.col("_nan"), F.lit(float("nan"))).when(
        rank >= n - F.col("_nan") - F.col("_above"), F.lit(float("inf"))
    ).otherwise(special)
    rank = F.when(special.isNotNull(), F.lit(0)).otherwise(rank - F.col("_below"))  # equal values: any of them
    return out.select(*keys, "n", "_place", rank.alias("_rank"), F.coalesce(special, "_lo").alias("_lo"), F.coalesce(special, "_hi").alias("_hi"))


def _part(v: Column, low: Column, high: Column) -> Column:
    """The part of a value's bracket, from 0 to CUTS - 1; it never falls when the value grows."""
    scale = lambda x: F.signum(x) * (F.log(F.greatest(F.abs(x), F.lit(2.0**-1022))) + 709)
    wide = (F.signum(low) != F.signum(high)) | (F.greatest(F.abs(low), F.abs(high)) > 16 * F.least(F.abs(low), F.abs(high)))
    # halves: the distance of two finite values may not be finite
    along = F.when(wide, (scale(v) - scale(low)) / (scale(high) - scale(low))).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    return F.when(low < high, F.least(F.floor(F.nanvl(along, F.lit(0.0)) * CUTS), F.lit(CUTS - 1))).otherwise(0)


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("_v")
    return _match(rows.select(*keys, "_v"), state, keys, also=(v >= F.col("_lo")) & (v <= F.col("_hi")))


def _held(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each group's and place's counted parts, the one that holds the place, with _before: the rows of the parts before."""
    upto = Window.partitionBy(*keys, "_place").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    return bars.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))


def _found(rows: DataFrame, large: DataFrame, keys: list[str], places: Places) -> DataFrame:
    """Of each large group and place (_place, its name), n and the value _v."""
    state, by = _brackets(large, keys, places), [*keys, "n", "_place", "_rank"]
    for _ in range(PASSES):
        cut = _inside(rows, state, keys).withColumn("_part", _part(F.col("_v"), F.col("_lo"), F.col("_hi")))
        bars = cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        state = _held(bars, keys, "_part").select(*keys, "n", "_place", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi")
    left = _inside(rows, state, keys).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _held(left, keys, "_v").select(*keys, "n", "_place", "_v")


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], places: Places) -> DataFrame:
    """Of each large group, n and the value at each place."""
    found = _found(rows, large, keys, places)
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_place") == p, F.col("_v"))).alias(p) for p in places])


def _sorted(rows: DataFrame, keys: list[str], places: Places) -> tuple[DataFrame, dict[str, Column]]:
    """Rows of small groups with n and their place _i, and for each name a column that is the value at that place, else null."""
    group = Window.partitionBy(*keys)
    placed = rows.withColumn("n", F.count("_v").over(group)).withColumn("_i", F.row_number().over(group.orderBy(F.col("_v").asc_nulls_last())) - 1)
    return placed, {name: F.when(F.col("_i") == f(F.col("n")), F.col("_v")) for name, f in places.items()}


def values_at(df: DataFrame, keys: Sequence[str], value: str, places: Places, more: Sequence[Column] = ()) -> DataFrame:
    """keys, n (rows that aren't null) and a column for each of places: the value at that place (a function of n, from 0) of the group's sorted values.

    more: aggregates over all rows of a group, nulls too; with any, groups without values have a row, in which n is 0.
    """
    rows, by = _rows(df, keys, value)
    if surely_at_most(df, WHOLE):
        if more:
            rows = df.withColumn("_all", F.lit(1)).withColumn("_v", F.col(value).cast("double"))
        small, at = _sorted(rows, by, places)
        return small.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(c).alias(name) for name, c in at.items()], *more).drop("_all")
    if more:
        known = values_at(df, keys, value, places)
        every = (df if keys else df.withColumn("_all", F.lit(1))).groupBy(*by).agg(*more)
        known = known if keys else known.withColumn("_all", F.lit(1))
        return join_groups(every, known, by, "left").fillna(0, ["n"]).drop("_all")

    def found(some: DataFrame, small: bool) -> DataFrame:
        if not small:
            return _selected(some, _large(some, by), by, places)
        placed, at = _sorted(some, by, places)
        return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(c).alias(name) for name, c in at.items()])

    return by_size(rows.select(*by, "_v"), by, WHOLE, found).drop("_all")


def with_values_at(df: DataFrame, keys: Sequence[str], value: str, places: Places, whole: bool = False) -> DataFrame:
    """The rows whose value isn't null, with the columns of values_at of their group. Rows of large groups stay where they are. whole: all groups are known to be small."""
    rows, by = _rows(df, keys, value)

    def found(some: DataFrame, small: bool) -> DataFrame:
        if not small:
            return _match(some, _selected(some, _large(some, by), by, places), by)
        placed, at = _sorted(some, by, places)
        return placed.withColumns({name: F.max(c).over(Window.partitionBy(*by)) for name, c in at.items()}).drop("_i")

    return (found(rows, True) if whole else by_size(rows, by, WHOLE, found)).drop("_all", "_v")


def values_along(df: DataFrame, value: str, points: int) -> DataFrame:
    """place (from 0), n and v: of the sorted values that aren't null, those at `points` equal steps from the least to the largest; all, if there are no more."""
    rows, by = _rows(df, [], value)
    rows = rows.select(*by, "_v")
    at = lambda k, n: F.floor(k * (n - 1) / (points - 1) + 0.5)

    def whole(some: DataFrame) -> DataFrame:
        placed, n, i = _sorted(some, by, {})[0], F.col("n"), F.col("_i")
        k = F.floor(i * (points - 1) / F.greatest(n - 1, F.lit(1)) + 0.5)  # the only step that may be here
        return placed.where((n <= points) | (i == at(k, n))).select(i.cast("long").alias("place"), "n", F.col("_v").alias("v"))

    if surely_at_most(df, WHOLE):
        return whole(rows)
    large, places = _large(rows, by), {str(k): lambda n, k=k: at(F.lit(k), n) for k in range(points)}
    found = _found(rows, large, by, places).select(at(F.col("_place").cast("int"), F.col("n")).cast("long").alias("place"), "n", F.col("_v").alias("v"))
    return whole(_match(rows, large.select(*by), by, "left_anti")).unionByName(found)


def median_places() -> Places:
    return {"_low": lower_middle, "_high": upper_middle}


def median() -> Column:
    """The mean of the middle values, over the columns of median_places."""
    return (F.col("_low") + F.col("_high")) / 2
