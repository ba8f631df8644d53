"""Ranks of values in groups of any size: never one task for a group.

Groups of few rows are dealt to tasks by key once, before anything is counted, in a number of partitions that grows with the input, so
that a task's memory doesn't. Equal values are one row with a count, so a value that a third of all rows share is
nothing special. Where a group may have more distinct values than a task should sort, it's cut into value ranges
at approximate quantiles, twice: bounds only decide where ranges end, so ranks are exact. Each range's
values are numbered on their own and moved by the counts of the ranges below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt, surely_at_most

PER_RANGE = 1 << 20  # distinct values that a task sorts, and rows of a group that isn't cut
CUTS = 256  # ranges that a larger group, or range of one, is cut into
SALTS = 64  # keys that a larger group is dealt to in a join


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on keys, null with null, and keeps the left's keys."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def by_size(df: DataFrame, keys: Sequence[str], most: int, f: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """f of the rows of groups of at most `most` rows, dealt by their keys, and of all others; its second argument tells which. f must keep groups apart.

    Large groups are fewer than one in `most` rows, and broadcast; where there's none, Spark leaves their part of the plan out. Inputs that surely have no more rows are planned without it.
    """
    if surely_at_most(df, most):
        return f(df, True)
    large = F.broadcast(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > most).drop("_d"))
    return f(dealt(join_groups(df, large, keys, "left_anti"), keys), True).unionByName(f(join_groups(df, large, keys), False))


def _names(count: str) -> tuple[str, str]:
    """The columns with the running sum and the total of a count."""
    return ("before", "n") if count == "cnt" else (f"before_{count}", f"n_{count}")


def _spread(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, how: str = "inner") -> DataFrame:
    """join_groups for large groups on the left: each is dealt by its values to SALTS keys, and the right side's row goes to all of them."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_groups(left.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")), salted, [*keys, "_salt"], how).drop("_salt")


def _cut(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds name: the range of each value among those of its group `by`; 0 in groups of at most PER_RANGE values."""
    x = F.col(value).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)  # not NaN either
    bounds = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"), F.percentile_approx(finite, [k / CUTS for k in range(1, CUTS)], 10_000).alias("_bounds"))
    placed = _spread(values, bounds.where(F.col("_d") > PER_RANGE).drop("_d"), by, value, "left")
    return placed.withColumn(name, F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b <= x)))).drop("_bounds")


def _numbered(values: DataFrame, keys: list[str], value: str, counts: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """value_ranks of groups that a task can sort."""
    whole = Window.partitionBy(*keys)
    for c in counts:
        before, n = _names(c)
        values = values.withColumn(before, _running(c, keys, value)).withColumn(n, F.sum(c).over(whole))
    for c in medians:
        low, high = (F.max(x).over(whole) for x in _middle(value, c))
        values = values.withColumn(f"med_{c}", (low + high) / 2)
    return values.withColumn("least", F.min(value).over(whole))


def _upto(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _running(c: str, by: Sequence[str], value: str) -> Column:
    return F.sum(c).over(_upto(by, [value])) - F.col(c)


def _numbered_in_ranges(values: DataFrame, keys: list[str], value: str, counts: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """value_ranks of larger groups, in ranges of values."""
    ranges = ["_range", "_part"]
    placed = _cut(_cut(values, keys, value, "_range"), [*keys, "_range"], value, "_part")
    below = placed.groupBy(*keys, *ranges).agg(F.min(value).alias("_least"), *[F.sum(c).alias(f"_c_{c}") for c in counts])
    below = below.withColumn("least", F.min("_least").over(Window.partitionBy(*keys))).drop("_least")
    for c in counts:
        own = F.col(f"_c_{c}")
        below = below.withColumn(f"_base_{c}", F.sum(own).over(_upto(keys, ranges)) - own).withColumn(
            _names(c)[1], F.sum(own).over(Window.partitionBy(*keys))
        )
    below = below.drop(*[f"_c_{c}" for c in counts])
    for c in counts:
        placed = placed.withColumn(f"_in_{c}", _running(c, [*keys, *ranges], value))
    out = join_groups(placed, below, [*keys, *ranges])
    for c in counts:
        out = out.withColumn(_names(c)[0], F.col(f"_base_{c}") + F.col(f"_in_{c}"))
    if medians:
        out = _spread(out, out.groupBy(*keys).agg(*[median_of(value, c).alias(f"med_{c}") for c in medians]), keys, value)
    return out.drop(*ranges, *[f"{k}_{c}" for c in counts for k in ("_base", "_in")])


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, *more: Column, counts: Sequence[str] = ("cnt",), medians: Sequence[str] = (), whole: bool = False
) -> DataFrame:
    """Each group's distinct values: keys, value, cnt, before (rows of smaller values), n (rows of the group), least (its least value), and more aggregates.

    Nulls are left out. counts: cnt and those of the other aggregates that are counts too, whose running sums and totals become before_{name} and n_{name}.
    medians: those of counts whose median (of the group's rows that they count) is added as med_{name}.
    Groups of more than PER_RANGE rows are cut into ranges. whole: all groups are known to be small.
    """
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    rows = df.where(F.col(value).isNotNull())

    def numbered(some: DataFrame, small: bool) -> DataFrame:
        values = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"), *more)
        return (_numbered if small else _numbered_in_ranges)(values, keys, value, counts, medians)

    return (numbered(rows, True) if whole else by_size(rows, keys, PER_RANGE, numbered)).drop("_all")


def _at(value: str, rank: Column, count: str) -> Column:
    before = F.col(_names(count)[0])
    return F.when((before <= rank) & (rank < before + F.col(count)), F.col(value))


def _middle(value: str, count: str) -> tuple[Column, Column]:
    """The value at the lower middle place, and at the upper; null elsewhere."""
    n = F.col(_names(count)[1])
    return _at(value, F.floor((n - 1) / 2), count).cast("double"), _at(value, F.ceil((n - 1) / 2), count).cast("double")


def at_rank(value: str, rank: Column, count: str = "cnt") -> Column:
    """An aggregate over value_ranks: the value that holds this place (from 0), among the rows of a count."""
    return F.max(_at(value, rank, count))


def median_of(value: str, count: str = "cnt") -> Column:
    """An aggregate over value_ranks: the mean of the middle values."""
    low, high = _middle(value, count)
    return (F.max(low) + F.max(high)) / 2
