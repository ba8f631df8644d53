"""Filters, unions, reshaping, sorting and previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables
from ..sources.tables import same_schema


def extract_trait(df: DataFrame, trait: int) -> DataFrame:
    return df.where(F.col("trait_id") == trait)


def extract_window(df: DataFrame, chra: int, window: int) -> DataFrame:
    return df.where((F.col("chra") == chra) & (F.col("windowa") == window))


def union_strict(*frames: DataFrame) -> DataFrame:
    """UNION ALL of frames with equal schemas; others raise ValueError instead of being widened."""
    same_schema(frames)
    return reduce(DataFrame.unionByName, frames)


def mutation_flips(paternal: DataFrame, maternal: DataFrame, mutation_class: str) -> DataFrame:
    """Rows whose mutant differs from the allele by one (pos_flip: above, nega_flip: below) with a positive effect, of both origins in one form. Alleles and chra beyond a byte raise."""
    steps = {"pos_flip": -1, "nega_flip": 1}
    if mutation_class not in steps:
        raise ValueError(f"mutation_class must be one of {sorted(steps)}")

    def side(df: DataFrame, name: str, allele: str, mutant: str, effect: str) -> DataFrame:
        # signed: unsigned columns would wrap
        kept = df.where((F.col(effect) > 0) & (F.col(allele).cast("bigint") - F.col(mutant).cast("bigint") == steps[mutation_class]))
        return kept.select(
            F.col("chra").cast("tinyint").alias("chra"),
            "windowa",
            "trait_id",
            F.lit(name).alias("origin"),
            F.col(allele).cast("tinyint").alias("allele"),
            F.col(mutant).cast("tinyint").alias("mutant"),
            F.col(effect).cast("double").alias("effect_value"),
        )

    return union_strict(
        side(paternal, "P", "allelea", "allelea_mutant_paternal", "trait_male_diff_paternal"),
        side(maternal, "M", "peerallelea", "peerallelea_mutant_maternal", "trait_male_diff_maternal"),
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Other columns go. Values become strings if any value column is one. No order is promised."""
    if any(isinstance(df.schema[c].dataType, T.StringType) for c in values):
        df = df.withColumns({c: F.col(c).cast("string") for c in values})
    return df.unpivot(list(ids), list(values), variable, value)


def in_order(df: DataFrame, name: str) -> DataFrame:
    """Adds a column that orders rows as their files do: by file and row number, whatever the splits that are read; by the order of reading where there are no files."""
    try:
        return tables.in_order(df, name)
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


def long_to_wide(
    df: DataFrame,
    ids: Sequence[str],
    groups: Sequence[str],
    values: Sequence[str],
    order: str | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One column for each group (for several value columns value_group), holding the first value by `order`, null or not.

    Without order, the order of files (by name) and of their rows counts, where df comes from files; else that of reading. For several files in an order of
    your own, see scan_many. names gives the groups' values and their column order; without it they're asked for first.
    """
    if not groups:
        raise ValueError("long to wide needs a group column")
    group = groups[0] if len(groups) == 1 else "_group"
    if len(groups) > 1:
        df = df.withColumn(group, F.concat_ws("_", *groups))
    if order is None:
        df, order = in_order(df, "_order"), "_order"
    firsts = [F.min_by(v, order).alias(v) for v in values]  # null too; numbers by a long are hashed, not sorted
    wide = df.groupBy(*ids).pivot(group, list(names) if names else None).agg(*firsts)
    if len(values) == 1:
        return wide
    out = []
    for c in wide.columns:
        v = next((v for v in values if c not in ids and c.endswith(f"_{v}")), None)
        out.append(F.col(f"`{c}`").alias(f"{v}_{c[: -len(v) - 1]}") if v else F.col(f"`{c}`"))
    return wide.select(out)


def preview(df: DataFrame, sort: str = "", descending: bool = False, n: int | None = None) -> DataFrame:
    """Sorted by a comma list of columns, nulls first either way, and the first n rows (0 or None: all)."""
    keys = [c.strip() for c in sort.split(",") if c.strip()]
    if unknown := [c for c in keys if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}; there are {df.columns}")
    order = []
    for c in keys:
        col = F.col(c).cast("string") if isinstance(df.schema[c].dataType, T.MapType) else F.col(c)
        order.append(col.desc_nulls_first() if descending else col.asc_nulls_first())
    out = df.orderBy(*order) if order else df
    return out.limit(n) if n else out


def string_lengths(df: DataFrame, column: str, name: str = "length") -> DataFrame:
    """Code points."""
    return df.withColumn(name, F.length(column))


def lines(df: DataFrame) -> DataFrame:
    """Each row as one line of text, its values apart by tabs; null is the word null."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]).alias("line"))
