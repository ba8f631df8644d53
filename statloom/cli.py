"""Command line: python -m statloom.cli TOOL [options]; each tool reads Parquet and writes Parquet or shows rows.

Database tools take a url without credentials; user and password come from STATLOOM_DB_USER and STATLOOM_DB_PASSWORD.
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import origin
from .operators import describe, difference, figure, rows, shape, variance
from .sources import database, sinks, tables

Options = argparse.Namespace
LISTED = 20  # groups named in a message; all are in the results


def _split(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _one(spark: SparkSession, o: Options) -> DataFrame:
    return tables.scan(spark, o.input[0])


def _named(df: DataFrame, column: str, what: str) -> None:
    """Prints how many rows there are, and the first of them."""
    some = [str(r[0]) for r in df.select(column).orderBy(column).limit(LISTED + 1).collect()]
    print(f"{what}: {df.count()}", ", ".join(some[:LISTED]) + (", ..." if len(some) > LISTED else ""))


def _box_cox(spark: SparkSession, o: Options) -> DataFrame:
    out, lam = shape.box_cox(_one(spark, o), o.value)
    print(f"lambda: {lam}")
    return out


def _reshape(spark: SparkSession, o: Options) -> DataFrame:
    df = _one(spark, o)
    if o.mode == "w2l":
        if o.group:
            print("the group column isn't used from wide to long")
        return rows.wide_to_long(df, _split(o.ids), _split(o.values), o.variable, o.value or "value")
    return rows.long_to_wide(df, _split(o.ids), _split(o.group), _split(o.values), o.order)


def _variance(spark: SparkSession, o: Options) -> DataFrame:
    df, chromosome, windows = _one(spark, o), int(o.chromosome) if o.chromosome else None, None
    if chromosome is not None:
        df = df.where(F.col("chra") == chromosome)
    if o.windows:
        windows = tables.read_windows(spark, o.windows)
        windows = windows if chromosome is None else windows.where(F.col("chra") == chromosome)
    reasons = variance.window_reasons(df, o.value, o.group or "origin", windows).where("reason IS NOT NULL")
    for reason, n in reasons.groupBy("reason").count().orderBy("reason").collect():  # at most a row for each reason
        print(f"windows without a result or with part of one, {reason}: {n}")
    df = df if windows is None else variance.windows_of(df, windows)
    return variance.variance_components(df, o.value, o.group or "origin")


def _kept(df: DataFrame, o: Options) -> DataFrame:
    group = o.group or "trait_id"
    kept, gone = describe.quality_control(df, group, o.value or "trait_value", int(o.size), float(o.ratio))
    _named(gone, group, "groups left out")
    return kept


def _database(spark: SparkSession, o: Options, partition_on: str | None) -> DataFrame:
    options = {name: os.environ[key] for name, key in (("user", "STATLOOM_DB_USER"), ("password", "STATLOOM_DB_PASSWORD")) if key in os.environ}
    if o.driver:
        options["driver"] = o.driver
    return database.read_database(spark, o.url, o.query, partition_on, int(o.partitions), int(o.fetch), **options)


def _difference(spark: SparkSession, o: Options) -> DataFrame:
    df = _one(spark, o)
    df = df if "origin" in df.columns else df.withColumn("origin", origin(F.col("f2")))
    out = difference.significance(difference.difference_test(df, o.value or "trait_value", o.variances)).persist()
    for what, test in (
        ("normal", "method <> 'MannwhitneyU-test'"),
        ("not normal", "method = 'MannwhitneyU-test'"),
        ("significant", "significant"),
        ("not significant", "NOT significant"),
    ):
        _named(out.where(test), "trait_id", f"traits {what}")
    return out


def _plot(spark: SparkSession, o: Options) -> DataFrame:
    """The picture, if --picture names a file, and the box statistics."""
    df = _one(spark, o)
    if o.picture:
        print(f"picture: {figure.draw(df, o.value, o.picture, o.title or '', float(o.width), float(o.height), o.format)}")
    return shape.box_statistics(df, o.value)


def _show(spark: SparkSession, o: Options) -> DataFrame:
    df = _one(spark, o)
    return df.agg(F.count(F.lit(1)).alias("rows")) if o.count else rows.preview(df, o.sort, o.descending, int(o.rows))


TOOLS: dict[str, Callable[[SparkSession, Options], DataFrame]] = {
    "box": lambda s, o: shape.box_statistics(_one(s, o), o.value),
    "boxcox": _box_cox,
    "concat": lambda s, o: tables.scan_many(s, o.input),
    "convert": _reshape,
    "curve": lambda s, o: shape.normal_curve(_one(s, o), o.value),
    "describe": lambda s, o: describe.describe(_one(s, o), o.value, _split(o.group) or ("windowa", "origin")),
    "difference": _difference,
    "export": lambda s, o: _database(s, o, o.partition_on),
    "extract": lambda s, o: rows.extract_trait(_one(s, o), int(o.trait)),
    "filter": lambda s, o: rows.mutation_flips(tables.scan(s, o.input[0]), tables.scan(s, o.input[1]), o.mode),
    "histogram": lambda s, o: shape.histogram(_one(s, o), o.value),
    "length": lambda s, o: rows.string_lengths(_one(s, o), o.value),
    "plot": _plot,
    "qq": lambda s, o: shape.qq_points(_one(s, o), o.value),
    "quality": lambda s, o: _kept(_one(s, o), o),
    "save": lambda s, o: _kept(_database(s, o, o.partition_on or o.group or "trait_id"), o),
    "show": _show,
    "variance": _variance,
}
DEFAULTS = {"variable": "variable", "sort": "", "rows": "0", "size": "400", "ratio": "5", "partitions": "16", "fetch": "50000", "width": "12", "height": "10", "format": "pdf", "variances": "levene"}
#: The name of a tool's result in a folder; query.parquet for the others.
RESULTS = {"boxcox": "tmp.parquet", "convert": "tmp.parquet", "describe": "tmp.parquet", "filter": "tmp.parquet", "extract": "subquery.parquet"}
NAMES = "output value group ids values variable order mode trait windows chromosome sort rows size ratio url query driver partition-on partitions fetch variances picture title width height format"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("tool", choices=sorted(TOOLS))
    parser.add_argument("input", nargs="*")
    for name in NAMES.split():
        parser.add_argument(f"--{name}", default=DEFAULTS.get(name))
    parser.add_argument("--descending", action="store_true")
    parser.add_argument("--count", action="store_true")
    o = parser.parse_args(argv)
    spark = SparkSession.builder.appName("statloom").getOrCreate()
    began = time.time()
    out = TOOLS[o.tool](spark, o)
    if o.output:
        print(f"written to {sinks.write(out, o.output, sort=_split(o.sort) if o.tool != "show" else (), name=RESULTS.get(o.tool, "query.parquet"))} in {time.time() - began:.2f} s")
        return 0
    print("\t".join(out.columns))
    for row in out.toLocalIterator():  # all rows, a partition at a time
        print("\t".join("null" if x is None else str(x) for x in row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
