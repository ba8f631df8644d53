"""Parquet and text sources."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import footers


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column; the scan reads no other."""
    return spark.read.parquet(path).select(column)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def same_schema(frames: Sequence[DataFrame]) -> None:
    """Raises ValueError unless all have equal names and types, in order."""
    kinds = [[(f.name, f.dataType) for f in df.schema] for df in frames]
    for k in kinds[1:]:
        if k != kinds[0]:
            raise ValueError(f"schemas differ: {kinds[0]} and {k}")


FILE, ROWS = "_order_file", 40  # a column's name; bits of the row's number, which leave 2^23 files


def in_order(df: DataFrame, name: str, *first: Column) -> DataFrame:
    """Adds a long that orders rows by `first` (functions of FILE, a file's path), file and row number, whatever the splits that are read; df must come from files.

    Files are numbered, one row for each, and broadcast, so that no row carries a path: what orders and aggregates rows holds 8 bytes for each.
    """
    rows = df.withColumn(FILE, F.col("_metadata.file_path")).withColumn(name, F.col("_metadata.row_index"))
    numbers = rows.select(FILE).distinct().withColumn("_order_number", F.row_number().over(Window.orderBy(*first, FILE)).cast("long"))
    number = F.coalesce("_order_number", F.raise_error(F.lit("a row's file wasn't there when files were numbered")).cast("long"))
    return rows.join(F.broadcast(numbers), FILE, "left").withColumn(name, F.shiftleft(number, ROWS) + F.col(name)).drop(FILE, "_order_number")


def scan_many(spark: SparkSession, paths: Sequence[str], order: str | None = None) -> DataFrame:
    """The files that exist, as one table; a warning for each that doesn't, ValueError if none does or schemas differ.

    order: the name of a column to add (a long) that orders rows by the place of their path in the list, file and row number, whatever the splits that are read.

    Tasks read the footers, whatever the number of files; the message names some of the files that differ from the first.
    """
    known = footers.read(spark, paths).persist()  # a row for each file
    try:
        there = {r["path"] for r in known.where("file IS NOT NULL").select("path").distinct().collect()}
        for p in paths:
            if p not in there:
                warnings.warn(f"skipped: {p} doesn't exist", stacklevel=2)
        if not there:
            raise ValueError("none of the files exists")
        if wrong := footers.mismatches(known).limit(5).collect():
            raise ValueError("schemas differ: " + "; ".join(f"{r['file']} has {r['found']} in the place of {r['expected']}" for r in wrong))
    finally:
        known.unpersist()
    paths = [p for p in dict.fromkeys(paths) if p in there]
    df = spark.read.parquet(*paths)
    if order is None:
        return df
    plain = lambda p: re.sub("^file:/+", "/", spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString())
    places = F.from_json(F.lit(json.dumps({plain(p).rstrip("/"): k for k, p in enumerate(paths)})), "map<string,int>")
    file, top = F.regexp_replace(FILE, "^file:/+", "/"), lambda f: F.regexp_replace(f, "/[^/]*$", "")
    return in_order(df, order, F.coalesce(F.try_element_at(places, file), F.try_element_at(places, top(file)), F.lit(len(paths))))


def parse_windows(lines: DataFrame) -> DataFrame:
    """chra, windows of lines (value, and at, their order): two whole numbers each; other lines are left out and the last of a chromosome's counts."""
    words = F.split(F.trim("value"), r"\s+")
    known = lines.where((F.size(words) == 2) & F.col("value").rlike(r"^\s*[+-]?\d+\s+[+-]?\d+\s*$"))
    return known.select(words[0].cast("int").alias("chra"), words[1].cast("int").alias("windows"), "at").groupBy("chra").agg(
        F.max_by("windows", "at").alias("windows")
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """chra, windows of a text file."""
    return parse_windows(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()))


#: Steps of a plan that give at most as many rows as they get.
NO_MORE = {"Project", "Filter", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate", "GlobalLimit", "LocalLimit", "Repartition", "RepartitionByExpression", "Sample"}
FOOTERS_OF = 4 << 30  # bytes of files whose footers are counted


def surely_at_most(df: DataFrame, most: int) -> bool:
    """Whether df is known to have at most so many rows, without evaluating it: from limits, and from the footers of Parquet files below steps that add no rows.

    False where that can't be told, and where the files are large. A frame made of an RDD is counted as far as needed.
    """
    spark = df.sparkSession

    def bound(plan) -> float:
        kind = plan.getClass().getSimpleName()
        if (known := plan.maxRows()).isDefined():
            return int(str(known.get()))
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        if kind in NO_MORE or (kind == "Join" and str(plan.joinType()) in ("LeftSemi", "LeftAnti")):
            return bound(children[0])
        if kind == "Union":
            return sum(map(bound, children))
        if kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
            relation = plan.relation()
            if "Parquet" in relation.fileFormat().getClass().getSimpleName() and relation.location().sizeInBytes() <= FOOTERS_OF:
                return spark.read.parquet(*relation.location().inputFiles()).count()
        if kind == "LogicalRDD":
            return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark).limit(most + 1).count()
        return float("inf")

    return bound(df._jdf.queryExecution().optimizedPlan()) <= most


TASK_BYTES = 8 << 20  # bytes of files whose rows a task sorts


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df in partitions by its keys, whose number grows with the bytes that its plan reads, so that a task's share stays as it is when df grows; left to Spark where these aren't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 60:  # frames made of RDDs, databases
        return df.repartition(*keys)
    return df.repartition(min(max(-(-size // TASK_BYTES), df.sparkSession.sparkContext.defaultParallelism), 1 << 16), *keys)
