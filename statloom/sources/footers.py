"""What Parquet footers tell, read by tasks: schemas, row counts, and the ranges of columns in row groups."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOOTER = "place long, path string, file string, rows long, bytes long, groups int, names array<string>, types array<string>"
RANGE = "file string, row_group int, rows long, least string, most string"
PER_TASK = 64  # paths


def _files(path: str) -> tuple[object, list[str]]:
    """The file system of a path, and its Parquet files: itself, or those below it that Spark reads; none where nothing is."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, path = fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        system = fs.LocalFileSystem()
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return system, [path]
    if info.type == fs.FileType.NotFound:
        return system, []
    inside = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
    return system, sorted(f.path for f in inside if f.type == fs.FileType.File and not hidden(f.path))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for place, path in zip(batch["place"].to_pylist(), batch["path"].to_pylist(), strict=True):
            system, files = _files(path)
            for file in files:
                meta = pq.read_metadata(file, filesystem=system)
                schema = meta.schema.to_arrow_schema()
                size = sum(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups))
                rows.append((place, path, file, meta.num_rows, size, meta.num_row_groups, schema.names, [str(f.type) for f in schema]))
            if not files:
                rows.append((place, path, None, None, None, None, None, None))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOOTER.split(", ")])


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    some = spark.createDataFrame(list(enumerate(paths)), "place long, path string")
    return some.repartition(max(1, -(-len(paths) // PER_TASK)))


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A row for each Parquet file of the paths (files, or folders that Spark wrote): place and path it was asked by, file, rows, bytes, row groups, names and types of columns. A path without files has one with nulls."""
    return _listed(spark, paths).mapInArrow(_footers, FOOTER)


def mismatches(known: DataFrame) -> DataFrame:
    """Of read()'s files, those whose columns (names and types, in order) aren't those of the first: file, expected, found."""
    text = F.transform(F.arrays_zip("names", "types"), lambda c: F.concat(c["names"], F.lit(" "), c["types"]))
    known = known.where("file IS NOT NULL").withColumn("found", F.array_join(text, ", "))
    first = known.agg(F.min_by("found", F.struct("place", "file")).alias("expected"))  # one row
    return known.join(F.broadcast(first)).where("found <> expected").select("file", "expected", "found")


def _ranges(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                system, files = _files(path)
                for file in files:
                    meta = pq.read_metadata(file, filesystem=system)
                    at = meta.schema.to_arrow_schema().names.index(column)
                    for k in range(meta.num_row_groups):
                        stats = meta.row_group(k).column(at).statistics
                        known = stats is not None and stats.has_min_max
                        ends = [json.dumps(x, default=str) for x in (stats.min, stats.max)] if known else [None, None]
                        rows.append((file, k, meta.row_group(k).num_rows, *ends))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RANGE.split(", ")])

    return run


def row_groups(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """A row for each row group: file, row_group, rows, least and most of a column (not nested) as JSON, null where the footer doesn't tell."""
    return _listed(spark, paths).select("path").mapInArrow(_ranges(column), RANGE)
