"""Files in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FALLBACK = "/tmp/checkpoints"  # only where the session names no folder and all of Spark is on this machine, as in tests
MADE: list[str] = []  # every folder that this process asked for


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below spark.checkpoint.dir. Its files are needed as long as the result is; see remove_all."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{FALLBACK}"
    MADE.append(f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove_all(spark: SparkSession, after: int = 0) -> None:
    """Deletes the folders of all results so far, but for the first `after`. Only for when none of them is needed any more."""
    while len(MADE) > after:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, at: str) -> DataFrame:
    """Writes df as Parquet and reads it back: the lineage ends there, and lost executors cost nothing before it."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def others(df: DataFrame, names: Iterable[str], *besides: str) -> list[str]:
    """df's columns without `besides` and without those that a result column of the same name (in any case) replaces."""
    new = {x.lower() for x in names}
    return [c for c in df.columns if c not in besides and c.lower() not in new]


def unused(df: DataFrame, name: str) -> str:
    """This name, or one made longer until no column of df has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def by_bucket(packed: DataFrame, bits: int):
    """packed (with 2 ** bits buckets in its column bucket) in groups of a bucket, dealt to tasks whose number grows with that of buckets."""
    parts = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << max(bits - 2, 0))
    return packed.repartition(parts, "bucket").groupBy("bucket")


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith(("file://", "/")) else None


class Writer:
    """A file that appears whole or not at all: a task that runs again replaces it by the same bytes."""

    def __init__(self, uri: str):
        self.system, self.path = None, _local(uri)
        if self.path is None:
            from pyarrow import fs

            self.system, self.path = fs.FileSystem.from_uri(uri)
        self.new = f"{self.path}.{uuid.uuid4().hex}"
        if self.system is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.file = open(self.new, "wb")  # noqa: SIM115
        else:
            self.system.create_dir(os.path.dirname(self.path), recursive=True)
            self.file = self.system.open_output_stream(self.new)

    def write(self, part: bytes | np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(part).reshape(-1).view(np.uint8).data if isinstance(part, np.ndarray) else part)

    def close(self) -> None:
        self.file.close()
        if self.system is None:
            os.replace(self.new, self.path)
        else:
            self.system.move(self.new, self.path)


def put(uri: str, parts: Iterable[bytes | np.ndarray]) -> None:
    """Writes a file at once."""
    file = Writer(uri)
    for part in parts:
        file.write(part)
    file.close()


def get(uri: str) -> np.ndarray:
    """A file's bytes, memory-mapped where the folder is mounted. FileNotFoundError if there is none."""
    if path := _local(uri):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Files:
    """Whole files of a folder, kept while there's room: mapped ones by number, others by their bytes."""

    def __init__(self, at: str, maps: int = 1000, room: int = 128 << 20):
        self.at, self.maps, self.room, self.held, self.bytes = at, maps, room, {}, 0

    def __getitem__(self, name: str | int) -> np.ndarray:
        if name not in self.held:
            if len(self.held) >= self.maps or self.bytes > self.room:
                self.held.clear()
                self.bytes = 0
            self.held[name] = x = get(f"{self.at}/{name}")
            self.bytes += 0 if isinstance(x, np.memmap) else x.nbytes
        return self.held[name]


class Ranges:
    """Byte ranges of a folder's files, read when they're asked for: only open files are kept."""

    def __init__(self, at: str, most: int = 200):
        self.at, self.most, self.open = at, most, {}

    def read(self, name: str, start: int, size: int) -> np.ndarray:
        if name not in self.open:
            if len(self.open) >= self.most:
                for f in self.open.values():
                    f.close()
                self.open.clear()
            uri = f"{self.at}/{name}"
            if path := _local(uri):
                self.open[name] = open(path, "rb")  # noqa: SIM115
            else:
                from pyarrow import fs

                system, path = fs.FileSystem.from_uri(uri)
                self.open[name] = system.open_input_file(path)
        file = self.open[name]
        file.seek(start)
        data = file.read(size)
        if len(data) != size:
            raise OSError(f"{self.at}/{name} is too short")
        return np.frombuffer(data, np.uint8)
