"""MinHash near-dedup: universal hash minima in bands, verification, and connected components.

A document's set is its distinct shingles of five words (A-Z lower-cased), or the
whole sequence if it has fewer. Rows with equal sets (128-bit digests of the whole set) are one class; only
classes are compared, and each has a number of its own. Minima of multiply-add hashes make keys of ROWS minima
each, so many (24 for a similarity of 0.85, 35 for 0.8) that two sets at the threshold share no key less
than once in a million pairs (7.7e-7 and 9.2e-7), and a pair of less is met only where it shares one.

All classes that share a key are a bucket. Each is first held against the least
one of its bucket; the least ones of large buckets are broadcast, so no bucket is one task. Buckets whose classes
have then not become one component are cut by size of set, as sets of unlike sizes can't be alike, and into
tiles of a bounded number of classes. In each tile every pair of different components is held against each other,
so no link of a bucket is lost however large it is. A pair whose minima agree too rarely (six standard deviations
below the threshold) is refused by its signature; all others are confirmed
on full sets. Sets of classes with a partner lie in files of the shared folder and
are read from there pair by pair; nothing of them reaches the driver.

Null and empty texts and texts of white space have no set: they're linked with
nothing and kept. Rows may repeat: equal rows share a class. A doc_id that stands for several texts
links them all. Rows with a null doc_id are in their class but never name it; if no row of their component has
one, component_id is null and kept is false.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .textbatch import hashes, mix, slices, words

SHINGLE, ROWS, BANDS = 5, 5, 24
HASHES = ROWS * BANDS  # of a stored signature; the bands of a threshold may take more
MISSED = 1e-6
TILE = 512  # classes of a tile's side
SLICE = 1 << 20  # bytes of text at a time
HOT_BUCKET, HOT_SHARE = 256, 4096  # a large bucket has so many classes, and one in so many: at most bands * HOT_SHARE such buckets
_draw = np.random.default_rng(5)
FACTORS = _draw.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, HASHES, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set as sorted 64-bit hashes, flat, and where each begins, with the end."""
    found = words(texts, lower=True)
    counts = np.diff(found.offsets)
    n = len(counts)
    h = hashes(found.distinct)[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= size:
        inside = doc[size - 1 :] == doc[: len(h) - size + 1]
        value = np.zeros(len(inside), np.uint64)
        for k in range(size):
            value = value * BASE + h[k : len(h) - size + 1 + k]
        value, owner = mix(value[inside]), doc[: len(inside)][inside]
    for k in range(1, size):  # shorter texts: the whole sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            one = np.full(len(short), k, np.uint64)
            for j in range(k):
                one = one * BASE + h[found.offsets[short] + j]
            value, owner = np.r_[value, mix(one)], np.r_[owner, short]
    if len(owner) and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[a:b].sort()
    fresh = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    return value[fresh], np.r_[0, np.cumsum(fresh)][bounds]


def bands_for(percent: int) -> int:
    """The least number of bands that miss a pair at this similarity at most once in a million."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


def _hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n factors and shifts, the first HASHES of them FACTORS and SHIFTS."""
    draw = np.random.default_rng(6)
    more = draw.integers(0, 2**63, (max(n - HASHES, 0), 2), np.uint64)
    return np.r_[FACTORS, more[:, 0] * np.uint64(2) + np.uint64(1)][:n], np.r_[SHIFTS, more[:, 1]][:n]


def minima(sets: np.ndarray, starts: np.ndarray, n: int = HASHES) -> np.ndarray:
    """n rows: the least hash of each set, none of them empty."""
    out = np.empty((n, len(starts)), np.uint64)
    work = np.empty_like(sets)
    for k, (factor, shift) in enumerate(zip(*_hashing(n), strict=True)):
        np.multiply(sets, factor, out=work)
        np.add(work, shift, out=work)
        out[k] = np.minimum.reduceat(work, starts)
    return out


def digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each whole set, as two numbers; of an empty one too."""
    data = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
    ends = (8 * bounds).tolist()
    raw = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True))
    two = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return two[:, 0], two[:, 1]


def sketches(batches: Iterator[pa.RecordBatch], key: str, text: str, bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    """Each row's other columns, the size and digest of its set, and its keys."""
    for batch in slices(batches, text, SLICE):
        sets, bounds = shingle_sets(batch[text])
        count = np.diff(bounds)
        full = count > 0
        low = minima(sets, bounds[:-1][full], ROWS * bands)
        keys = np.zeros((low.shape[1], bands), np.int64)
        for b in range(bands):
            one = np.full(low.shape[1], b + 1, np.uint64)
            for r in range(ROWS):
                one = one * BASE + mix(low[b * ROWS + r])
            keys[:, b] = mix(one).view(np.int64)
        ends = np.r_[0, np.cumsum(np.where(full, bands, 0))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1)))
        high, less = digests(sets, bounds)
        rest = [c for c in batch.schema.names if c not in (key, text)]
        columns = [batch[key].cast(pa.int64()), *(batch[c] for c in rest), pa.array(count, pa.int64()), pa.array(high), pa.array(less), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *rest, "n_shingles", "hi", "lo", "bands"])


def _store(at: str):
    """Writes each task's sets, with their minima, to one file as they come; rows tell the place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, place, file, seen = uuid.uuid4().hex, 0, None, set()
        for batch in slices(batches, "text", SLICE):
            sets, bounds = shingle_sets(batch["text"])
            count = np.diff(bounds)
            high, less = digests(sets, bounds)
            names = list(zip(high.tolist(), less.tolist(), strict=True))
            full = np.array([i for i, x in enumerate(names) if count[i] and x not in seen], np.int64)  # copies in one slice may both stay
            seen = seen.union(names) if len(seen) < 1 << 20 else set()
            low = (minima(sets, bounds[:-1][count > 0])[:, (np.cumsum(count > 0) - 1)[full]] >> np.uint64(48)).astype(np.uint16).T
            places = []
            for k, i in enumerate(full.tolist()):
                file = file or shared.Writer(f"{at}/{name}")
                file.write(low[k])
                file.write(sets[bounds[i] : bounds[i + 1]])
                places.append(place)
                place += 2 * HASHES + 8 * int(count[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(high[full]), pa.array(less[full]), pa.array([name] * len(full), pa.string()), pa.array(places, pa.int64())],
                names=["hi", "lo", "file", "place"],
            )
        if file:  # before the task is done: its rows count only then
            file.close()

    return run


class Sets:
    """The stored sets, by file and place."""

    def __init__(self, at: str):
        self.ranges = shared.Ranges(at)

    def low(self, file: str, place: int) -> np.ndarray:
        return self.ranges.read(file, place, 2 * HASHES).view(np.uint16)

    def of(self, file: str, place: int, n: int) -> np.ndarray:
        return self.ranges.read(file, place + 2 * HASHES, 8 * n).view(np.uint64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int) -> float:
    p = percent / 100
    return p - 6 * (p * (1 - p) / HASHES) ** 0.5


def _verify(at: str, percent: int):
    floor = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Sets(at)
        for batch in batches:
            d = batch.to_pydict()
            ok = []
            for f, p, n, f2, p2, n2 in zip(*(d[c] for c in ("file", "place", "n", "file2", "place2", "n2")), strict=True):
                ok.append(
                    100 * min(n, n2) >= percent * max(n, n2) and (store.low(f, p) == store.low(f2, p2)).mean() >= floor and alike(
                        store.of(f, p, n), store.of(f2, p2, n2), percent
                    )
                )
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(store: Sets, tile: pd.DataFrame, percent: int, floor: float) -> list[tuple[int, int]]:
    """Confirmed links that join a tile's components: no pair that can join two is left out."""
    tile = tile.sort_values(["cid", "part"])
    cid, n, part, comp, file, place = (tile[c].to_numpy() for c in ("cid", "n", "part", "comp", "file", "place"))
    same = tile["t0"].iloc[0] == tile["t1"].iloc[0]
    low = np.stack([store.low(f, p) for f, p in zip(file, place, strict=True)])
    group = comp.copy()
    links = []
    for i in range(len(cid) - 1):
        rest = slice(i + 1, None)
        fit = (group[rest] != group[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
        if not same:
            fit &= part[rest] != part[i]
        fit = i + 1 + np.flatnonzero(fit)
        for j in fit[(low[fit] == low[i]).mean(1) >= floor] if len(fit) else ():
            if group[i] != group[j] and alike(store.of(file[i], place[i], n[i]), store.of(file[j], place[j], n[j]), percent):
                links.append((cid[i], cid[j]))
                group[group == group[j]] = group[i]
    return links


def _tiles(at: str, percent: int):
    """Rows come sorted by tile; a tile is whole before it's read, and bounded by TILE classes a side."""
    floor = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = Sets(at), pd.DataFrame()

        def whole(rows: pd.DataFrame, cuts: np.ndarray) -> pa.RecordBatch:
            found = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in _links(store, rows.iloc[a:b], percent, floor)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            rows = pd.concat([held, batch.to_pandas()], ignore_index=True)
            key = rows[["band", "t0", "t1"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            yield whole(rows, cuts)
            held = rows.iloc[cuts[-1] :] if len(cuts) else rows
        if len(held):
            yield whole(held, np.array([0, len(held)]))

    return run


def _of_band(rows: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """rows with their band's row of the table (band, c, ...). Bands with more than `limit` rows are few, and broadcast."""
    hot = F.broadcast(table.where(F.col("c") > limit))
    cold = rows.join(hot.select("band"), "band", "left_anti").join(table.where(F.col("c") <= limit), "band")
    return rows.join(hot, "band").unionByName(cold)


def _tiled(members: DataFrame, comp: DataFrame, index: DataFrame, percent: int, limit: int, at: str) -> DataFrame:
    """The classes of buckets with more than one component, once for each tile they're in, the tile's rows together.

    A bucket's classes are split by the logarithm of their size, so that only neighbouring sizes can be alike, and then by number.
    """
    found = members.select("band", "cid").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    found = shared.saved(found, f"{at}/open")
    mixed = found.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high")
    rest = _of_band(found, mixed.select("band", "c"), limit).drop("c").join(index, "cid")
    # 1e-9: a pair exactly at the threshold is never two steps apart
    rest = shared.saved(
        rest.withColumn("step", F.floor(F.log("n") / (math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")).cast("int")),
        f"{at}/rest",
    )
    sizes = rest.groupBy("band", "step").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    order = Window.partitionBy("band").orderBy("step")
    beside = lambda f, d: F.when(f("step").over(order) == F.col("step") + d, f("parts").over(order)).otherwise(0)
    sizes = sizes.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1)).withColumn("c", F.col("parts") * TILE)
    rest = rest.join(
        sizes.withColumnsRenamed({"band": "_band", "step": "_step"}), F.expr("band = _band AND step = _step")
    ).drop("_band", "_step", "c")
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    name = lambda step, part: step.cast("long") * (1 << 32) + part
    rest = rest.withColumn("part", name(F.col("step"), own))
    upto = lambda step, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: name(step, k))).otherwise(
        F.expr("cast(array() as array<long>)")
    )
    others = F.concat(upto(F.col("step"), F.col("parts")), upto(F.col("step") + 1, F.col("up")), upto(F.col("step") - 1, F.col("down")))
    rest = rest.withColumn("other", F.explode(others)).withColumn("t0", F.least("part", "other")).withColumn("t1", F.greatest("part", "other"))
    rest = rest.select("band", "t0", "t1", "part", "cid", "comp", "n", "file", "place")
    return rest.repartition(4 * _parts(members.sparkSession), "band", "t0", "t1").sortWithinPartitions("band", "t0", "t1")


def groups_of(rows: DataFrame, percent: int, by_id: bool) -> DataFrame:
    """row, doc_id, n_shingles and comp (a number of the row's component, null without a set) of rows (row, doc_id, text).

    row is a number that equal rows at most share. by_id: whether the texts of one doc_id are linked.
    """
    spark = rows.sparkSession
    at = shared.folder(spark, "minhash")
    bands = bands_for(percent)
    drawn = rows.select("doc_id", "row", "text").mapInArrow(
        lambda it: sketches(it, "doc_id", "text", bands), "doc_id long, row long, n_shingles long, hi long, lo long, bands array<long>"
    )
    drawn = shared.saved(drawn, f"{at}/sketches")
    some = drawn.where("n_shingles > 0").groupBy("hi", "lo").agg(
        F.first("n_shingles").alias("n"), F.min("row").alias("row"), F.first("bands").alias("bands")
    )
    classes = shared.saved(some.withColumn("cid", F.monotonically_increasing_id()), f"{at}/classes")  # numbers are fixed once written
    owned = shared.saved(drawn.drop("bands").join(classes.select("hi", "lo", "cid"), ["hi", "lo"], "left"), f"{at}/owned")
    limit = max(HOT_BUCKET, classes.count() // HOT_SHARE)

    keyed = classes.select("cid", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(
        F.min("cid").alias("head"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("c")
    ).where("head < last").drop("last")
    members = shared.saved(_of_band(keyed, shared.saved(heads, f"{at}/heads"), limit).drop("c"), f"{at}/members")
    paired = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("row")
    stored = rows.join(paired, "row", "left_semi").select("text").mapInArrow(_store(f"{at}/sets"), "hi long, lo long, file string, place long")
    stored = shared.saved(stored, f"{at}/stored")
    index = classes.select("cid", "hi", "lo", "n").join(stored, ["hi", "lo"]).groupBy("cid", "n").agg(
        F.min(F.struct("file", "place")).alias("s")
    ).select("cid", "n", "s.*")
    index = shared.saved(index, f"{at}/index")

    edges = members.where("cid <> head").select(F.col("cid").alias("u"), F.col("head").alias("v")).distinct()
    two = index.select(F.col("cid").alias("v"), F.col("file").alias("file2"), F.col("place").alias("place2"), F.col("n").alias("n2"))
    placed = edges.join(index.withColumnRenamed("cid", "u"), "u").join(two, "v").repartition(_parts(spark))
    links = placed.mapInArrow(_verify(f"{at}/sets", percent), "u long, v long")
    if by_id:
        several = owned.where("doc_id IS NOT NULL AND cid IS NOT NULL").groupBy("doc_id").agg(
            F.min("cid").alias("v"), F.max("cid").alias("last")
        ).where("v < last")
        links = links.unionByName(owned.join(several.drop("last"), "doc_id").where("cid <> v").select(F.col("cid").alias("u"), "v").distinct())
    found = components(shared.saved(links, f"{at}/stars"))
    comp = found.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    more = _tiled(members, comp, index, percent, limit, at).mapInArrow(_tiles(f"{at}/sets", percent), "u long, v long")
    more = shared.saved(more, f"{at}/links")
    if more.limit(1).count():
        comp = components(found.unionByName(more)).select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    return owned.join(comp, "cid", "left").select("row", "doc_id", "n_shingles", F.coalesce("comp", "cid").alias("comp"))


def _written(rows: DataFrame, percent: int, by_id: bool, at: str) -> DataFrame:
    """groups_of, written; what it took to find them is deleted."""
    before = len(shared.MADE)
    groups = shared.saved(groups_of(rows, percent, by_id), at)
    shared.remove_all(rows.sparkSession, before)
    return groups


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    at = shared.folder(docs.sparkSession, "groups")
    groups = _written(rows, percent, True, f"{at}/rows")
    # written, so that a large component's rows can be split in the join
    least = shared.saved(groups.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id")), f"{at}/least")
    out = groups.join(least, "comp", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    )
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0).alias("kept"),
    )


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies, that of the least doc_id, whatever doc_ids they have. Rows without words all stay.

    Only texts decide: unlike texts of one doc_id are no copies, and rows without a doc_id may be.
    """
    at = shared.folder(docs.sparkSession, "rows")
    row = shared.unused(docs, "_row")
    docs = shared.saved(docs.withColumn(row, F.monotonically_increasing_id()), f"{at}/docs")  # numbers are fixed once written
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = _written(rows, percent, False, f"{at}/groups")
    first = groups.where("comp IS NOT NULL").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    ).select("least.row")
    stay = first.unionByName(groups.where("comp IS NULL").select("row"))
    return docs.join(stay.withColumnRenamed("row", row), row, "left_semi").drop(row)
