"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A text's features are its runs of one to `longest` words (bytes a-z, 0-9 and those beyond ASCII, A-Z lower-cased),
each in the bucket of its crc32. Of a slice of a few megabytes of text, postings (bucket, document, count) are
sorted by bucket and packed, a row for each part of the buckets; a document is its place in its slice. The rows are written once and
shuffled by part and by a salt that grows in number with the slices, so that a bucket that every document holds is
many bounded groups. There they're co-grouped with both corpora's counts of the part's buckets, which were summed
before (one row for each bucket): each bucket's gain is computed from them in place, and each document's
contributions of the part leave as one number. These are summed slice by slice.

Documents are drawn by the largest scores, weight plus Gumbel noise that only the doc_id gives. Drawn ones are numbered by a
range-partitioned sort, in which rows of one key are told apart by their number, so no range is bound to be one task.

Null and empty texts have no features: weight 0, never drawn. A null doc_id has the noise of the empty text
and comes last among ties. Equal rows are rows of their own, and each may be drawn. Empty tables give empty
results; without a target text all gains come from the counts' smoothing. Other columns of the tables are left out by weighted() and drawn();
resampled() returns the drawn documents' own rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbatch import only, slices, unique, words

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
PARTS, SLICE = 32, 4 << 20  # parts of the buckets; bytes of text in a slice
GROUP = 64  # slices of a co-grouped part and salt
GAPS = only((48, 57), (97, 122))
HEAD, TOTAL = -1, -2  # in the place of a part: a slice's documents, a task's counts
POSTINGS = "slice long, part int, buckets binary, runs binary, docs binary, counts binary, ids array<long>, n array<long>"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold them, behind one byte that tells how many."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    size = next(k for k in (1, 2, 4, 8) if -(1 << 8 * k - 1) <= low and high < 1 << 8 * k - 1)
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64)


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and the bucket of each feature, and how many words each text has."""
    found = words(texts, True, GAPS)
    count = np.diff(found.offsets)
    doc = np.repeat(np.arange(len(count)), count)
    names = found.distinct.to_pylist()
    docs, out = [], []
    for run in range(1, longest + 1):
        n = max(len(found.codes) - run + 1, 0)
        inside = doc[run - 1 :][:n] == doc[:n]
        rows = np.stack([found.codes[k : n + k][inside] for k in range(run)], 1) if n else np.zeros((0, run), np.int64)
        each, place = np.unique(rows, axis=0, return_inverse=True) if run > 1 else (np.arange(len(names))[:, None], rows[:, 0])
        number = np.fromiter((zlib.crc32(b" ".join(names[k] for k in r)) % buckets for r in each.tolist()), np.int64, len(each))
        docs.append(doc[:n][inside]), out.append(number[place.reshape(-1)])
    return np.concatenate(docs), np.concatenate(out), count


def _row(slice_: int, part: int, *columns: np.ndarray, ids: list | None = None, n: list | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    values = [slice_, part, *[packed(c) for c in columns], *[None] * (4 - len(columns)), ids, n]
    names = [c.split()[0] for c in POSTINGS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _postings(longest: int, buckets: int, totals_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slice_ = np.zeros(buckets, np.int64), TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text", SLICE):
            doc, bucket, count = features(batch["text"], longest, buckets)
            total += np.bincount(bucket, minlength=buckets)
            if totals_only:
                continue
            per_doc = np.bincount(doc, minlength=len(count))
            yield _row(slice_, HEAD, count, ids=batch["doc_id"].to_pylist(), n=per_doc.tolist())
            key, times = unique(bucket * len(count) + doc)
            bucket, doc = key // max(len(count), 1), key % max(len(count), 1)
            ends = np.searchsorted(bucket * PARTS // buckets, np.arange(PARTS + 1))
            for p in range(PARTS):
                a, b = ends[p : p + 2]
                if a < b:
                    some, runs = unique(bucket[a:b])
                    yield _row(slice_, p, np.diff(some, prepend=0), runs, doc[a:b], times[a:b])
            slice_ += 1
        some = np.flatnonzero(total)
        if len(some):
            yield _row(slice_, TOTAL, some, total[some])

    return run


def _unpack_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, c in zip(batch["buckets"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(b)), pa.array(unpacked(c))], names=["bucket", "c"])


def _totals(postings: DataFrame, name: str) -> DataFrame:
    some = postings.where(F.col("part") == TOTAL).select("buckets", "runs").mapInArrow(_unpack_totals, "bucket long, c long")
    return some.groupBy("bucket").agg(F.sum("c").alias(name))


def gain(t: F.Column, s: F.Column, of_t: F.Column, of_s: F.Column, buckets: int) -> F.Column:
    up = (t + 1).cast("double") * (of_s + buckets).cast("double")
    return F.floor(1000 * F.log(up / ((s + 1).cast("double") * (of_t + buckets).cast("double"))))


def _contribute(postings: pa.Table, gains: pa.Table) -> pa.Table:
    """Each slice's documents with what the part's buckets add to their weights."""
    kinds = pa.schema([("slice", pa.int64()), ("docs", pa.binary()), ("weights", pa.binary())])
    names, values = gains["bucket"].to_numpy(), gains["gain"].to_numpy()
    order = np.argsort(names)
    names, values, out = names[order], values[order], []
    for r in postings.select(["slice", "buckets", "runs", "docs", "counts"]).to_batches():
        for slice_, b, runs, docs, counts in zip(*(r[c].to_pylist() for c in r.schema.names), strict=True):
            own = values[np.searchsorted(names, np.cumsum(unpacked(b)))]  # every bucket of a posting has a total
            doc, times = unpacked(docs), unpacked(counts)
            some, place = np.unique(doc, return_inverse=True)
            weight = np.zeros(len(some), np.int64)
            np.add.at(weight, place, times * np.repeat(own, unpacked(runs)))
            out.append((slice_, packed(some), packed(weight)))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)


def _reduce(parts: pa.Table, heads: pa.Table) -> pa.Table:
    """The documents of one slice."""
    ids, n, count = heads["ids"][0].values, heads["n"][0].values, unpacked(heads["buckets"][0].as_py())
    weight = np.zeros(len(ids), np.int64)
    for docs, more in zip(parts["docs"].to_pylist(), parts["weights"].to_pylist(), strict=True):
        weight[unpacked(docs)] += unpacked(more)
    row = (heads["slice"][0].as_py() << 20) + np.arange(len(ids))
    return pa.Table.from_arrays([pa.array(row), ids, n, pa.array(count), pa.array(weight)], names=["row", "doc_id", "n_features", "n_words", "weight"])


def weighted(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, n_features, n_words and weight of each document. docs: key and text; target: text."""
    at = shared.folder(docs.sparkSession, "importance")
    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    postings = shared.saved(some.mapInArrow(_postings(longest, buckets, False), POSTINGS), f"{at}/postings")
    other = target.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_postings(longest, buckets, True), POSTINGS)
    both = _totals(postings, "s").join(_totals(other, "t"), "bucket", "full").na.fill(0, ["s", "t"])
    both = shared.saved(both, f"{at}/totals")  # at most one row for each bucket
    of = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("of_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("of_t"))  # one row
    gains = both.crossJoin(F.broadcast(of)).select("bucket", gain(F.col("t"), F.col("s"), F.col("of_t"), F.col("of_s"), buckets).alias("gain"))

    heads = postings.where(F.col("part") == HEAD).select("slice", "ids", "n", "buckets")
    salts = -(-heads.count() // GROUP)
    listed = postings.where(F.col("part") >= 0).select("slice", "part", "buckets", "runs", "docs", "counts")
    listed = listed.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(max(salts, 1))))
    gains = gains.withColumn("part", F.floor(F.col("bucket") * PARTS / buckets).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(salts, 1) - 1))))
    gains = gains.withColumn("salt", F.col("salt").cast("long"))
    by = ["part", "salt"]
    parts = listed.groupBy(*by).cogroup(gains.groupBy(*by)).applyInArrow(_contribute, "slice long, docs binary, weights binary")
    fields = "row long, doc_id long, n_features long, n_words long, weight long"
    return parts.groupBy("slice").cogroup(heads.groupBy("slice")).applyInArrow(_reduce, fields)


def noise(key: F.Column, seed: int) -> F.Column:
    """Gumbel noise in thousandths, by a digest of the seed and the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, longest: int = 1, buckets: int = BUCKETS, key: str = "doc_id"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each document; percent of those with at least `least` words are drawn."""
    spark = docs.sparkSession
    at = shared.folder(spark, "drawn")
    scored = weighted(docs, target, longest, buckets, key).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = shared.saved(scored.withColumn("fit", F.col("n_words") >= least).drop("n_words"), f"{at}/scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = scored.where("fit").repartitionByRange(_ranges(spark), *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()  # the place in its range, under the range's number
    ranges = ranges.withColumn("_at", local).withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    ranges = shared.saved(ranges, f"{at}/ranges")
    sizes = dict(ranges.groupBy("_range").count().collect())  # one row for each range
    take, before, starts = sum(sizes.values()) * percent // 100, 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    ends = spark.createDataFrame(starts, "_range int, _before long")  # one row for each range
    place = F.col("_before") + F.col("_at") + 1
    ranked = ranges.join(F.broadcast(ends), "_range").withColumn("rank", F.when(place <= take, place))
    rest = scored.where("NOT fit").withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def _ranges(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of drawn documents, as they are; a doc_id's rows all stay if one of them is drawn."""
    some = drawn(docs.select("doc_id", "text"), target, **parameters).where("rank IS NOT NULL AND doc_id IS NOT NULL")
    return docs.join(some.select("doc_id").distinct(), "doc_id", "left_semi")
