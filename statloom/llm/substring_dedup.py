"""Substring dedup by prefix-partitioned suffix trees over words, cut at the depth that matters.

A suffix is the words from a position on. Two positions start the same window of
WINDOW words exactly if their suffixes share an internal node of the suffix tree
at that depth, so trees need no more of a suffix than WINDOW words. The words from a tree's root to the
depths LEVELS and WINDOW are kept as fingerprints (64 bits, at WINDOW 128), and branches at other depths
are drawn together into the next of these. Texts are never moved; each pass reads them again.

1. Census. Suffixes alone in the top bits of their WINDOW-word fingerprint are
   leaves above that depth and go. Fingerprints are packed and merged by bucket.
2. Prefixes. The suffixes left are counted by their first LEVELS[0] words, all of them. A prefix with more
   than GROUP suffixes is made longer (LEVELS[1], then WINDOW words). So each prefix
   group fits in memory. Whole groups are put together in buckets, each the work of one task.
   A passage that starts at any number of places is one leaf with a mark for each slice of the input.
3. Subtrees. A bucket's suffixes are sorted by their words' fingerprints, depth by depth; neighbours' longest common
   prefixes (the LCP array) give each group's subtree. Its internal nodes at depth WINDOW are written, sorted.
4. Every position under such a node starts a repeated window. A run of such positions is extended left and right as far as its
   windows repeat: it is one maximal repeat, or several that overlap. Its words go.

Windows count as equal if both 64-bit fingerprints of their words are: with 10^13 windows two unlike ones pass for equal
with a probability of 10^-13. Null and empty texts have no words. Texts shorter than a window lose nothing. Rows
may repeat; equal rows are copies of each other. The results replace columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textbatch import Words, hashes, mix, slices, spans, words

WINDOW, LEVELS = 35, (8, 16)
GROUP = 1 << 20  # suffixes of a memory-sized group
BUCKET = 16 << 20  # bytes of text for each bucket, in whatever number of buckets
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
KEYS = ("0123456789123456", "substring-second")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[base] = out[0], out[1]
    return _powers[base][0][:n], _powers[base][1][:n]


class Suffixes:
    """Positions of a slice that start a whole window, and fingerprints of any number of words from them."""

    def __init__(self, texts: pa.Array, window: int = WINDOW):
        self.words: Words = words(texts)
        n, ends = len(self.words.codes), self.words.offsets
        room = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
        self.at = np.flatnonzero(room >= window)
        self.sums: dict[int, np.ndarray] = {}

    def prints(self, depth: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        at = self.at if at is None else at
        n = len(self.words.codes)
        if not len(at):
            return np.zeros(0, np.uint64)
        power, inverse = _power(BASES[which], n)
        if which not in self.sums:
            self.sums[which] = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(hashes(self.words.distinct, KEYS[which]))[self.words.codes] * power, out=self.sums[which][1:])
        total = self.sums[which]
        return mix((total[at + depth] - total[at]) * inverse[at] + np.uint64(depth))


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, in order, with the bytes of its columns, one after another. bucket is sorted."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(bucket)] if len(bucket) else starts
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "data"])


def _census(bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            one = np.sort(Suffixes(batch["text"], window).prints(window))
            one >>= np.uint64(32 - bits)
            if len(one) > 2:  # two of a kind are as good as more
                one = one[np.r_[True, True, one[2:] != one[:-2]]]
            yield _packed((one >> np.uint64(32)).astype(np.int32), [one.astype(np.uint32)])

    return run


def _repeated(at: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value = np.sort(np.frombuffer(b"".join(rows["data"]), np.uint32))
        again = value[1:][value[1:] == value[:-1]]
        again = again[np.r_[True, again[1:] != again[:-1]]] if len(again) else again
        shared.put(f"{at}/{int(rows['bucket'].iloc[0])}", [again])
        return pd.DataFrame({"n": [len(again)]})

    return run


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place in sorted_ of each of values, -1 where it isn't there."""
    if not len(sorted_):
        return np.full(len(values), -1)
    place = np.searchsorted(sorted_, values)
    place[place == len(sorted_)] = 0
    return np.where(sorted_[place] == values, place, -1)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket with its first and last place; bucket is sorted."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)] if len(bucket) else [], strict=True):
        yield int(bucket[a]), a, b


def _left(census: shared.Files, bits: int, suffixes: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions that the census leaves, and their fingerprints."""
    one = suffixes.prints(window)
    order = np.argsort(one)
    short = one[order] >> np.uint64(32 - bits)
    value = short.astype(np.uint32)
    keep = np.zeros(len(one), bool)
    for bucket, a, b in _runs((short >> np.uint64(32)).astype(np.int64)):
        keep[order[a:b]] = _member(census[bucket].view(np.uint32), value[a:b]) >= 0
    return suffixes.at[keep], one[keep]


def _prefixes(suffixes: Suffixes, where: np.ndarray, one: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The fingerprint of each suffix's group: of the shortest prefix that isn't too common."""
    group = suffixes.prints(LEVELS[0], at=where)
    for depth in (*LEVELS[1:], None):
        more = _member(heavy, group) >= 0
        if not more.any():
            break
        group[more] = one[more] if depth is None else suffixes.prints(depth, at=where[more])
    return group


def _counted(at: str, bits: int, window: int, depth: int, heavy_bytes: bytes | None):
    """How many suffixes each prefix of this depth has, all of them or those below the heavy shorter prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census = shared.Files(at)
        for batch in slices(batches, "text"):
            suffixes = Suffixes(batch["text"], window)
            where, one = _left(census, bits, suffixes, window)
            where = where[np.unique(one, return_index=True)[1]]
            if heavy_bytes is not None:
                where = where[_member(np.frombuffer(heavy_bytes, np.uint64), suffixes.prints(LEVELS[LEVELS.index(depth) - 1], at=where)) >= 0]
            value, count = np.unique(suffixes.prints(depth, at=where), return_counts=True)
            yield _packed((value >> np.uint64(64 - bits)).astype(np.int32), [np.stack([value, count.astype(np.uint64)], 1)])

    return run


def _heavy(rows: pd.DataFrame) -> pd.DataFrame:
    """The prefixes in this bucket that have more than GROUP suffixes."""
    table = np.frombuffer(b"".join(rows["data"]), np.uint64).reshape(-1, 2)
    value, place = np.unique(table[:, 0], return_inverse=True)
    count = np.zeros(len(value), np.int64)
    np.add.at(count, place, table[:, 1].astype(np.int64))
    return pd.DataFrame({"prefix": value[count > GROUP].view(np.int64)})


def _leaves(at: str, bits: int, window: int, heavy_bytes: bytes):
    """Suffixes by buckets of their groups: fingerprints at LEVELS, the two at WINDOW, and whether it's there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census, heavy = shared.Files(at), np.frombuffer(heavy_bytes, np.uint64)
        for batch in slices(batches, "text"):
            suffixes = Suffixes(batch["text"], window)
            where, one = _left(census, bits, suffixes, window)
            two = suffixes.prints(window, 1, where)
            order = np.lexsort((two, one))
            where, one, two = where[order], one[order], two[order]
            first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(one)]) > 1
            where, one, two = where[first], one[first], two[first]
            bucket = (_prefixes(suffixes, where, one, heavy) >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            above = [suffixes.prints(depth, at=where) for depth in LEVELS]
            yield _packed(bucket[order], [np.stack([x[order] for x in (*above, one, two, many.astype(np.uint64))], 1)])

    return run


def common_prefixes(leaves: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    """The LCP array of sorted leaves: the depth to which each agrees with the one before, as far as kept depths tell; 0 for the first.

    leaves: a row each of one fingerprint for each depth, the last depth's in two columns.
    """
    lcp = np.zeros(len(leaves), np.int64)
    same = np.ones(max(len(leaves) - 1, 0), bool)
    for k, depth in enumerate(depths):
        same &= leaves[1:, k] == leaves[:-1, k]
        if k == len(depths) - 1:
            same &= leaves[1:, k + 1] == leaves[:-1, k + 1]
        lcp[1:][same] = depth
    return lcp


def internal_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes at this depth: the first leaf of each, and behind the last. Those of one leaf are internal only if that leaf has several places."""
    first = np.flatnonzero(lcp < depth) if len(lcp) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(lcp)].astype(np.int64) if len(first) else first


def deep_nodes(leaves: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A bucket's internal nodes at depth WINDOW: their two fingerprints. leaves: as made by _leaves, in any order."""
    depths = (*LEVELS, window)
    n = len(depths)
    leaves = leaves[np.lexsort(leaves[:, n::-1].T)]
    first, behind = internal_nodes(common_prefixes(leaves, depths), window)
    places = np.add.reduceat(leaves[:, n + 1] + np.uint64(1), first) if len(first) else behind
    nodes = leaves[first[places > 1], n - 1 : n + 1]
    return nodes[np.lexsort((nodes[:, 1], nodes[:, 0]))]


def _subtrees(at: str, window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = deep_nodes(np.frombuffer(b"".join(rows["data"]), np.uint64).reshape(-1, len(LEVELS) + 3), window)
        shared.put(f"{at}/{int(rows['bucket'].iloc[0])}", [nodes[:, 0], nodes[:, 1]])
        return pd.DataFrame({"n": [len(nodes)]})

    return run


def _flags(census: shared.Files, nodes: shared.Files, bits: int, window: int, suffixes: Suffixes, heavy: np.ndarray) -> np.ndarray:
    """Whether each word of the slice lies in a repeated window."""
    where, one = _left(census, bits, suffixes, window)
    two = suffixes.prints(window, 1, where)
    bucket = (_prefixes(suffixes, where, one, heavy) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((one, bucket))
    where, one, two, bucket = where[order], one[order], two[order], bucket[order]
    hit = np.zeros(len(one), bool)
    for k, a, b in _runs(bucket):
        held = nodes[k].view(np.uint64)
        n = len(held) // 2
        ones, twos = held[:n], held[n:]
        place = _member(ones, one[a:b])
        hit[a:b] = (place >= 0) & (twos[place] == two[a:b]) if n else False
        # two nodes may share their first 64 bits; then the second half tells
        for i in np.flatnonzero((place >= 0) & ~hit[a:b]):
            lo, hi = np.searchsorted(ones, one[a + i], "left"), np.searchsorted(ones, one[a + i], "right")
            hit[a + i] = (twos[lo:hi] == two[a + i]).any()
    change = np.zeros(len(suffixes.words.codes) + 1, np.int64)
    np.add.at(change, where[hit], 1)
    np.add.at(change, where[hit] + window, -1)
    return np.cumsum(change)[:-1] > 0


def _stretches(gone: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Each document's runs of removed words, as (start, end) in its words."""
    n = len(gone)
    head, doc = np.zeros(n + 1, bool), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    head[offsets] = True
    starts = np.flatnonzero(gone & (head[:n] | ~np.r_[False, gone[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(gone & (head[1:] | ~np.r_[gone[1:], False])) + 1 if n else starts
    own = doc[starts] if n else starts
    bounds = np.searchsorted(own, np.arange(len(offsets)))
    pairs = pa.StructArray.from_arrays([pa.array(x - offsets[own], pa.int64()) for x in (starts, ends)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)


def _kept(found: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text with one space after each, and where each text's begin, with the end."""
    keep = ~gone
    starts, sizes = found.starts[keep], (found.stops - found.starts)[keep]
    ends = np.cumsum(sizes + 1)
    out = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    out[spans(ends - sizes - 1, sizes)] = found.data[spans(starts, sizes)]
    return out, np.r_[0, ends][np.r_[0, np.cumsum(keep)][found.offsets]]


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256 and, if asked for, kept_text and removed (runs of words, start and end) to docs without its text."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    new += [T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(pair))] if keep_text else []
    others = shared.others(docs, (f.name for f in new), text)
    spark = docs.sparkSession
    at = shared.folder(spark, "substrings")
    plain = docs.select(F.col(text).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(8, (size // BUCKET).bit_length()))
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))  # so that each bucket's file is there

    def merged(run, reduce, kind: str) -> str:
        packed = plain.mapInArrow(run, "bucket int, data binary").unionByName(every)
        # the written table is small; with it the shuffle's files can go
        shared.saved(shared.by_bucket(packed, bits).applyInPandas(reduce, "n long"), f"{at}/{kind}-done").count()
        return f"{at}/{kind}"

    census = merged(_census(bits, window), _repeated(f"{at}/census"), "census")
    heavy = np.zeros(0, np.uint64)
    for k, depth in enumerate(LEVELS):
        if k and not len(heavy):
            break
        packed = plain.mapInArrow(_counted(census, bits, window, depth, heavy.tobytes() if k else None), "bucket int, data binary")
        found = shared.by_bucket(packed, bits).applyInPandas(_heavy, "prefix long").collect()  # at most one in GROUP of all suffixes
        heavy = np.sort(np.r_[heavy, np.array([r[0] for r in found], np.int64).view(np.uint64)])
    raw = heavy.tobytes()
    nodes = merged(_leaves(census, bits, window, raw), _subtrees(f"{at}/nodes", window), "nodes")
    schema = T.StructType([docs.schema[c] for c in others] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, deep, common = shared.Files(census), shared.Files(nodes), np.frombuffer(raw, np.uint64)
        for batch in slices(batches, text):
            suffixes = Suffixes(batch[text], window)
            offsets = suffixes.words.offsets
            gone = _flags(files, deep, bits, window, suffixes, common)
            data, bounds = _kept(suffixes.words, gone)
            view, total = memoryview(data), np.r_[0, np.cumsum(gone)]
            pieces = [view[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            cols = [batch[c] for c in others]
            cols.append(pa.array(np.diff(offsets), pa.int64()))
            cols.append(pa.array(np.diff(total[offsets]), pa.int64()))
            cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()))
            if keep_text:
                cols += [pa.array([str(x, "utf-8") for x in pieces], pa.string()), _stretches(gone, offsets)]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(n, c.type) for n, c in zip(schema.names, cols, strict=True)]))

    return docs.select(*others, text).mapInArrow(run, schema)
