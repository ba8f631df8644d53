"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped for scoring.

Words (A-Z lower-cased) are 64-bit hashes. A text is its words and one end; the
first word's context is a start mark. Counting packs each slice's distinct pairs
by bucket of the context, a shuffle brings a bucket's packs together, and each
bucket is written to the shared folder as sorted hash arrays: pair -> count,
context -> total and number of followers seen once, twice, more often. A second
shuffle, by following word, gives continuation counts and plain counts. Contexts with
more than one in HOT of all tokens spread over all buckets by the pair; their totals, and the counts of counts, are summed for each
GATHERED buckets in a task, then by Spark.

    P(w|u) = (c(u,w) - D(c(u,w))) / c(u) + g(u) * Q(w)
    Q(w) = (n(w) - D'(n(w))) / n + g' / (V + 1)

with n(w) the number of contexts of w and n their sum. An unknown context leaves Q.
Order two is a choice: counts of longer sequences need more disk than their gain here.

All counts cover the whole training part. Null and empty texts are one end. Empty
training gives log10 1 / (V + 1) = 0 for each token. Equal rows count each time.
The results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textbatch import hashes, mix, slices, spans, words

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
HOT = 1024
SLICE = 8 << 20
GATHERED = 256  # buckets
CONTEXT = ["total", "once", "twice", "more"]
STATS = [f"{kind}{k}" for kind in ("pair", "word") for k in ("1", "2", "3", "4", "_all", "_sum")] + ["tokens"]


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts' words, each text ended by code 0 (the end); the hash of each code; where texts begin, with the end."""
    found = words(texts, lower=True)
    n = len(found.offsets) - 1
    bounds = found.offsets + np.arange(n + 1)
    codes = np.zeros(bounds[-1], np.int64)
    codes[spans(bounds[:-1], np.diff(found.offsets))] = found.codes.astype(np.int64) + 1
    return codes, np.r_[END, hashes(found.distinct)], bounds


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, 255 for those in the list of large ones that comes first."""
    return [counts[counts >= 255].astype(np.int64), np.minimum(counts, 255).astype(np.uint8)]


def _large(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _count(bits: int, hot_bytes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(hot_bytes, np.uint64)
        for batch in slices(batches, "text", SLICE):
            codes, named, bounds = sequences(batch["text"])
            named = np.r_[named, START]
            before = np.r_[np.int64(0), codes[:-1]]
            before[bounds[:-1]] = len(named) - 1
            order = np.argsort(named)
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            key = np.sort(rank[before] << np.uint64(32) | rank[codes])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, len(key)])
            by_hash = named[order]
            u, w = by_hash[(key[first] >> np.uint64(32)).astype(np.int64)], by_hash[(key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            bucket = (u >> np.uint64(64 - bits)).astype(np.int64)
            if len(hot):
                common = np.isin(u, hot)
                bucket[common] = (_pair(u[common], w[common]) >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                u, w, count, bucket = u[order], w[order], count[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
                heads = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
                large, small = _small(count[a:b])
                sizes = np.array([b - a, len(heads), len(large)], np.int64)
                rows.append(
                    b"".join(
                        x.tobytes() for x in (sizes, u[a:b][heads], w[a:b], large, np.diff(np.r_[heads, b - a]).astype(np.uint32), small)
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "data"])

    return run


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, heads, large = np.frombuffer(data, np.int64, 3)
    at = 24
    u = np.frombuffer(data, np.uint64, heads, at)
    w = np.frombuffer(data, np.uint64, n, at := at + 8 * heads)
    big = np.frombuffer(data, np.int64, large, at := at + 8 * n)
    follow = np.frombuffer(data, np.uint32, heads, at := at + 8 * large)
    return np.repeat(u, follow), w, _large(np.frombuffer(data, np.uint8, n, at + 4 * heads), big)


def _of_counts(counts: np.ndarray) -> list[int]:
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts), int(counts.sum())]


def _merge_pairs(at: str, bits: int, hot_bytes: bytes):
    """A bucket's pairs: its files, and rows for the buckets of the following words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hot, own = np.frombuffer(hot_bytes, np.uint64), int(rows["bucket"].iloc[0])
        packs = [x for x in rows["data"] if x]
        if not packs:
            shared.put(f"{at}/pair/{own}", [np.zeros(2, np.int64)])
            shared.put(f"{at}/context/{own}", [])
            return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "data": pd.Series([], dtype=object)})
        u, w, c = (np.concatenate(x) for x in zip(*map(_unpacked, packs), strict=True))
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        c = np.add.reduceat(c[order], first)
        u, w = u[first], w[first]
        key = _pair(u, w)
        order = np.argsort(key)
        large, small = _small(c[order])
        shared.put(f"{at}/pair/{own}", [np.array([len(key), len(large)], np.int64), key[order], large, small])
        heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        context = np.stack([np.add.reduceat(x, heads) for x in (c, (c == 1) * 1, (c == 2) * 1, (c > 2) * 1)], 1)
        common = np.isin(u[heads], hot)
        shared.put(f"{at}/context/{own}", [u[heads][~common], context[~common]])
        stats = np.array([*_of_counts(c), 0, 0, 0, 0, 0, 0, int(c.sum())], np.int64)
        out = [(-1 - own // GATHERED, b"".join(x.tobytes() for x in (stats, u[heads][common], context[common])))]
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        seen, times, w = np.diff(np.r_[first, len(w)]), np.add.reduceat(c, first), w[first]
        bucket = (w >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
            (l1, s1), (l2, s2) = _small(seen[a:b]), _small(times[a:b])
            out.append((int(bucket[a]), b"".join(x.tobytes() for x in (np.array([b - a, len(l1), len(l2)], np.int64), w[a:b], l1, l2, s1, s2))))
        return pd.DataFrame(out, columns=["bucket", "data"])

    return run


def _merge_words(at: str):
    def one(data: bytes):
        n, n1, n2 = np.frombuffer(data, np.int64, 3)
        place = 24 + 8 * (n + n1 + n2)
        w, l1, l2 = np.frombuffer(data, np.uint64, n, 24), np.frombuffer(data, np.int64, n1, 24 + 8 * n), np.frombuffer(
            data, np.int64, n2, 24 + 8 * (n + n1)
        )
        return w, _large(np.frombuffer(data, np.uint8, n, place), l1), _large(np.frombuffer(data, np.uint8, n, place + n), l2)

    def numbers(stats) -> pd.DataFrame:
        return pd.DataFrame([[*stats, None, 0, 0, 0, 0]], columns=[*STATS, "word", *CONTEXT])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Counts of counts, in a row without a word, and shares of common contexts' totals, each in a row with its word."""
        own, packs = int(rows["bucket"].iloc[0]), [x for x in rows["data"] if x]
        if own < 0:
            parts = [np.frombuffer(x, np.int64) for x in packs]
            contexts = [x[len(STATS) :] for x in parts]
            table = np.concatenate([np.c_[x[: len(x) // 5], x[len(x) // 5 :].reshape(-1, 4)] for x in contexts])
            named, place = np.unique(table[:, 0], return_inverse=True)
            total = np.zeros((len(named), 4), np.int64)
            np.add.at(total, place, table[:, 1:])
            return pd.concat([numbers(sum(x[: len(STATS)] for x in parts)), pd.DataFrame({"word": named.astype("object"), **dict(zip(CONTEXT, total.T, strict=True))})])
        if not packs:
            shared.put(f"{at}/word/{own}", [])
            return numbers([0] * len(STATS))
        w, seen, times = (np.concatenate(x) for x in zip(*map(one, packs), strict=True))
        order = np.argsort(w, kind="stable")
        w = w[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        seen, times = np.add.reduceat(seen[order], first), np.add.reduceat(times[order], first)
        shared.put(f"{at}/word/{own}", [w[first], seen, times])
        return numbers([0] * 6 + [*_of_counts(seen), 0])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0) to D(3 and more), from the numbers of counts of 1 to 4; undefined ones take half of their count's share."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    pairs = ((n1, n2), (n2, n3), (n3, n4))
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 for k, (a, b) in enumerate(pairs, 1))])


class Model:
    """Where the arrays lie and the few numbers that aren't in them."""

    def __init__(self, at: str, bits: int, hot: bytes, stats: dict[str, int]):
        self.at, self.bits, self.hot, self.stats = at, bits, hot, stats
        self.pair = discounts(*(stats[f"pair{k}"] for k in "1234"))
        self.word = discounts(*(stats[f"word{k}"] for k in "1234"))
        self.size, self.total = stats["word_all"], stats["word_sum"]
        more = self.size - stats["word1"] - stats["word2"]
        self.spare = (self.word[1] * stats["word1"] + self.word[2] * stats["word2"] + self.word[3] * more) / self.total if self.total else 1.0


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(bucket)].tolist() if len(bucket) else [], strict=True):
        yield int(bucket[a]), a, b


def _find(held: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(held):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return place, held[place] == values


class Reader:
    """A worker's view of the model: files are mapped when they're first asked for."""

    def __init__(self, model: Model):
        self.model, self.files = model, shared.Files(model.at, 2000)
        self.hot = np.frombuffer(model.hot, np.uint64)
        self.shift = np.uint64(64 - model.bits)

    def words(self, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of contexts and count of each of these words, sorted by hash."""
        seen, times = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
        for bucket, a, b in _runs(named >> self.shift):
            held = self.files[f"word/{bucket}"].view(np.uint64)
            n = len(held) // 3
            place, there = _find(held[:n], named[a:b])
            if n:
                seen[a:b] = np.where(there, held[n : 2 * n][place], 0)
                times[a:b] = np.where(there, held[2 * n :][place], 0)
        return seen, times

    def contexts(self, named: np.ndarray) -> np.ndarray:
        """Total and numbers of followers seen once, twice and more of each of these contexts, sorted by hash."""
        out = np.zeros((len(named), 4), np.int64)
        for bucket, a, b in [*_runs(named >> self.shift), *([("hot", 0, len(named))] if len(self.hot) else [])]:
            held = self.files[f"context/{bucket}"].view(np.int64)
            n = len(held) // 5
            place, there = _find(held[:n].view(np.uint64), named[a:b])
            if n:
                out[a:b][there] = held[n:].reshape(-1, 4)[place[there]]
        return out

    def pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = _pair(u, w)
        bucket = u >> self.shift
        if len(self.hot):
            common = np.isin(u, self.hot)
            bucket = np.where(common, key >> self.shift, bucket)
        order = np.lexsort((key, bucket))
        out = np.zeros(len(key), np.int64)
        for one, a, b in _runs(bucket[order]):
            raw = self.files[f"pair/{one}"]
            n, large = raw[:16].view(np.int64)
            if not n:
                continue
            place, there = _find(raw[16 : 16 + 8 * n].view(np.uint64), key[order[a:b]])
            small = raw[16 + 8 * (n + large) :]
            got = small[place].astype(np.int64)
            if large and (got == 255).any():
                where = np.flatnonzero(small == 255)
                most = raw[16 + 8 * n : 16 + 8 * (n + large)].view(np.int64)
                got = np.where(got == 255, most[np.minimum(np.searchsorted(where, place), large - 1)], got)
            out[order[a:b]] = np.where(there, got, 0)
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        m = self.model
        codes, named, bounds = sequences(texts)
        order = np.argsort(named)
        seen, times, context = np.empty(len(named), np.int64), np.empty(len(named), np.int64), np.empty((len(named) + 1, 4), np.int64)
        seen[order], times[order] = self.words(named[order])
        context[order] = self.contexts(named[order])
        context[-1] = self.contexts(np.array([START]))[0]
        if m.total:
            lower = (seen - m.word[np.minimum(seen, 3)]) / m.total + m.spare / (m.size + 1)
        else:
            lower = np.full(len(named), 1 / (m.size + 1))
        before = np.r_[np.int64(0), codes[:-1]]
        before[bounds[:-1]] = len(named)
        count = self.pairs(np.r_[named, START][before], named[codes])
        total = context[before, 0]
        spare = (context[:, 1] * m.pair[1] + context[:, 2] * m.pair[2] + context[:, 3] * m.pair[3])[before]
        known = np.maximum(total, 1)
        p = np.where(total > 0, (count - m.pair[np.minimum(count, 3)]) / known + spare / known * lower[codes], lower[codes])
        base = np.log10((times + 1) / (m.stats["tokens"] + m.size + 1))
        starts = bounds[:-1]
        if not len(starts):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        return np.diff(bounds), np.add.reduceat(
            (times[codes] > 0) * 1, starts
        ), np.add.reduceat(base[codes], starts), np.add.reduceat(np.log10(p), starts)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        codes, named, _ = sequences(batch["text"])
        count = np.bincount(codes, minlength=len(named))
        many = count * HOT * 2 >= len(codes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(named[many].view(np.int64)), pa.array(count[many]), pa.array(np.where(np.arange(many.sum()) == 0, len(codes), 0))],
            names=["word", "n", "tokens"],
        )


def train(texts: DataFrame) -> Model:
    """Counts all texts (one column, text) and writes the model's arrays in the shared folder."""
    spark = texts.sparkSession
    at = shared.folder(spark, "ngrams")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about 8 MB of text for each bucket, in whatever number of buckets; less in less than 256 buckets
    bits = min(31, max(min(8, (size >> 18).bit_length()), (size >> 23).bit_length(), 1))
    seen = shared.saved(
        texts.mapInArrow(_common, "word long, n long, tokens long").groupBy("word").agg(
            F.sum("n").alias("n"), F.sum("tokens").alias("tokens")
        ),
        f"{at}/common",
    )
    tokens = seen.agg(F.sum("tokens")).first()[0] or 0
    # at most HOT contexts have such a share; the start mark has one for each text
    words_ = [r[0] for r in seen.where(F.col("n") * HOT >= tokens).select("word").collect()]
    hot = np.sort(np.r_[np.array(words_, np.int64).view(np.uint64), START]).tobytes()
    packed = texts.mapInArrow(_count(bits, hot), "bucket int, data binary")
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))  # each bucket's files are there
    merged = shared.by_bucket(packed.unionByName(every), bits).applyInPandas(_merge_pairs(at, bits, hot), "bucket int, data binary")
    names = [*STATS, "word", *CONTEXT]
    stats = shared.by_bucket(merged.unionByName(every), bits).applyInPandas(_merge_words(at), ", ".join(f"{x} long" for x in names))
    rows = stats.groupBy("word").agg(*[F.sum(x).alias(x) for x in names if x != "word"]).collect()  # one, and one for each hot context
    common = [r for r in rows if r["word"] is not None]
    named = np.array([r["word"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(named)
    shared.put(f"{at}/context/hot", [named[order], np.array([[r[c] for c in CONTEXT] for r in common], np.int64).reshape(-1, 4)[order]])
    found = next((r for r in rows if r["word"] is None), None)
    return Model(at, bits, hot, {x: (found[x] or 0) if found else 0 for x in STATS})


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score and score (log10 probabilities of the whole text) to docs without its text."""
    new = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
    others = shared.others(docs, (f.name for f in new), text)
    schema = T.StructType([docs.schema[c] for c in others] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), *map(pa.array, reader.score(batch[text]))], names=schema.names)

    return docs.select(*others, text).mapInArrow(run, schema)


def perplexity(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)
