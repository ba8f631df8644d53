"""Quality classifier: averaged hashed word, word-pair and character n-gram vectors, softmax, numpy SGD.

Every feature (a word, a pair of neighbouring words with one feature for all
pairs of equal words, the 3- to 5-byte n-grams of
a word with its ends marked, and one end mark for each text) has a learned
vector in a hashed table. A document is the average of its features' vectors; a
softmax layer over it gives class probabilities. For scoring, each feature's
vector is projected on the difference of the classes once, so that a document
costs one gather and one sum.

Training takes a bounded sample: at most `train_rows` labelled rows with at most
`train_bytes` bytes of text, in the order of a hash of doc_id, whole texts only, equal rows once. Texts are
chosen by their sizes and digests; only those chosen are brought together.
Null or empty texts have the end mark alone. Without labelled rows of both
classes every score is the prior (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textbatch import Words, flat, hashes, mix, release, slices, words

BITS, SIZE, GRAMS = 18, 8, (3, 4, 5)
SLICE = 1 << 20  # bytes of text scored at a time
END, AGAIN = 0, 1  # the rows of the end mark and of a pair of equal words


class Model(NamedTuple):
    weights: np.ndarray  # each feature's share of the log-odds of class 1


def _rows(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each distinct word and its n-grams, flat, and the word of each."""
    data, ends = flat(distinct.cast(pa.large_binary()).view(pa.large_string())) if len(distinct) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    n = len(ends) - 1
    sizes = np.diff(ends) + 2
    bounds = np.r_[0, np.cumsum(sizes)]
    text = np.zeros(bounds[-1], np.uint64)
    inner = np.ones(len(text), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    text[inner] = data
    text[bounds[:-1]], text[bounds[1:] - 1] = 256, 257
    word = np.repeat(np.arange(n), sizes)
    rows, owner = [_rows(hashes(distinct))], [np.arange(n)]
    gram = text + np.uint64(1)
    for size in range(2, max(GRAMS) + 1):
        gram = gram[: len(text) - size + 1] * np.uint64(1000003) + text[size - 1 :] + np.uint64(1)
        if size in GRAMS and len(gram):
            whole = word[: len(gram)] == word[size - 1 :]
            rows.append(_rows(gram[whole] * np.uint64(8) + np.uint64(size)))
            owner.append(word[: len(gram)][whole])
    return np.concatenate(rows), np.concatenate(owner)


def pairs(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The table row of each pair of neighbouring words, one row for all pairs of equal words, and its document."""
    h = hashes(found.distinct)[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    same = doc[1:] == doc[:-1]
    rows = np.where(h[1:] == h[:-1], np.int32(AGAIN), _rows(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    return rows[same], doc[:-1][same]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's features as table rows and shares of the average, and where each document's begin, with the end."""
    found = words(texts)
    n = len(found.offsets) - 1
    rows, owner = subwords(found.distinct)
    doc = np.repeat(np.arange(n), np.diff(found.offsets))
    order = np.argsort(owner, kind="stable")
    rows = rows[order]
    begins = np.searchsorted(owner[order], np.arange(len(found.distinct) + 1))
    used, times = np.unique(doc.astype(np.int64) << 32 | found.codes, return_counts=True)
    code, sizes = used & 0xFFFFFFFF, np.diff(begins)[used & 0xFFFFFFFF]
    ends = np.cumsum(sizes)
    own = rows[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[code] - (ends - sizes), sizes)]
    pair, pair_doc = pairs(found)
    key = np.concatenate([np.repeat(used >> 32, sizes) << BITS | own, pair_doc.astype(np.int64) << BITS | pair, np.arange(n) << BITS | END])
    count = np.concatenate([np.repeat(times, sizes), np.ones(len(pair) + n, np.int64)])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.add.reduceat(count, starts) if len(key) else count
    key = key[starts]
    bounds = np.searchsorted(key >> BITS, np.arange(n + 1))
    total = np.add.reduceat(count, bounds[:-1]) if n else count
    return (key & ((1 << BITS) - 1)).astype(np.int32), (count / np.repeat(total, np.diff(bounds))).astype(np.float32), bounds


def _in_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as features(), with working arrays of one slice of texts at a time."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    rows, shares, sizes = [], [], []
    for part in slices([batch], "text", 1 << 17):
        row, share, bounds = features(part["text"])
        rows.append(row), shares.append(share), sizes.append(np.diff(bounds))
    row = np.concatenate(rows)
    rows.clear()  # one of the two is held twice at a time
    return row, np.concatenate(shares), np.r_[0, np.cumsum(np.concatenate(sizes))]


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 3, rate: float = 1.5, batch: int = 16, seed: int = 7) -> Model:
    """Fits vectors and softmax layer by stochastic gradient descent, its rate falling to zero."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Model(np.where(np.arange(1 << BITS) == END, 0.0 if not n else np.log(n + 1.0) * (2 * labels[0] - 1), 0.0))
    rows, share, bounds = _in_parts(texts)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE)).astype(np.float32)
    layer = np.zeros((SIZE, 2), np.float32)
    steps, step = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at : at + batch]
            sizes = np.diff(bounds)[docs]
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1]) + np.repeat(bounds[docs] - (ends - sizes), sizes)
            r, s = rows[where], share[where, None]
            hidden = np.add.reduceat(table[r] * s, ends - sizes)
            logits = hidden @ layer
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ layer.T
            layer -= lr * (hidden.T @ p)
            sort = np.argsort(r, kind="stable")
            r = r[sort]
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            table[r[cuts]] -= lr * np.add.reduceat((np.repeat(back, sizes, 0) * s)[sort], cuts)
            step += 1
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of class 1 of each text."""
    found = words(texts)
    n = len(found.offsets) - 1
    rows, owner = subwords(found.distinct)
    size = len(found.distinct)
    value, count = np.bincount(owner, model.weights[rows], size), np.bincount(owner, minlength=size)
    doc = np.repeat(np.arange(n), np.diff(found.offsets))
    pair, pair_doc = pairs(found)
    total = np.bincount(doc, value[found.codes], n) + np.bincount(pair_doc, model.weights[pair], n) + model.weights[END]
    of = np.bincount(doc, count[found.codes], n) + np.bincount(pair_doc, minlength=n) + 1
    return 1 / (1 + np.exp(-total / of))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    train_rows: int = 4000,
    train_bytes: int = 32 << 20,
) -> Model:
    """Trains on a bounded sample of docs that have a label of 0 or 1."""
    some = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64("key", F.lit(17))
    some = F.broadcast(some.distinct().orderBy(order, "key", "label").limit(train_rows))  # at most train_rows rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    sizes = rows.join(some, "key").groupBy("key", "label", "digest").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    first = Window.orderBy(order, "key", "label", "digest")  # over at most train_rows rows
    chosen = sizes.orderBy(order, "key", "label", "digest").limit(train_rows).withColumn(
        "upto", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))
    )
    chosen = F.broadcast(chosen.where(F.col("upto") <= train_bytes).select("key", "label", "digest"))
    sample = rows.join(chosen, ["key", "digest"]).groupBy("key", "label", "digest").agg(F.first("text").alias("text"))
    sample = sample.repartition(1).sortWithinPartitions(order, "key", "label", "digest").select("text", "label")
    # one partition of at most train_bytes: its features and the table being trained stay on an executor
    row = sample.mapInArrow(_train_task, "weights binary").first()
    return Model(np.frombuffer(row[0], np.float64)) if row else train(pa.array([], pa.string()), np.zeros(0, np.int64))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        model = train(table["text"].combine_chunks(), table["label"].to_numpy().astype(np.int64))
        del held, table
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary())], names=["weights"])


def score_documents(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of each whole text; it replaces a column of that name."""
    docs = docs.select(shared.others(docs, [name]))
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(model, batch[text]))], names=schema.names)

    return docs.mapInArrow(run, schema)
