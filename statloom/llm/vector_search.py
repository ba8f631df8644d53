"""Nearest neighbours by adaptive dimension scan in an inverted-list index.

Equal vectors (by 128-bit digests) are one, with their k + 1 least ids: no answer can need more. So a
vector that a third of all rows share is one candidate and one query; ids are cut down in salted parts first. Vectors are assigned to the
nearest of about the square root of their number of centroids, fitted on a sample of at most SAMPLE_BYTES; every row is
indexed. A query is sent to its best lists; the number of lists is what finds AIM of
the true neighbours of ASKED sample vectors, which an exact pass over all vectors gives. Small lists are put together in shards, so that a
query travels once to each; large lists are cut. Shards and their queries are dealt in
tiles of a bounded number of rows and queries, however large a list is.

In a tile, vectors are rotated to the sample's principal axes, so that the first columns hold most of a product, and
read in column blocks. After each block a candidate is dropped if its partial inner product, plus what the other columns
may add, stays below the query's k-th best so far. They may add a share of the product of what is left of both vectors'
norms: the share that all but ERROR of the true neighbours of the ASKED vectors get by with, for each depth and for bands of the cosine
that is to be reached. It's 1, which no pair passes, where nothing was measured. A query first goes to the shard of its best list, and there to that
list; what it finds is where its other shards begin. The scores of those that are left are computed on the original vectors in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different
lengths have no inner product: each length is searched by itself. Equal rows are one; of several vectors of one id the one of
the least digest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SAMPLE_BYTES, ASKED, AIM, ERROR = 16 << 20, 400, 0.985, 0.005
BLOCK, QUERIES, COLUMNS, STEP = 4096, 4096, 16, 512
DEPTHS = 8  # column blocks, at most
BANDS = np.array([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])  # of cosines, for each of which the tests are measured
SALTS = 64  # parts of a group that may be large


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, seed: int = 3) -> np.ndarray:
    """Centroids by k-means on directions: the square root of the number of rows, or as many as the sample bears."""
    n = len(sample)
    lists = int(max(1, min(n // 16, round(rows**0.5))))
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    centers = unit[rng.choice(n, lists, replace=False)]
    for _ in range(8):
        own = np.concatenate([(unit[k : k + STEP] @ centers.T).argmax(1) for k in range(0, n, STEP)])
        total = np.zeros_like(centers)
        np.add.at(total, own, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(norm > 0, total / np.maximum(norm, 1e-30), centers)
    return centers


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)


def axes(sample: np.ndarray) -> np.ndarray:
    """The rotation to the principal axes of these vectors about zero, the one of most energy first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def cuts_of(size: int) -> list[int]:
    """After how many columns candidates are tested."""
    step = max(COLUMNS, -(-size // DEPTHS))
    return [*range(step, size, step)]


def _rests(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The norms of the columns from each cut on: a row for each vector."""
    return np.stack([np.linalg.norm(x[:, c:], axis=1) for c in cuts], 1) if cuts else np.zeros((len(x), 0))


def measured(kth: np.ndarray, norms: np.ndarray, parts: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """The share of the rest that a test allows, by depth and band of the cosine to be reached, from pairs of true neighbours.

    kth: the product that the pair's query must reach in the end; norms: of both vectors, multiplied; parts and rests: partial
    products and remaining norms (multiplied) by depth. While a query's k-th best is still lower, it may be in any lower band: each is
    measured at its upper edge.
    """
    share = np.ones((parts.shape[1], len(BANDS) + 1))
    cosine = kth / norms
    for band, (low, high) in enumerate(pairwise([-np.inf, *BANDS, np.inf])):
        use = cosine >= low
        if use.any():
            reach = np.minimum(cosine[use], high) * norms[use]
            for depth in range(len(share)):
                rest = rests[use, depth]
                need = np.where(rest > 1e-12, (reach - parts[use, depth]) / np.maximum(rest, 1e-12), 0.0)
                share[depth, band] = np.clip(np.quantile(need, 1 - ERROR / len(share), method="higher"), 0.0, 1.0)
    return share


def _best_lists(asked: np.ndarray, k: int, turn: np.ndarray):
    """A task's k best vectors for each of these queries: query, negative score, list, partial products and the vector's remaining norms and norm."""
    cuts = cuts_of(asked.shape[1])
    turned = asked @ turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, where = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
        told = np.zeros((len(asked), k, 2 * len(cuts) + 1))
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                lists = part["lists"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # one each
                x = _vectors(part["embedding"], asked.shape[1])
                every = np.c_[score, asked @ x.T]
                where = np.c_[where, np.tile(lists, (len(asked), 1))]
                top = np.argpartition(-every, k - 1, axis=1)[:, :k]
                score, where = np.take_along_axis(every, top, 1), np.take_along_axis(where, top, 1)
                y = x @ turn
                rests, norm = _rests(y, cuts), np.linalg.norm(x, axis=1)
                old = np.take_along_axis(told, np.minimum(top, k - 1)[:, :, None], 1)
                q, place = np.nonzero(top >= k)
                new = top[q, place] - k
                parts = np.zeros((len(q), len(cuts)))
                for depth, c in enumerate(cuts):
                    parts[:, depth] = (turned[q, :c] * y[new, :c]).sum(1)
                old[q, place] = np.c_[parts, rests[new], norm[new]]
                told = old
        q, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(q, pa.int64()),
                pa.array(-score[q, place]),
                pa.array(where[q, place], pa.int64()),
                pa.array(list(told[q, place]), pa.list_(pa.float64())),
            ],
            names=["q", "neg", "list", "told"],
        )

    return run


def probes_for(held: DataFrame, sample: np.ndarray, centers: np.ndarray, k: int, turn: np.ndarray) -> tuple[int, np.ndarray]:
    """How many lists of a query find AIM of its k nearest among all vectors, and what the tests may allow, by the exact neighbours of some of the sample."""
    asked = sample[np.random.default_rng(4).choice(len(sample), min(len(sample), ASKED), replace=False)]
    found = held.select("embedding", "lists").mapInArrow(_best_lists(asked, k, turn), "q long, neg double, list long, told array<double>")
    best = lambda by: F.slice(F.array_sort(F.flatten(F.collect_list(by))), 1, k).alias("near")
    found = found.withColumn("salt", F.pmod(F.xxhash64("neg", "list"), F.lit(SALTS))).withColumn("near", F.array(F.struct("neg", "list", "told")))
    found = found.groupBy("q", "salt").agg(best("near")).groupBy("q").agg(best("near"))
    near = {r["q"]: r["near"] for r in found.collect()}  # at most ASKED rows of k
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1), axis=1)
    needed = np.sort(np.concatenate([place[q, [x["list"] for x in rows]] for q, rows in near.items()]))
    full = [(q, -rows[-1]["neg"], x["told"]) for q, rows in near.items() if len(rows) == k for x in rows]
    cuts = cuts_of(asked.shape[1])
    q, told = np.array([x[0] for x in full], np.int64), np.array([x[2] for x in full]).reshape(len(full), 2 * len(cuts) + 1)
    rests, norm = _rests(asked @ turn, cuts), np.linalg.norm(asked, axis=1)
    share = measured(np.array([x[1] for x in full]), norm[q] * told[:, -1], told[:, : len(cuts)], rests[q] * told[:, len(cuts) : -1])
    return int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1, share


def scan(
    queries: np.ndarray,
    rows: np.ndarray,
    k: int,
    lists: np.ndarray | None = None,
    probed: np.ndarray | None = None,
    turn: np.ndarray | None = None,
    share: np.ndarray | None = None,
    first: np.ndarray | None = None,
    least: np.ndarray | None = None,
    dropped: np.ndarray | None = None,
) -> list[np.ndarray]:
    """For each query, the rows that may be among its k of largest inner product in the lists it probes.

    lists: the list of each row, sorted, from 0; probed: whether a query (first axis) probes a list; first: the list that a query
    begins with. The k-th best that a query has (least, before it has any here) is where the next block of rows begins. turn and share: see axes and
    measured; without them nothing is dropped that could be among the best. dropped: pairs that end after each block of columns are added to it.
    """
    size = rows.shape[1]
    lists = np.zeros(len(rows), np.int64) if lists is None else lists
    probed = np.ones((len(queries), int(lists[-1]) + 1), bool) if probed is None else probed
    cuts = cuts_of(size)
    ends = [*cuts, size]
    share = np.ones((len(cuts), len(BANDS) + 1)) if share is None else share
    q, x = (queries, rows) if turn is None else (queries @ turn, rows @ turn)
    q_rest, x_rest = _rests(q, cuts), _rests(x, cuts)
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    best = np.full((len(q), k), -np.inf)
    least = np.full(len(q), -np.inf) if least is None else least
    found_q, found_x, found_s = [], [], []
    bounds = np.searchsorted(lists, np.arange(probed.shape[1] + 1))
    begins = np.zeros_like(probed)
    if first is not None:
        begins[np.arange(len(q)), first] = True
        begins &= probed
    for own, one in ((np.flatnonzero(mask[:, one]), one) for mask in (begins, probed & ~begins) for one in range(probed.shape[1])):
        for at in range(bounds[one], bounds[one + 1], STEP) if len(own) else ():
            here = slice(at, min(at + STEP, bounds[one + 1]))
            floor = np.maximum(best[own, 0], least[own])
            band = np.searchsorted(BANDS, floor[:, None] / (q_norm[own][:, None] * x_norm[here]), side="right")
            live, part, iq = np.ones(band.shape, bool), np.zeros(band.shape), None
            for depth, (a, b) in enumerate(pairwise([0, *ends])):
                if iq is None:
                    part += q[own, a:b] @ x[here, a:b].T
                    upto = part + 1e-9 * (1 + np.abs(part))
                    if b < size:
                        upto += share[depth][band] * np.outer(q_rest[own, depth], x_rest[here, depth])
                    stay = live & (upto >= floor[:, None])
                    gone = int(live.sum() - stay.sum())
                    live = stay
                    if b == size or live.mean() <= 0.25:  # few enough to pick out
                        iq, ix = np.nonzero(live)
                        value = part[iq, ix]
                else:
                    value = value + np.einsum("ij,ij->i", q[own[iq], a:b], x[at + ix, a:b])
                    upto = value + 1e-9 * (1 + np.abs(value))
                    if b < size:
                        upto += share[depth][band[iq, ix]] * q_rest[own[iq], depth] * x_rest[at + ix, depth]
                    stay = upto >= floor[iq]
                    gone = len(iq) - int(stay.sum())
                    iq, ix, value = iq[stay], ix[stay], value[stay]
                if dropped is not None:
                    dropped[depth] += gone
            if not len(iq):
                continue
            found_q.append(own[iq]), found_x.append(at + ix), found_s.append(value)
            order = np.lexsort((-value, iq))
            iq, value = iq[order], value[order]
            hit, starts = np.unique(iq, return_index=True)
            place = np.arange(len(iq)) - np.repeat(starts, np.diff(np.r_[starts, len(iq)]))
            top = place < k
            new = np.full((len(hit), k), -np.inf)
            new[np.searchsorted(hit, iq[top]), place[top]] = value[top]
            best[own[hit]] = np.sort(np.concatenate([best[own[hit]], new], 1), axis=1)[:, -k:]
    if not found_q:
        return [np.zeros(0, np.int64)] * len(q)
    iq, ix, value = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
    stay = value + 1e-9 * (1 + np.abs(value)) >= np.maximum(best[:, 0], least)[iq]
    iq, ix = iq[stay], ix[stay]
    order = np.argsort(iq, kind="stable")
    return np.split(ix[order], np.searchsorted(iq[order], np.arange(1, len(q))))


def _tile(k: int, turn: np.ndarray, share: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["asks"]].drop_duplicates("id").sort_values("id")
        held = rows[~rows["asks"]]
        if not len(asked) or not len(held):
            return pd.DataFrame({"qid": [], "near": []}).astype({"qid": "int64"})
        own = np.array([x[0] for x in held["lists"]])
        order = np.lexsort((held["id"].to_numpy(), own))
        held = held.iloc[order]
        names, own = np.unique(own[order], return_inverse=True)
        probed = np.stack([np.isin(names, x) for x in asked["lists"]])
        # a query's lists come best first
        first = np.array([next((np.searchsorted(names, v) for v in x if v in names), 0) for x in asked["lists"]])
        least = np.nan_to_num(asked["least"].to_numpy(np.float64), nan=-np.inf)
        q, x = np.stack(asked["embedding"]).astype(np.float64), np.stack(held["embedding"]).astype(np.float64)
        ids = held["id"].to_numpy()
        out = []
        for i, near in enumerate(scan(q, x, k, own, probed, turn, share, first, least)):
            score = (x[near] * q[i]).sum(1)
            order = np.lexsort((ids[near], -score))[:k]
            out.append([{"neg": -float(s), "id": int(v)} for s, v in zip(score[order], ids[near][order], strict=True)])
        return pd.DataFrame({"qid": asked["id"].to_numpy(), "near": out})

    return run


def shards(sizes: list[int], most: int) -> list[int]:
    """A shard for each list, in order: lists are put together up to `most` rows; a larger one is alone."""
    out, shard, held = [], 0, 0
    for c in sizes:
        if held and held + c > most:
            shard, held = shard + 1, 0
        out.append(shard)
        held += c
    return out


def _lists(centers: np.ndarray, probes: int, sizes: list[int] | None, most: int, shard: list[int] | None = None):
    """Each vector with its list; or with sizes, a row for each shard that holds some of its lists, best first: the first
    `probes`, or as many as hold `most` rows. best: whether the shard has its best list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, len(whole), STEP)):
            x = _vectors(batch["embedding"], centers.shape[1])
            near = x @ centers.T
            if sizes is None:
                rows, lists = np.arange(len(x)), near.argmax(1)
                of = place = np.zeros(len(x), np.int64)
            else:
                order = np.argsort(-near, axis=1, kind="stable")
                before = np.cumsum(np.array(sizes)[order], axis=1) - np.array(sizes)[order]
                rows, place = np.nonzero((np.arange(order.shape[1]) < probes) | (before < most))
                lists = order[rows, place]
                of = np.array(shard)[lists]
                order = np.lexsort((place, of, rows))
                rows, lists, of, place = rows[order], lists[order], of[order], place[order]
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (of[1:] != of[:-1])]) if len(rows) else rows
            held = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)], pa.int32()), pa.array(lists, pa.int32()))
            got = batch.take(pa.array(rows[first]))
            yield pa.RecordBatch.from_arrays(
                [got["id"], got["embedding"], held, pa.array(of[first], pa.int32()), pa.array(place[first] == 0)],
                names=["id", "embedding", "lists", "shard", "best"],
            )

    return run


def _search(single: DataFrame, questions: DataFrame, size: int, k: int, at: str) -> DataFrame:
    """qid and the k nearest (neg, id) of each question's vector. single and questions: id and embedding, of one length."""
    kind, rows = dict(single.dtypes)["embedding"], single.count()
    most = min(max(8192, 16 * round(rows**0.5)), SAMPLE_BYTES // (8 * size) + 1)
    sample = np.stack(single.orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toPandas()["embedding"]).astype(np.float64)
    centers = fit(sample, rows)
    turn = axes(sample)
    schema = f"id long, embedding {kind}, lists array<int>, shard int, best boolean"
    held = shared.saved(single.select("id", "embedding").mapInArrow(_lists(centers, 1, None, 0), schema).drop("shard", "best"), f"{at}/lists")
    probes, share = probes_for(held, sample, centers, k, turn)
    counts = dict(held.groupBy(F.element_at("lists", 1)).count().collect())  # one row for each centroid
    sizes = [counts.get(i, 0) for i in range(len(centers))]
    shard = shards(sizes, BLOCK)
    of = np.bincount(shard, sizes).astype(int).tolist()
    probed = shared.saved(questions.select("id", "embedding").mapInArrow(_lists(centers, probes, sizes, 2 * k, shard), schema), f"{at}/probes")
    held = held.withColumn("shard", F.array(*map(F.lit, shard))[F.element_at("lists", 1)])

    def parts(of: dict[int, int], most: int):
        many = {i: -(-c // most) for i, c in of.items() if c > most}  # at most one for each centroid
        table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair]) if many else None
        return F.lit(1) if table is None else F.coalesce(table[F.col("shard")], F.lit(1))

    def tiles(asking: DataFrame) -> DataFrame:
        """qid and near of each block of each shard that a question asks: the k nearest there that are at least as near as its column least."""
        asks = dict(asking.groupBy("shard").count().collect())
        blocks, chunks = parts(dict(enumerate(of)), BLOCK), parts(asks, QUERIES)
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = held.join(asking.select("shard").distinct(), "shard", "left_semi").withColumn("asks", F.lit(False))
        rows = rows.withColumn("block", part(blocks)).withColumn("chunk", every(chunks)).withColumn("least", F.lit(None).cast("double"))
        asking = asking.drop("best").withColumn("asks", F.lit(True)).withColumn("chunk", part(chunks)).withColumn("block", every(blocks))
        grouped = rows.unionByName(asking).groupBy("shard", "block", "chunk")
        return grouped.applyInPandas(_tile(k, turn, share), "qid long, near array<struct<neg:double,id:long>>")

    merged = lambda near: near.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    near = shared.saved(tiles(probed.where("best").withColumn("least", F.lit(None).cast("double"))), f"{at}/best")
    rest = probed.where("NOT best")
    if rest.limit(1).count():
        least = merged(near).select(F.col("qid").alias("id"), F.when(F.size("near") >= k, -F.element_at("near", -1)["neg"]).alias("least"))
        near = near.unionByName(tiles(rest.join(least, "id", "left")))
    return merged(near)


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by inner product. is_query: a predicate on the column _key."""
    spark = vectors.sparkSession
    at = shared.folder(spark, "vectors")
    embedding, same = F.col("embedding"), ["h1", "h2"]
    whole = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("embedding")).where(
        "_key IS NOT NULL AND embedding IS NOT NULL"
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = whole.where(F.coalesce(F.forall(embedding, finite), F.lit(False)) & F.exists(embedding, lambda x: x != 0))
    # -0.0 and 0.0 are one: such vectors have equal products
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    whole = whole.withColumn("embedding", F.transform(embedding, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind))))
    whole = whole.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))

    owned = whole.groupBy("_key").agg(F.min(F.struct(*same)).alias("h")).select("_key", "h.*")
    few = owned.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    for by in ([*same, "salt"], same):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).where(F.col("r") <= k + 1)
    few = few.groupBy(*same).agg(F.array_sort(F.collect_list("_key")).alias("ids"))
    single = whole.groupBy(*same).agg(F.first("embedding").alias("embedding")).join(few, same)
    single = shared.saved(
        single.select(*same, F.element_at("ids", 1).alias("id"), "ids", "embedding", F.size("embedding").alias("size")), f"{at}/single"
    )
    asked = owned.where(is_query(F.col("_key")))
    questions = shared.saved(single.join(asked.select(*same).distinct(), same, "left_semi").drop("ids"), f"{at}/questions")
    found = None
    for size in sorted(r[0] for r in questions.select("size").distinct().collect()):
        one = _search(single.where(F.col("size") == size), questions.where(F.col("size") == size), size, k + 1, f"{at}/{size}")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = found.select("qid", F.explode("near").alias("n")).select("qid", "n.neg", F.col("n.id").alias("id")).join(single.select("id", "ids"), "id")
    named = near.select("qid", F.transform("ids", lambda v: F.struct(F.col("neg"), v.alias("id"))).alias("all"))
    answers = named.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("all"))), 1, k + 1).alias("all"))
    answers = answers.join(questions.select(F.col("id").alias("qid"), *same), "qid").drop("qid")
    full = asked.join(answers, same).select(
        F.col("_key").alias("query_id"), F.slice(F.filter("all", lambda a: a["id"] != F.col("_key")), 1, k).alias("all")
    )
    ranked = full.select("query_id", F.posexplode("all").alias("rank", "a"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("a.id").alias("vec_id"), (-F.col("a.neg")).alias("score"))
