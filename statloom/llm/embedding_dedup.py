"""Embedding near-dedup: navigable small-world graphs per shard, every shard queried, links verified by cosine, components joined.

Vectors are compared where labels and lengths are equal. Equal ones (128-bit digests) are one class with a weight. A
label's classes are dealt by digest to as many shards as keep one below SHARD_BYTES, and a task writes a shard's graph to a file of the
shared folder. Labels of one shard are dealt to tasks in small groups, each with graphs of its own, and answered where they're built.

While a graph is built, a class within half of the linking angle of a node joins that node's ball, so members of a ball are all linked with each
other, and a group of near copies is a few nodes however large it is. The layers of the graph are prefixes of its nodes, which come in random order.

Every shard of a label is then queried with the nodes of every other one and with its own: a tile is a shard and a few shards that it's held against, read
from their files; no vector is shuffled again. A query's beam is widened while it's full of nodes in reach. Of each pair
of shards some queries are compared with all nodes: where less than AUDIT of what is in reach, or beyond it by less than BEYOND, was found, beams
are doubled and all queries asked again; a graph that no beam searches well enough is read whole. Of two balls in reach, those wholly within the linking
angle (by the triangle inequality) are linked as a whole; of the others the members' cosines are computed in double precision. So links are counted and
never listed: a tile gives the number of links of each class, and a spanning forest of the links between balls, whose components
are joined by alternating large-star and small-star.

Vectors that are null or zero, or hold null or non-finite components, and those without a label, link with nothing: they have no links,
are their own component and kept. Rows are vectors: of equal rows, each counts as the others' link, and rows of one vec_id aren't linked by it. Rows
without a vec_id count as links but never name a component; component_id is null where no row of it has one. kept: vec_id equals component_id, null with null.
Empty tables give none. Other columns are left out by linked(); deduplicated() returns the kept rows as they are.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

COSINE = 0.93
SHARD_BYTES, ACROSS, SHARED = 8 << 20, 8, 64  # of a shard's vectors as doubles; shards that a tile is held against; groups of small labels for SHARD_BYTES
WIDTH, FAN, BUILD, BEAM = 32, 16, 48, 32  # links of a node, nodes of a layer for one of the next, beams of building and of asking
BATCH, AT_ONCE = 256, 4  # queries walked together; nodes opened in one step
ASKED, AUDIT, BEYOND = 256, 0.99, 0.2  # queries of an audit, the share of what is near that has to be found, and an angle that widens the reach for it
SLACK, EXACT = 1e-6, 1e-12  # angles nearer than SLACK to a bound are decided by cosines, cosines nearer than EXACT by exact sums
PLACE = 1 << 24  # classes of a shard, at most


def beam_search(x: np.ndarray, links: np.ndarray, n: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best nodes of the first n, walked to from its start nodes: ids (-1 behind the last) and inner products, best first."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True  # where -1 points to
    seen[rows[:, None], start] = True
    size = max(width, start.shape[1])
    ids, score = np.full((len(q), size), -1, np.int32), np.full((len(q), size), -np.inf, np.float32)
    ids[:, : start.shape[1]] = start
    known = np.where(start >= 0, np.einsum("qd,qed->qe", q, x[np.maximum(start, 0)]), -np.inf)
    score[:, : start.shape[1]] = known
    closed = ids < 0
    step = min(AT_ONCE, size)
    while len(rows):
        todo = np.where(closed[rows], -np.inf, score[rows])
        best = np.argpartition(-todo, step - 1, axis=1)[:, :step] if step < size else np.tile(np.arange(size), (len(rows), 1))
        good = np.take_along_axis(todo, best, 1) > -np.inf
        going = good.any(1)
        rows, best, good = rows[going], best[going], good[going]
        if not len(rows):
            break
        shut = closed[rows]
        np.put_along_axis(shut, best, True, 1)
        near = np.where(good[:, :, None], links[np.take_along_axis(ids[rows], best, 1)], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~seen[rows[:, None], near]
        iq, ik = np.nonzero(fresh)
        seen[rows[iq], near[iq, ik]] = True
        more = np.full(near.shape, -np.inf, np.float32)
        more[iq, ik] = np.einsum("ij,ij->i", q[rows[iq]], x[near[iq, ik]])
        both, of = np.concatenate([score[rows], more], 1), np.concatenate([ids[rows], np.where(fresh, near, -1).astype(np.int32)], 1)
        shut = np.concatenate([shut, ~fresh], 1)
        top = np.argpartition(-both, size - 1, axis=1)[:, :size]
        score[rows], ids[rows], closed[rows] = (np.take_along_axis(a, top, 1) for a in (both, of, shut))
    order = np.argsort(-score, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def spread(x: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of each node's candidates (ids, -1 for none), k that point to different sides: first those nearer to the node than to any chosen, then the nearest."""
    out = np.full((len(near), k), -1, np.int32)
    for at in range(0, len(near), BATCH):
        order = np.argsort(-score[at : at + BATCH], axis=1, kind="stable")[:, : 2 * WIDTH]
        ids, s = np.take_along_axis(near[at : at + BATCH], order, 1), np.take_along_axis(score[at : at + BATCH], order, 1)
        some = x[np.maximum(ids, 0)]
        apart = some @ some.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            chosen[:, c] = (ids[:, c] >= 0) & (chosen.sum(1) < k) & ~(chosen & (apart[:, c] > s[:, c, None])).any(1)
        first = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :k]
        out[at : at + BATCH, : first.shape[1]] = np.take_along_axis(ids, first, 1)
    return out


class Graph:
    """A hierarchical graph of balls over unit vectors, in the order in which they're given."""

    def __init__(self, unit: np.ndarray, half: float):
        n = len(unit)
        self.x = unit.astype(np.float32)
        self.sizes, self.nodes = [n], np.zeros(n, np.int64)  # nodes: the vector that each node is
        while self.sizes[-1] // FAN >= 8:
            self.sizes.append(self.sizes[-1] // FAN)
        self.layers = [np.full((size, WIDTH), -1, np.int32) for size in self.sizes]
        self.ball, self.radius, self.n = np.zeros(n, np.int64), np.zeros(n), 0
        self.at = np.zeros((n, unit.shape[1]), np.float32)  # the nodes' vectors
        place = 0
        while place < n:
            end = min(n, place + BATCH)
            self._insert(unit, np.arange(place, end), half)
            place = end
        self.nodes, self.radius, self.at = self.nodes[: self.n], self.radius[: self.n], self.at[: self.n]
        self.layers = [links[: self.n] for links in self.layers]

    def walk(self, q: np.ndarray, width: int, every: bool = False):
        """Beams at the lowest layer; with every, those of all layers, lowest first."""
        start, found = np.zeros((len(q), 1), np.int32), []
        for k in reversed(range(len(self.layers))):
            n = min(self.n, len(self.layers[k]))
            wide = width if k == 0 or (every and self.n < self.sizes[k]) else AT_ONCE
            start, score = beam_search(self.at, self.layers[k], n, q, start, wide)
            found.append((start, score))
        return found[::-1] if every else found[-1]

    def _insert(self, unit: np.ndarray, new: np.ndarray, half: float) -> None:
        rest = np.ones(len(new), bool)
        if self.n:
            found = self.walk(self.x[new], BUILD, True)
            best = found[0][0][:, 0]
            angle = angles((unit[new] * unit[self.nodes[best]]).sum(1))
            inside = angle <= half
            self.ball[new[inside]] = best[inside]
            np.maximum.at(self.radius, best[inside], angle[inside])
            rest = ~inside
        rows = np.flatnonzero(rest)
        product = unit[new[rows]] @ unit[new[rows]].T
        nearest, of, chosen = np.full(len(rows), -np.inf), np.full(len(rows), -1), []
        for i in range(len(rows)):
            if nearest[i] > -np.inf and (angle := float(angles(nearest[i]))) <= half:
                self.ball[new[rows[i]]] = of[i]
                self.radius[of[i]] = max(self.radius[of[i]], angle)
                continue
            node = self.n + len(chosen)
            closer = product[i] > nearest
            nearest[closer], of[closer] = product[i][closer], node
            chosen.append(i)
        if not chosen:
            return
        ids = self.n + np.arange(len(chosen))
        self.nodes[ids], self.at[ids], self.ball[new[rows[chosen]]] = new[rows[chosen]], self.x[new[rows[chosen]]], ids
        beside = product[np.ix_(chosen, chosen)].astype(np.float32)
        np.fill_diagonal(beside, -np.inf)
        before, self.n = self.n, self.n + len(ids)
        for k, links in enumerate(self.layers):
            own = ids[ids < self.sizes[k]] - before
            if not len(own):
                continue
            near, score = np.tile(ids[own].astype(np.int32), (len(own), 1)), beside[np.ix_(own, own)]
            near = np.where(score > -np.inf, near, -1)
            if before:
                near = np.concatenate([near, found[k][0][rows[chosen]][own]], 1)
                score = np.concatenate([score, found[k][1][rows[chosen]][own]], 1)
            self._connect(links, ids[own], near, score)

    def _connect(self, links: np.ndarray, ids: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        links[ids, : WIDTH // 2] = out = spread(self.at, near, score, WIDTH // 2)
        source, place = np.nonzero(out >= 0)
        to, back = out[source, place], ids[source].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else to
        turn = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        place = (links[to] >= 0).sum(1) + turn
        twice = (links[to] == back[:, None]).any(1)  # a new node may have chosen it too
        fits = (place < WIDTH) & ~twice
        links[to[fits], place[fits]] = back[fits]
        over = ~fits & ~twice & (turn < WIDTH)
        if over.any():
            full = np.unique(to[over])
            wide = np.full((len(full), 2 * WIDTH), -1, np.int32)
            wide[:, :WIDTH] = links[full]
            wide[np.searchsorted(full, to[over]), WIDTH + turn[over]] = back[over]
            product = np.concatenate([
                np.einsum("td,tcd->tc", self.at[full[a : a + BATCH]], self.at[np.maximum(wide[a : a + BATCH], 0)]) for a in range(0, len(full), BATCH)
            ])
            kept = spread(self.at, wide, np.where(wide >= 0, product, -np.inf), 3 * WIDTH // 4)
            links[full] = -1
            links[full, : kept.shape[1]] = kept

    def arrays(self) -> dict[str, np.ndarray]:
        return {"nodes": self.nodes, "radius": self.radius, "ball": self.ball} | {f"layer{k}": links for k, links in enumerate(self.layers)}


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class Stored(Graph):
    """A graph read from its file, with its vectors."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.raw, self.weight = held["x"].astype(np.float64), held["weight"]
        self.unit = units(self.raw)
        self.nodes, self.radius, self.ball = held["nodes"], held["radius"], held["ball"]
        self.layers = [held[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in held))]
        self.sizes, self.n = [len(links) for links in self.layers], len(self.nodes)
        self.at = self.unit[self.nodes].astype(np.float32)
        order = np.argsort(self.ball, kind="stable")
        self.members = np.split(order, np.searchsorted(self.ball[order], np.arange(1, self.n)))
        self.mass = np.bincount(self.ball, self.weight, self.n).astype(np.int64)

    def reach(self, q: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and node of all pairs found with an inner product of at least the query's `low`; full beams are doubled."""
        out, todo = [], np.arange(len(q))
        while len(todo):
            again = []
            for at in range(0, len(todo), BATCH):
                rows = todo[at : at + BATCH]
                ids, score = self.walk(q[rows], min(width, self.n))
                hit = score >= low[rows, None] - 1e-5  # single precision
                full = hit.all(1) & (ids.shape[1] >= width) & (width < self.n)
                i, j = np.nonzero(hit & ~full[:, None])
                out.append((rows[i], ids[i, j].astype(np.int64)))
                again.append(rows[full])
            todo, width = np.concatenate(again), 2 * width
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def units(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def scaled(raw: np.ndarray) -> np.ndarray:
    """Doubles divided by a power of two each, so that no square overflows or vanishes."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def in_reach(a: Stored, b: Stored, theta: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of balls of a and b that may hold a link, and the beam that passed the audit (-1 where all nodes were read)."""
    reach = theta + a.radius + b.radius.max() + SLACK
    low = np.cos(np.minimum(reach, np.pi))
    some = np.unique(np.linspace(0, a.n - 1, min(a.n, ASKED)).astype(np.int64))
    exact = a.at[some] @ b.at.T
    want = exact >= np.cos(np.minimum(reach[some] + BEYOND, np.pi))[:, None]
    while True:
        i, j = b.reach(a.at, low, width)
        beams = b.walk(a.at[some], min(width, b.n))[0]
        got = np.zeros(want.shape, bool)
        at, place = np.nonzero(beams >= 0)
        got[at, beams[at, place]] = True
        asked = np.isin(i, some)
        got[np.searchsorted(some, i[asked]), j[asked]] = True
        if (got & want).sum() >= AUDIT * want.sum():
            return i, j, width
        if width >= b.n:
            break
        width *= 2
    pairs = [np.argwhere(a.at[k : k + BATCH] @ b.at.T >= low[k : k + BATCH, None] - 1e-5) + [k, 0] for k in range(0, a.n, BATCH)]
    i, j = np.concatenate(pairs).T
    return i, j, -1


def _linked(a: Stored, b: Stored, rows: np.ndarray, others: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each of these vectors of a is linked with each of b."""
    product = a.unit[rows] @ b.unit[others].T
    mask = product >= cosine
    for i, j in np.argwhere(np.abs(product - cosine) < EXACT):
        x, y = a.raw[rows[i]], b.raw[others[j]]
        mask[i, j] = math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= cosine
    return mask


def links_between(a: Stored, b: Stored, cosine: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """How many vectors of b each class of a is linked with, pairs of balls with a link, and the beam. b may be a: then a class counts itself."""
    theta = math.acos(cosine)
    i, j, beam = in_reach(a, b, theta, width)
    if a is b:
        own = np.arange(a.n)
        i, j = np.concatenate([i[i != j], own]), np.concatenate([j[i != j], own])
    angle = angles((a.unit[a.nodes[i]] * b.unit[b.nodes[j]]).sum(1)) if len(i) else np.zeros(0)
    wide = a.radius[i] + b.radius[j]
    whole = (angle + wide <= theta - SLACK) | ((i == j) if a is b else False)
    total = np.bincount(i[whole], b.mass[j[whole]], a.n).astype(np.int64)[a.ball]
    joined = [np.stack([i[whole], j[whole]], 1)]
    rest = ~whole & (angle - wide <= theta + SLACK)
    order = np.argsort(i[rest], kind="stable")
    i, j = i[rest][order], j[rest][order]
    cuts = np.r_[np.flatnonzero(np.diff(i, prepend=-1)), len(i)]
    for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine, balls = a.members[i[p]], j[p:q]
        hit = np.zeros(len(balls), bool)
        for at in range(0, len(mine), 1024):
            rows = mine[at : at + 1024]
            one = np.flatnonzero([len(b.members[k]) == 1 for k in balls])
            if len(one):
                mask = _linked(a, b, rows, b.nodes[balls[one]], cosine)
                total[rows] += mask @ b.weight[b.nodes[balls[one]]]
                hit[one] |= mask.any(0)
            for k in np.setdiff1d(np.arange(len(balls)), one):
                away, r = angles(a.unit[rows] @ b.unit[b.nodes[balls[k]]]), b.radius[balls[k]]
                inside = away + r <= theta - SLACK
                total[rows[inside]] += b.mass[balls[k]]
                open_ = rows[~inside & (away - r <= theta + SLACK)]
                hit[k] |= inside.any()
                for start in range(0, len(b.members[balls[k]]) if len(open_) else 0, 4096):
                    others = b.members[balls[k]][start : start + 4096]
                    mask = _linked(a, b, open_, others, cosine)
                    total[open_] += mask @ b.weight[others]
                    hit[k] |= mask.any()
        joined.append(np.stack([np.full(hit.sum(), i[p]), balls[hit]], 1))
    return total, np.concatenate(joined), beam


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Those of the pairs (of n things) that join two components of those before."""
    top, keep = list(range(n)), []

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for at, (u, v) in enumerate(pairs.tolist()):
        u, v = root(u), root(v)
        if u != v:
            top[max(u, v)] = min(u, v)
            keep.append(at)
    return pairs[keep]


NODES = "cid long, leader long, h1 long, h2 long, least long, weight long, ball long, links long"


def _build(at: str, cosine: float, alone: int):
    """Gives a row for each class of a shard's graphs, one for each label and length. Shards below `alone` hold all of their labels: links are counted
    at once, and edges follow as rows with only cid and leader. Others are written to a file."""
    half = math.acos(cosine) / 2 - SLACK

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("h1", "ascending"), ("h2", "ascending")])  # random, and the same when a task runs again
        cell, held, rows, done = key[0].as_py(), {}, [], 0
        kinds = [pa.int64()] * len(NODES.split(", "))
        names = [c.split()[0] for c in NODES.split(", ")]
        group = table["space"].to_numpy()
        for k, space in enumerate(np.unique(group)):
            part = table.filter(pa.array(group == space))
            lists = part["embedding"].combine_chunks()
            raw = scaled(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
            graph = Graph(units(raw), half)
            ids = (cell * PLACE) + done + np.arange(len(part))
            whole = graph.arrays() | {"x": raw.astype(np.float32) if pa.types.is_float32(lists.type.value_type) else raw}
            whole |= {"weight": part["weight"].to_numpy(), "first": np.array([cell * PLACE + done]), "space": np.array([space])}
            ball = np.bincount(graph.ball, minlength=graph.n)[graph.ball]
            links, edges = np.zeros(len(part), np.int64), np.zeros((0, 2), np.int64)
            if cell < alone:
                stored = Stored(whole)
                links, edges, _ = links_between(stored, stored, cosine)
                links, edges = links - 1, ids[graph.nodes[forest(edges, graph.n)]]
            else:
                held |= {f"{k}/{name}": x for name, x in whole.items()}
            columns = [ids, ids[graph.nodes[graph.ball]], *(part[c].combine_chunks() for c in ("h1", "h2", "least", "weight")), ball, links]
            rows.append(pa.Table.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], names=names))
            blank = [pa.array(edges[:, 0]), pa.array(edges[:, 1]), *(pa.nulls(len(edges), kind) for kind in kinds[2:])]
            rows.append(pa.Table.from_arrays(blank, names=names))
            done += len(part)
        if held:
            file = io.BytesIO()
            np.savez(file, **held)
            shared.put(f"{at}/{cell}", [file.getvalue()])
        return pa.concat_tables(rows)

    return run


def _load(at: str, cell: int) -> dict[int, tuple[int, Stored]]:
    """The graphs of a shard by label and length, each with its first class's number."""
    held: dict[str, dict[str, np.ndarray]] = {}
    with np.load(io.BytesIO(shared.get(f"{at}/{cell}").tobytes())) as file:
        for name in file.files:
            k, _, part = name.partition("/")
            held.setdefault(k, {})[part] = file[name]
    return {int(h["space"][0]): (int(h["first"][0]), Stored(h)) for h in held.values()}


def _tiles(at: str, cosine: float):
    """A row (u, null, links) for each class with links of a tile, and a row (u, v, null) for each edge of a spanning forest of its balls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, first, end in zip(frame["cell"], frame["first"], frame["end"], strict=True):
                mine, total, edges = _load(at, cell), {}, []
                for other in range(first, end):
                    theirs = mine if other == cell else _load(at, other)
                    for space in mine.keys() & theirs.keys():
                        (p, a), (q, b) = mine[space], theirs[space]
                        links, pairs, _ = links_between(a, b, cosine)
                        total[space] = total.get(space, 0) + links - (other == cell)
                        some = forest(pairs + [0, 0 if a is b else a.n], a.n + (0 if a is b else b.n)) - [0, 0 if a is b else a.n]
                        edges.append(np.stack([p + a.nodes[some[:, 0]], q + b.nodes[some[:, 1]]], 1))
                for space, links in total.items():
                    u = mine[space][0] + np.arange(len(links))
                    yield pd.DataFrame({"u": u, "v": pd.array([None] * len(u), "Int64"), "n": pd.array(links, "Int64")})[links > 0]
                both = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
                yield pd.DataFrame({"u": both[:, 0], "v": pd.array(both[:, 1], "Int64"), "n": pd.array([None] * len(both), "Int64")})

    return run


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _with(rows: DataFrame, table: DataFrame, on: list[str], size: str, limit: int) -> DataFrame:
    """rows left-joined with their row of the table. Table rows with more than `limit` of rows (their column size) are few, and broadcast."""
    hot = F.broadcast(table.where(F.col(size) > limit))
    cold = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(size) <= limit), on, "left")
    return rows.join(hot, on).unionByName(cold)


def linked(
    vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    at = shared.folder(spark, "near-vectors")
    embedding, same = F.col("embedding"), ["h1", "h2"]
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    fit = F.col("label").isNotNull() & F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one
    plain = F.transform(embedding, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind)))
    rows = rows.withColumn("embedding", F.when(fit, plain)).withColumn("space", F.when(fit, F.xxhash64("label", F.size("embedding"))))
    digest = lambda seed: F.when(fit, F.xxhash64(F.lit(seed), "label", "embedding"))
    rows = rows.withColumns({"h1": digest(1), "h2": digest(2)})
    classes = rows.where("space IS NOT NULL").groupBy("space", *same).agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    classes = shared.saved(classes, f"{at}/classes")

    spaces = classes.groupBy("space").agg(F.count(F.lit(1)).alias("c"), (F.sum(F.size("embedding").cast("long")) * 8).alias("bytes"))
    large = spaces.where(F.col("bytes") > shard_bytes).select("space", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("k"))
    large = [tuple(r) for r in large.orderBy("space").collect()]  # at most a row for each shard_bytes of vectors
    small = int(spaces.where(F.col("bytes") <= shard_bytes).agg(F.sum("bytes")).first()[0] or 0)
    shared_cells, starts = -(-small // max(shard_bytes // SHARED, 1)), []
    done = shared_cells
    for space, k in large:
        starts.append((space, done, k))
        done += k
    start = spark.createDataFrame(starts, "space long, base long, k long")
    alone = F.col("base") + F.pmod(F.col("h2"), F.col("k"))
    cell = F.coalesce(alone, F.pmod(F.xxhash64("space"), F.lit(max(shared_cells, 1))))
    dealt = classes.join(F.broadcast(start), "space", "left").withColumn("cell", cell).drop("base", "k")
    built = dealt.repartition(max(_parts(spark), min(done, 1 << 16)), "cell").groupBy("cell").applyInArrow(_build(f"{at}/shards", cosine, shared_cells), NODES)
    built = shared.saved(built, f"{at}/built")
    nodes, near = built.where("h1 IS NOT NULL"), built.where("h1 IS NULL").select(F.col("cid").alias("u"), F.col("leader").alias("v"))
    tiles = start.select(F.explode(F.sequence(F.col("base"), F.col("base") + F.col("k") - 1)).alias("cell"), "base", "k")
    tiles = tiles.select("cell", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("k") - 1, F.lit(ACROSS))).alias("first"), "base", "k")
    tiles = shared.saved(tiles.select("cell", "first", F.least(F.col("first") + ACROSS, F.col("base") + F.col("k")).alias("end")), f"{at}/tiles")
    found = tiles.repartition(max(_parts(spark), min(tiles.count(), 1 << 16)), "cell", "first").mapInPandas(_tiles(f"{at}/shards", cosine), "u long, v long, n long")
    found = shared.saved(found, f"{at}/found")

    joined = components(found.where("v IS NOT NULL").select("u", "v").unionByName(near))
    balls = nodes.where("cid = leader").select("leader", "ball").join(joined.select(F.col("u").alias("leader"), F.col("v").alias("comp")), "leader", "left")
    balls = balls.withColumn("comp", F.coalesce("comp", "leader"))
    total = nodes.count()
    links = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n_links"))
    named = shared.saved(_with(nodes.drop("ball"), balls, ["leader"], "ball", max(total // 4096, 256)), f"{at}/named")
    least = shared.saved(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), f"{at}/least")
    named = _with(named, least, ["comp"], "members", max(total // 4096, 256)).join(links, "cid", "left")
    named = shared.saved(named.select(*same, "weight", "component_id", (F.col("links") + F.coalesce("n_links", F.lit(0))).alias("n_links")), f"{at}/answers")
    wanted = rows.where("h1 IS NOT NULL").select("vec_id", *same)
    out = _with(wanted, named, same, "weight", max((nodes.agg(F.sum("weight")).first()[0] or 0) // 4096, 256)).select("vec_id", "n_links", "component_id")
    rest = rows.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def deduplicated(vectors: DataFrame, **parameters) -> DataFrame:
    """The rows whose vec_id names its component, as they are."""
    some = linked(vectors, **parameters).where("kept AND vec_id IS NOT NULL").select(F.col("vec_id").alias("_kept")).distinct()
    return vectors.join(some, F.col("vec_id").eqNullSafe(F.col("_kept")), "left_semi")
