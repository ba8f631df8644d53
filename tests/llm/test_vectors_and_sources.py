"""Embedding near-dedup, importance resampling and the divergence audit, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import divergence, embedding_dedup, importance

VECTORS = "vec_id bigint, embedding array<double>, label int, more string"


def plain_links(rows, cosine):
    """n_links, component and kept of each row, by all pairs."""

    def usable(r):
        return r[2] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    def near(a, b):
        x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= cosine

    n, links = len(rows), defaultdict(set)
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and near(a[1], b[1]):
                links[i].add(j), links[j].add(i)
    comp = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        comp[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return sorted(((r[0], len(links[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)), key=repr)


def vectors(seed=1, size=12):
    rng = np.random.default_rng(seed)
    rows = []
    for label, n in ((1, 120), (2, 40), (3, 1), (None, 3)):
        base = rng.normal(size=(n, size))
        base[n // 2 :] = base[rng.integers(0, max(n // 8, 1), n - n // 2)] + 0.12 * rng.normal(size=(n - n // 2, size))  # chains and groups
        rows += [(int(v), [float(x) for x in e], label, "x") for v, e in zip(rng.permutation(10**6)[:n], base, strict=True)]
    hot = [float(x) for x in rng.normal(size=size)]
    rows += [(2_000_000 + k, hot, 1, "x") for k in range(60)]  # copies
    rows += [(3_000_000 + k, [x * (1 + 0.01 * rng.normal()) for x in hot], 1, "x") for k in range(40)]
    rows += [
        (5, None, 1, "x"),
        (6, [], 1, "x"),
        (7, [0.0, -0.0], 1, "x"),
        (8, [1.0, None], 1, "x"),
        (9, [1.0, math.nan], 1, "x"),
        (10, [math.inf, 1.0], 1, "x"),
        (11, [1.0, 0.0], 1, "x"),
        (12, [1e200, -0.0], 1, "x"),
        (13, [1e-200, 0.0], 1, "x"),
        (14, [1.0, 0.0], 2, "x"),
        (15, [0.93 + 1e-10, math.sqrt(1 - 0.93**2)], 1, "x"),
        (17, [0.93 - 1e-10, -math.sqrt(1 - 0.93**2)], 1, "x"),
        (None, [0.0, 1.0], 4, "x"),
        (None, [0.0, 1.0], 4, "x"),
        (16, [0.0, 5.0], 5, "x"),
        (16, [0.0, 5.0], 5, "x"),
        (16, [1.0, 5.0], 5, None),
        (None, [0.0, 5.0], 5, "x"),
    ]
    return rows


@pytest.mark.parametrize("shard", [8 << 20, 12 * 8 * 24])
def test_links_and_components(spark, monkeypatch, shard):
    """One shard a label, and many: of 24 vectors, two at a time."""
    monkeypatch.setattr(embedding_dedup, "ACROSS", 2)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = embedding_dedup.linked(df, shard_bytes=shard)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_links(rows, embedding_dedup.COSINE)


def test_links_of_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.linked(none).count() == 0 and embedding_dedup.deduplicated(none).columns == none.columns
    only_bad = spark.createDataFrame([(1, None, 1, "x"), (2, [0.0], 1, "x"), (3, [1.0], None, "x")], VECTORS)
    assert sorted(map(tuple, embedding_dedup.linked(only_bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.01], 1, "b"), (3, [0.0, 1.0], 1, "c")]
    wide = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int, more string")
    wide = wide.withColumns({c: F.lit(7) for c in ("space", "h1", "H2", "cid", "leader", "least", "n_links", "Component_ID", "kept", "cell", "weight")})
    got = embedding_dedup.deduplicated(wide)
    assert got.columns == wide.columns and sorted(r["more"] for r in got.collect()) == ["a", "c"]


def test_graph_finds_what_is_in_reach():
    """Beams that are too narrow fail the audit and are widened; a graph without its links is read whole."""
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(3000, 24))
    raw[1500:] = raw[rng.integers(0, 300, 1500)] + 0.15 * rng.normal(size=(1500, 24))
    unit = embedding_dedup.units(raw)
    graph = embedding_dedup.Graph(unit, math.acos(0.93) / 2 - embedding_dedup.SLACK)
    assert len(graph.layers) == 3 and graph.n < 3000  # near copies are balls
    held = graph.arrays() | {"x": raw, "weight": np.ones(3000, np.int64)}
    stored = embedding_dedup.Stored(held)
    assert sum(map(len, stored.members)) == 3000 and stored.mass.sum() == 3000
    away = np.arccos(np.clip((unit * unit[stored.nodes[stored.ball]]).sum(1), -1, 1))
    assert (away <= stored.radius[stored.ball] + 1e-7).all() and stored.radius.max() <= math.acos(0.93) / 2
    want = (unit @ unit.T >= 0.93).sum(1)
    n, pairs, beam = embedding_dedup.links_between(stored, stored, 0.93)
    assert (n == want).mean() > 0.999 and 0 <= want.sum() - n.sum() <= 0.001 * want.sum() and beam >= embedding_dedup.BEAM
    n, _, wide = embedding_dedup.links_between(stored, stored, 0.93, width=2)
    assert wide > 2 and want.sum() - n.sum() <= 0.01 * want.sum()
    lost = embedding_dedup.Stored(held | {f"layer{k}": np.full_like(x, -1) for k, x in enumerate(graph.layers)})
    n, pairs, beam = embedding_dedup.links_between(lost, lost, 0.93)
    assert beam == -1 and (n == want).all()
    some = embedding_dedup.forest(pairs, graph.n)
    assert len(some) < graph.n


def test_work_of_near_copies_is_not_their_square():
    """20,000 near copies are some nodes; without balls they would be 200 million links to find one by one."""
    rng = np.random.default_rng(4)
    raw = rng.normal(size=32) + 0.05 * rng.normal(size=(20_000, 32))
    graph = embedding_dedup.Graph(embedding_dedup.units(raw), math.acos(0.93) / 2 - embedding_dedup.SLACK)
    stored = embedding_dedup.Stored(graph.arrays() | {"x": raw, "weight": np.ones(len(raw), np.int64)})
    n, pairs, _ = embedding_dedup.links_between(stored, stored, 0.93)
    assert graph.n < 50 and len(pairs) < 2500 and (n == len(raw)).all()


def texts(seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 60}"
    some = [" ".join(word() for _ in range(n)) for n in (25, 40, 19, 20, 60, 3, 30, 2000)]
    return [None, "", "... --", *some, some[0], "Ünï İ ß x9 9x a-b" * 6, "A" * 5000 + " " + "z " * 30]


DOCS = "doc_id bigint, text string, lang string, source string, score string"


def plain_weights(docs, target, longest, buckets):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for d in docs:
        s.update(features(d[1])[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d in docs:
        w, f = features(d[1])
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_resampling(spark, monkeypatch, longest):
    """Slices of a few texts and groups of one slice, so that every part is salted; ids that repeat or are null, equal rows, ties."""
    monkeypatch.setattr(importance, "SLICE", 300), monkeypatch.setattr(importance, "GROUP", 1)
    rows = [(i % 17, t, "en", "a", "s") for i, t in enumerate(texts() * 3)] + [(None, texts()[3], "en", "a", "s")] * 3
    target = [texts()[3], None, "", "w1 w2 never"]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    aim = spark.createDataFrame([(1, t) for t in target], "item_id int, text string")
    got = [tuple(r) for r in importance.drawn(df, aim, percent=40, longest=longest, buckets=97).collect()]
    want = plain_weights(rows, target, longest, 97)
    assert sorted((g[:4] for g in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    fit = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    take = [w[:4] for w in fit[: len(fit) * 40 // 100]]
    ranked = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
    assert [g[:4] for g in ranked] == take and [g[4] for g in ranked] == list(range(1, len(take) + 1)) and take
    kept = importance.resampled(df, aim, percent=40, longest=longest, buckets=97)
    ids = {w[0] for w in take} - {None}
    assert sorted(map(tuple, kept.select(*df.columns).collect()), key=repr) == sorted((r for r in rows if r[0] in ids), key=repr)


def test_importance_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(["a"] * 30), "", "", ""), (2, None, "", "", "")], DOCS)
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.drawn(none, docs.select("text")).count() == 0
    got = {r["doc_id"]: r for r in importance.drawn(docs, nothing, percent=100).collect()}
    gain = math.floor(1000 * math.log(1 * (30 + 10_000) / (31 * 10_000)))
    assert got[1]["weight"] == 30 * gain and got[1]["rank"] == 1 and got[2]["weight"] == 0 and got[2]["rank"] is None


def test_packed_numbers():
    for x in ([], [0], [127], [-128], [128], [40_000], [-(2**31)], [2**62, -5], [3, 2, 1]):
        assert importance.unpacked(importance.packed(np.array(x, np.int64))).tolist() == x
    assert len(importance.packed(np.arange(100))) == 101


def plain_audit(docs, least, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, _ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        count[lang, source].update(term(t))
        held[lang].update(set(term(t)))
    out = []
    share = lambda c, n, v: 1 + math.floor(Fraction(1_000_000_000 * (c + 5), n + 5 * v))
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in held[lang].items() if d >= least]
        own = {s: count[lang, s] for g, s in groups if g == lang}
        n = {s: sum(c[t] for t in kept) for s, c in own.items()}
        total = Counter()
        for c in own.values():
            total.update({t: c[t] for t in kept})
        p = {s: {t: share(own[s][t], n[s], len(kept)) for t in kept} for s in own}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            more = [(p[s][t] - share(total[t], sum(n.values()), len(kept)), t) for t in kept if own[s][t]]
            more = sorted((-v, t.encode(), t) for v, t in more if v > 0)[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(more)]
    return sorted(out)


def audited(seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ä", None])
        words = [rng.choice(["Alpha", "beta", "gamma7delta", "Ünï", "x", f"rare{rng.randrange(40)}", rng.choice("pqrstuv") * 3]) for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(words) if i % 11 else None, lang, source, "s"))
    rows += [(1000, None, "only", "empty", "s"), (1001, "", "only", "other", "s"), (1002, "solo " * 9, "one", "alone", "s")] + [rows[5]] * 3
    return rows


@pytest.mark.parametrize("ties", [1024, 0])
def test_divergence(spark, monkeypatch, ties):
    """ties 0: every tie at the threshold is narrowed by bytes of the terms."""
    monkeypatch.setattr(divergence, "SLICE", 400)
    rows = audited()
    real = divergence.largest
    monkeypatch.setattr(divergence, "largest", lambda *a, **k: real(*a, ties=ties))
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), least=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    got = divergence.audit(spark.createDataFrame([(1, None, None, "a", ""), (2, "few", "", None, "")], DOCS)).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_radix_selection(spark, tmp_path):
    """Long items with equal beginnings, values at the ends of their range, groups that are smaller than k, all at once."""
    rng = random.Random(9)
    rows = [("a", "p" * 5 + "".join(rng.choice("aäb") for _ in range(rng.randrange(1, 9))), v) for v in (7, 7, 7, 2**30 - 1, 0, 1 << 20) for _ in range(150)]
    rows = list({(g, t): (g, t, v) for g, t, v in rows}.values()) + [("b", "x", 5), ("b", "y", 5), ("c", "", 0)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for ties in (0, 3, 10_000):
        got = divergence.largest(df, ["g"], "value", "item", 20, str(tmp_path / f"t{ties}"), ties)
        want = [(g, *x, k + 1) for g in "abc" for k, x in enumerate(sorted(((t, v) for h, t, v in rows if h == g), key=lambda x: (-x[1], x[0].encode()))[:20])]
        assert sorted(map(tuple, got.select("g", "item", "value", "rank").collect())) == sorted(want)


def test_shares_are_exact(spark):
    rows = [(0, 0, 1), (10**18, 10**18 + 7, 3), (3, 9, 2), (123_456_789_012, 999_999_999_999, 1_000_000), (5, 5, 0)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + (1_000_000_000 * (c + 5)) // (n + 5 * v) if v else None for c, n, v in rows]


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_importance_resampling", "op13_source_divergence"])
def test_sql_of_new_queries(spark, name):
    import glob
    import os

    import duckdb

    from statloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    mine = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(mine.columns)
    want = con.sql(f'SELECT {", ".join(cols)} FROM ({SQL[name]})').fetchall()
    assert sorted(repr(tuple(r)) for r in mine.select(cols).collect()) == sorted(map(repr, want))
