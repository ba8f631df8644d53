"""Bracketing, sketched quality control, database ranges, staged sinks and footers."""

import datetime as dt
import json
import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from statloom.operators import describe, difference, ranks, selection, shape
from statloom.sources import database, footers, sinks, tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def hard_groups():
    """Groups that a bracket may go wrong on."""
    rng = np.random.default_rng(11)
    return {
        1: rng.normal(size=700),
        2: np.r_[np.full(500, 3.25), rng.normal(size=100)],  # one value above all
        3: np.r_[rng.integers(0, 5, 600), 1e300, -1e300, 5e-324, 0.0, -0.0],
        4: np.exp(rng.uniform(-600, 600, 500)) * rng.choice([-1, 1], 500),  # hundreds of magnitudes on both sides
        5: np.r_[rng.normal(size=300), [math.inf] * 40, [-math.inf] * 50, [math.nan] * 60],
        6: np.array([math.nan] * 120),
        7: np.array([7.5]),
        8: np.r_[1.7e308, -1.7e308, rng.normal(size=200)],
        9: 1e15 + rng.integers(0, 3, 400) * 0.125,
        None: rng.exponential(size=333),
    }


@pytest.mark.parametrize("whole", [1 << 20, 100, 0])
@pytest.mark.parametrize("cuts", [4096, 3])
def test_values_at_places(spark, monkeypatch, whole, cuts):
    """Small groups only, both kinds, and large ones only; few cuts leave many values for the last step."""
    monkeypatch.setattr(selection, "WHOLE", whole), monkeypatch.setattr(selection, "CUTS", cuts)
    groups = hard_groups()
    data = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [(1, None, "y")] * 5 + [(99, None, "y")]
    df = spark.createDataFrame(data, "k int, v double, other string").repartition(3)
    places = selection.median_places() | {f"q{q}": selection.nearest(q / 100) for q in (0, 10, 25, 75, 100)}
    got = {r["k"]: r for r in selection.values_at(df, ["k"], "v", places).collect()}
    assert set(got) == set(groups)
    order = lambda x: (math.isnan(x), x)
    for k, vs in groups.items():
        s, n = sorted(map(float, vs), key=order), len(vs)
        want = {"_low": s[(n - 1) // 2], "_high": s[n // 2]} | {f"q{q}": s[math.floor((n - 1) * (q / 100) + 0.5)] for q in (0, 10, 25, 75, 100)}
        assert got[k]["n"] == n
        for name, x in want.items():
            assert got[k][name] == x or (math.isnan(x) and math.isnan(got[k][name])), (k, name)
    rows = selection.with_values_at(df, ["k"], "v", selection.median_places()).collect()
    assert len(rows) == sum(map(len, groups.values())) and rows[0].asDict().keys() == {"k", "v", "other", "n", "_low", "_high"}
    assert all(r["_low"] == got[r["k"]]["_low"] or math.isnan(r["_low"]) for r in rows)


def test_no_values_and_no_keys(spark, monkeypatch):
    none = spark.createDataFrame([], "k int, v double")
    assert selection.values_at(none, ["k"], "v", selection.median_places()).count() == 0
    for whole in (1 << 20, 10):
        monkeypatch.setattr(selection, "WHOLE", whole)
        one = selection.values_at(spark.range(101).select(F.col("id").alias("v")), [], "v", selection.median_places()).collect()
        assert [tuple(r) for r in one] == [(101, 50.0, 50.0)] or one[0].asDict() == {"n": 101, "_low": 50.0, "_high": 50.0}


def test_large_groups_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Of 200,000 rows in one group, only counts of brackets cross an exchange."""
    monkeypatch.setattr(selection, "WHOLE", 1000)
    spark.range(200_000).select(F.lit(1).alias("k"), F.rand(3).alias("v")).write.parquet(str(tmp_path / "t"))
    df = selection.values_at(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", selection.median_places())
    low = df.collect()[0]["_low"]
    values = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "t")).select("v").collect())
    assert low == values[99_999]
    seen, todo, written = set(), [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(plan.plan())
            continue
        if name == "Exchange" and plan.id() not in seen:
            seen.add(plan.id())
            written.append(plan.metrics().apply("shuffleRecordsWritten").value())
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert written and max(written) < 40_000, written


def test_ranks_without_a_count_first(spark, monkeypatch):
    """Large and small groups in one table."""
    monkeypatch.setattr(ranks, "PER_RANGE", 50), monkeypatch.setattr(ranks, "CUTS", 8)
    rng = np.random.default_rng(12)
    groups = {1: rng.integers(0, 900, 2000), 2: rng.integers(0, 30, 200), None: rng.integers(0, 300, 500)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k int, v double")
    got = ranks.value_ranks(df, ["k"], "v", medians=("cnt",)).collect()
    assert len(got) == sum(len(set(vs.tolist())) for vs in groups.values())
    for r in got:
        vs = groups[r["k"]]
        assert (r["before"], r["cnt"], r["n"], r["least"], r["med_cnt"]) == ((vs < r["v"]).sum(), (vs == r["v"]).sum(), len(vs), vs.min(), np.median(vs))


def test_tests_by_brackets_agree(spark, monkeypatch):
    rng = np.random.default_rng(13)
    data = [(t, float(v), g) for t in range(4) for g, m in (("P", 0), ("M", 1)) for v in rng.normal(m, 1 + t, 90).round(2)]
    df = spark.createDataFrame(data, "trait_id int, trait_value double, origin string")
    whole = [sorted(map(tuple, f(df, "trait_value").collect())) for f in (difference.levene, difference.fligner)]
    box = shape.box_statistics(df, "trait_value").collect()
    monkeypatch.setattr(selection, "WHOLE", 20)
    for f, want in zip((difference.levene, difference.fligner), whole, strict=True):
        got = sorted(map(tuple, f(df, "trait_value").collect()))
        assert all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))
    assert shape.box_statistics(df, "trait_value").collect() == box


def _exchanges(df):
    """Records written and partitions of each exchange of a frame that was collected."""
    seen, todo, out = set(), [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(plan.plan())
        else:
            if name == "Exchange" and plan.id() not in seen:
                seen.add(plan.id())
                out.append((plan.metrics().apply("shuffleRecordsWritten").value(), plan.outputPartitioning().numPartitions()))
            todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return out


@pytest.mark.parametrize("name", ["fligner", "levene", "shapiro", "mann_whitney"])
def test_small_groups_are_dealt_once(spark, monkeypatch, tmp_path, name):
    """Rows of small groups cross one exchange, whose partitions grow in number with the input; a large group among them changes nothing."""
    at, f = str(tmp_path / "t"), getattr(difference, name)
    trait = F.when(F.col("id") < 30_000, F.col("id") % 1000).otherwise(-1)  # one of 5,000 rows, and 1,000 of 30
    rows = spark.range(35_000).select(trait.alias("trait_id"), F.rand(5).alias("trait_value"), F.when(F.rand(6) < 0.5, "P").otherwise("M").alias("origin"))
    rows.coalesce(1).write.parquet(at)
    df = spark.read.parquet(at)
    want = {r[0]: tuple(r) for r in f(df, "trait_value").collect()}
    for module, most in ((selection, "WHOLE"), (ranks, "PER_RANGE")):
        monkeypatch.setattr(module, most, 1000)
    monkeypatch.setattr(tables, "TASK_BYTES", 20_000)
    size = sum(os.path.getsize(f"{at}/{x}") for x in os.listdir(at) if x.endswith(".parquet"))
    for part, groups in ((df.where("trait_id >= 0"), 1000), (df, 1001)):
        tested = f(part, "trait_value")
        got = {r[0]: tuple(r) for r in tested.collect()}
        assert len(got) == groups and all(x == pytest.approx(want[k], nan_ok=True) for k, x in got.items())
        if groups == 1000:
            wide = [n for records, n in _exchanges(tested) if records >= 29_000]
            assert len(wide) == 1 and wide[0] >= size / 20_000 > 4


@pytest.mark.parametrize("large", [1 << 16, 500])
def test_quality_control_at_the_line(spark, monkeypatch, large):
    """Groups of 1,000 rows with 49, 50 and 51 distinct values (4.9, 5.0 and 5.1 %), one far above the line, a small one, and a null group."""
    monkeypatch.setattr(describe, "LARGE", large)
    data = [(g, i % d) for g, d in ((49, 49), (50, 50), (51, 51), (600, 600)) for i in range(1000)] + [(5, i) for i in range(399)] + [(6, i) for i in range(400)]
    df = spark.createDataFrame(data + [(None, 1)], "g int, v int").repartition(3)
    kept, gone = describe.quality_control(df, "g", "v")
    assert {r[0]: r[1] for r in kept.groupBy("g").count().collect()} == {50: 1000, 51: 1000, 600: 1000, 6: 400}
    assert {r["g"]: (r["count"], r["ratio"]) for r in gone.where("g IS NOT NULL").collect()} == {49: (1000, pytest.approx(4.9)), 5: (399, 100.0)}
    settled = {r["g"]: r["stays"] for r in describe.settled(df, "g", "v", 400, 5.0).collect()}
    assert settled == ({} if large == 1 << 16 else {49: False, 50: False, 51: False, 600: True})  # near the line exact counts decide


def test_a_hot_group_is_settled_by_its_sketch(spark):
    """A group of ten million values is counted by a sketch and not expanded."""
    hot = spark.range(10_000_000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    few = spark.range(1000).select(F.lit(2).alias("g"), (F.col("id") % 3).alias("v"))
    kept, gone = describe.quality_control(hot.unionByName(few), "g", "v")
    assert [(r["g"], r["count"]) for r in gone.collect()] == [(2, 1000)]
    assert [tuple(r) for r in kept.groupBy("g").count().collect()] == [(1, 10_000_000)]


def test_database_ranges_of_kinds(spark):
    """Numbers, dates and timestamps, nulls, one value above all: no range above twice the mean but a single value's."""
    rng = np.random.default_rng(14)
    n = 6000
    day = [dt.date(1992, 1, 1) + dt.timedelta(int(x)) for x in rng.exponential(300, n)]
    rows = [(i, float(rng.pareto(1)), day[i], dt.datetime(2020, 1, 1) + dt.timedelta(seconds=float(rng.exponential(1e5))), int(x), None if i % 7 else i, None) for i, x in
            enumerate(np.where(rng.random(n) < 0.4, 5, rng.integers(0, 10**6, n)))]
    url, options = f"jdbc:derby:memory:kinds{os.getpid()};create=true", {"driver": DRIVER}
    df = spark.createDataFrame(rows, "id int, skewed double, d date, ts timestamp, hot long, gaps int, none int")
    df.coalesce(2).write.format("jdbc").options(url=url, dbtable="kinds", batchsize="2000", **options).save()
    ask = lambda sql: spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) a", **options).load().collect()
    for column, single in (("id", 0), ("skewed", 0), ("d", 0), ("ts", 0), ("hot", 1), ("gaps", 0)):
        ranges = database.balanced_ranges(ask, "SELECT * FROM kinds", f'"{column}"', 16)
        counts = [c for c, condition in ranges if "NULL" not in condition]
        known = sum(r[df.columns.index(column)] is not None for r in rows)
        assert sum(counts) == known and sum(c > 2 * known / 16 for c in counts) == single, (column, counts)
        assert 10 <= len(counts) <= 33
        back = database.read_database(spark, url, "SELECT * FROM kinds", f'"{column}"', 16, **options)
        assert back.rdd.getNumPartitions() == len(ranges)
        assert back.count() == n and back.select("id").distinct().count() == n, column
    assert database.read_database(spark, url, "SELECT * FROM kinds", '"none"', 16, **options).count() == n  # no value at all
    assert database.read_database(spark, url, 'SELECT * FROM kinds WHERE "id" < 0', '"id"', 16, **options).count() == 0
    with pytest.raises(ValueError):
        database._between("a", "b", 4)


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    at = str(tmp_path / "result")
    sinks.write(spark.range(5), at)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write(bad, at)
    assert sorted(r[0] for r in spark.read.parquet(at).collect()) == list(range(5)) and os.listdir(tmp_path) == ["result"]
    sinks.write(spark.read.parquet(at).where("id > 2"), at)  # from itself: it's read before it's replaced
    assert sorted(r[0] for r in spark.read.parquet(at).collect()) == [3, 4] and os.listdir(tmp_path) == ["result"]
    assert sinks.write(spark.range(1), str(tmp_path), name="tmp.parquet") == str(tmp_path / "tmp.parquet")


def test_a_write_that_loses_rows_is_refused(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "result")
    sinks.write(spark.range(3), at)
    seen = type("Wrong", (), {"get": {"rows": 9}})
    monkeypatch.setattr(sinks, "Observation", lambda: real)
    from pyspark.sql import Observation

    real = Observation()
    monkeypatch.setattr(type(real), "get", property(lambda self: seen.get))
    with pytest.raises(OSError, match="4 of 9"):
        sinks.write(spark.range(4), at)
    assert spark.read.parquet(at).count() == 3 and os.listdir(tmp_path) == ["result"]


def test_sorted_layout_skips_row_groups(spark, tmp_path):
    """A trait's filter meets few row groups of a sorted result, by its footers, and nearly all of an unsorted one."""
    df = spark.range(200_000).select((F.xxhash64("id") % 1000).alias("trait_id"), F.rand(1).alias("v"), F.col("id"))
    met = {}
    for name, sort in (("sorted", ["trait_id", "id"]), ("plain", [])):
        at = sinks.write(df, str(tmp_path / name), sort=sort, file_bytes=1 << 20, row_group_bytes=200_000)
        groups = footers.row_groups(spark, [at], "trait_id").collect()
        assert sum(r["rows"] for r in groups) == 200_000 and len(groups) > 4
        met[name] = sum(json.loads(r["least"]) <= 17 <= json.loads(r["most"]) for r in groups) / len(groups)
    assert met["sorted"] < 0.4 and met["plain"] == 1.0


def test_footers_of_many_files(spark, tmp_path):
    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    paths = [str(tmp_path / f"{k}.parquet") for k in range(2000)]
    for k, p in enumerate(paths):
        pq.write_table(table if k not in (700, 1900) else pa.table({"a": [1.5], "b": ["x"]}) if k == 700 else table.append_column("c", [[1, 2]]), p)
    known = footers.read(spark, paths)
    assert known.agg(F.sum("rows")).first()[0] == 2000 * 2 - 1 and known.count() == 2000
    wrong = {os.path.basename(r["file"]): (r["expected"], r["found"]) for r in footers.mismatches(known).collect()}
    assert wrong == {"700.parquet": ("a int64, b string", "a double, b string"), "1900.parquet": ("a int64, b string", "a int64, b string, c int64")}
    with pytest.raises(ValueError, match=r"700\.parquet.*double"):
        tables.scan_many(spark, paths)
    good = [p for k, p in enumerate(paths) if k not in (700, 1900)]
    with pytest.warns(UserWarning, match="nowhere"):
        assert tables.scan_many(spark, [*good[:50], str(tmp_path / "nowhere"), *good[50:]]).count() == 3996
    sinks.write(spark.range(7), str(tmp_path / "folder"))
    (one,) = footers.read(spark, [str(tmp_path / "folder"), f"file://{tmp_path}/none"]).where("file IS NULL").collect()
    assert one["path"].endswith("none") and one["rows"] is None


def test_box_cox_on_a_summary(spark):
    """The summary's lambda is that of exact passes, for values on both sides of zero, wide ranges and outliers."""
    rng = np.random.default_rng(15)
    for x in (rng.lognormal(0, 2, 5000), rng.normal(5, 1, 5000), rng.exponential(1, 5000) - 0.5, np.r_[rng.gamma(2, 2, 5000), 1e9], 1 / rng.gamma(3, 1, 5000)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        shifted = x if x.min() > 0 else x - x.min() + 1e-6
        logs = np.log(shifted)
        z = logs - logs.mean()

        def llf(k, z=z):
            return -len(z) / 2 * math.log((z if k == 0 else np.expm1(k * z) / k).var())

        lam = shape.box_cox(df, "v")[1]
        assert llf(lam) >= max(llf(lam - 1e-4), llf(lam + 1e-4))
    out, lam = shape.box_cox(spark.createDataFrame([(1.0,), (2.0,), (5.0,), (math.nan,), (math.inf,), (None,)], "v double"), "v", digits=2)
    assert lam == round(lam, 2) and out.where("v_boxcox IS NULL").count() == 1


def test_pictures(spark, tmp_path):
    """Both formats are whole files with all bars, points and texts; endings and sizes are kept to."""
    import re
    import xml.etree.ElementTree as tree
    import zlib

    from statloom.operators import figure

    df = spark.range(3000).select((F.randn(4) * 3 + 10).alias("v")).unionByName(spark.createDataFrame([(90.0,), (math.nan,), (None,)], "v double"))
    path = figure.draw(df, "v", str(tmp_path / "deep" / "one.svg"), "A & B <1>", 9, 4)
    root = tree.parse(path).getroot()
    count = lambda tag: len(root.findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    assert root.get("width") == "648pt" and root.get("height") == "288pt" and count("circle") >= 256
    bars = [p for p in root.iter() if p.get("fill") == figure.BAR]
    assert len(bars) == 30 and "A & B <1>" in [t.text for t in root.iter() if t.tag.endswith("text")]
    path = figure.draw(df, "v", str(tmp_path / "two"), "plain (title)")
    assert path.endswith("two.pdf")
    raw = (tmp_path / "two.pdf").read_bytes()
    start = int(re.search(rb"startxref\n(\d+)", raw)[1])
    assert raw[start : start + 4] == b"xref"
    for k, place in enumerate(re.findall(rb"(\d{10}) 00000 n", raw), 1):
        assert raw[int(place) :].startswith(f"{k} 0 obj".encode())
    size = int(re.search(rb"/Length (\d+)", raw)[1])
    ops = zlib.decompress(raw[raw.index(b"stream\n") + 7 :][:size]).decode("latin-1")
    assert "(plain \\(title\\)) Tj" in ops and ops.count(" c ") >= 3 * 256 and b"/MediaBox [0 0 864 720]" in raw
    with pytest.raises(ValueError, match="png"):
        figure.draw(df, "v", str(tmp_path / "three.png"))
    for few in (df.where("v IS NULL"), spark.createDataFrame([(5.0,)], "v double")):  # nothing to draw, one value
        tree.parse(figure.draw(few, "v", str(tmp_path / "four.svg")))
    assert figure.ticks(0, 1) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0]) and figure.ticks(3, 3) == [3]


def test_picked_points(spark, monkeypatch):
    df = spark.range(5000).select(F.pow(F.col("id").cast("double"), 2).alias("v")).repartition(4)
    whole = {r["i"]: tuple(r) for r in shape.qq_points(df, "v").collect()}
    for most in (1 << 20, 100):
        monkeypatch.setattr(selection, "WHOLE", most)
        got = shape.qq_picked(df, "v", 64).orderBy("i").collect()
        assert len(got) == 64 and got[0]["i"] == 1 and got[-1]["i"] == 5000
        assert all(tuple(r) == pytest.approx(whole[r["i"]]) for r in got)
        assert shape.qq_picked(df.limit(10), "v", 64).count() == 10


def test_first_in_file_order(spark, tmp_path):
    """A pivot over files whose splits are read out of order: a short file comes first by name and is read last, and files are split."""
    part = lambda name, rows: sinks.write(spark.createDataFrame(rows, "id int, g string, v long").coalesce(1), str(tmp_path / name), one_file=True)
    short, long_ = part("a", [(1, "x", 1), (2, "x", 2)]), part("b", [(k % 5, "x", 1000 + k) for k in range(60_000)])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        both = spark.read.parquet(short, long_)
        assert both.withColumn("at", F.monotonically_increasing_id()).select(F.min_by("v", "at")).first()[0] != 1  # the order of reading is another
        from statloom.operators import rows as reshape

        got = {r["id"]: r["x"] for r in reshape.long_to_wide(both, ["id"], ["g"], ["v"]).collect()}
        assert got == {0: 1000, 1: 1, 2: 2, 3: 1003, 4: 1004}
        for order, one in (([short, long_], 1), ([long_, short], 1001)):
            listed = tables.scan_many(spark, order, order="at")
            got = {r["id"]: r["x"] for r in reshape.long_to_wide(listed, ["id"], ["g"], ["v"], order="at").collect()}
            assert got[1] == one and got[0] == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_window_reasons(spark):
    from statloom.operators import variance

    rows = [(1, 0, g, v) for g, v in (("P", 1.0), ("M", 2.0), ("P", 3.0))] + [(1, 1, "X", 1.0), (1, 1, "P", 2.0)] + [(1, 2, "P", 1.0), (1, 2, "X", None)]
    rows += [(1, 3, "P", 2.0), (1, 3, "M", 2.0)] + [(1, 4, "P", None)] + [(1, 9, "P", 1.0)] + [(7, 0, "P", 1.0)]
    df = spark.createDataFrame([(c, w, 1, g, v) for c, w, g, v in rows], "chra int, windowa int, trait_id int, origin string, v double")
    sizes = spark.createDataFrame([(1, 6), (2, 1), (3, 0)], "chra int, windows int")
    got = {(r["chra"], r["windowa"]): (r["rows"], r["reason"]) for r in variance.window_reasons(df, "v", windows=sizes).collect()}
    assert got == {
        (1, 0): (3, None), (1, 1): (2, "unknown group"), (1, 2): (2, "one group"), (1, 3): (2, "constant"), (1, 4): (1, "no values"),
        (1, 5): (0, "no rows"), (2, 0): (0, "no rows"), (1, 9): (1, "no dictionary row"), (7, 0): (1, "no dictionary row"),
    }
    done = {(r["chra"], r["windowa"]) for r in variance.anova(df, "v").collect()}
    assert done == {k for k, (n, reason) in got.items() if n and reason in (None, "one group", "constant", "no dictionary row")}


def test_pivot_of_files_holds_no_paths(spark, tmp_path):
    """Rows are ordered by a long, so that numbers are hashed, not sorted, and none carries its file's path; nulls and strings as before."""
    from statloom.operators import rows as reshape

    data = [("b b", [(1, "x", None, None), (1, "x", 5.0, "s"), (2, "y", 6.0, "t")]), ("a", [(1, "x", 7.0, "u"), (3, "x", 8.0, "v"), (3, "x", 9.0, "w")])]
    paths = [sinks.write(spark.createDataFrame(part, "id int, g string, v double, s string").coalesce(1), str(tmp_path / name)) for name, part in data]
    listed = tables.scan_many(spark, paths, order="at")
    assert dict(listed.dtypes)["at"] == "bigint" and [r["v"] for r in listed.orderBy("at").collect()] == [None, 5.0, 6.0, 7.0, 8.0, 9.0]
    wide = reshape.long_to_wide(listed, ["id"], ["g"], ["v"], order="at", names=["x", "y"])
    assert sorted(map(tuple, wide.collect())) == [(1, None, None), (2, None, 6.0), (3, 8.0, None)]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    texts = reshape.long_to_wide(spark.read.parquet(*paths), ["id"], ["g"], ["s"])  # by name: a first
    assert sorted(map(tuple, texts.collect())) == [(1, "u", None), (2, None, "t"), (3, "v", None)]


def test_sorted_files_are_small(spark, monkeypatch, tmp_path):
    """A task sorts a whole file, so sorted files are a fourth of others by default."""
    df = spark.read.parquet(sinks.write(spark.range(100_000), str(tmp_path / "t")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert sinks.SORTED_BYTES * 4 <= sinks.FILE_BYTES
    monkeypatch.setattr(sinks, "SORTED_BYTES", -(-size // 4))
    at = sinks.write(df.select(F.col("id").alias("id")), str(tmp_path / "sorted"), sort=["id"])
    assert sum(x.endswith(".parquet") for x in os.listdir(at)) == 4
