import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import tails
from statloom.functions.columns import divide, inverse_normal, origin
from statloom.operators import describe, difference, rows, shape, variance
from statloom.operators.ranks import value_ranks
from statloom.sources import database, footers, sinks, tables

WEIGHTS = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def traits(spark, groups):
    """groups: trait -> (values of P, values of M)."""
    data = [(t, float(v), f2) for t, (p, m) in groups.items() for f2, vs in ((1, p), (2, m)) for v in vs]
    return spark.createDataFrame(data, "trait_id int, trait_value double, f2 bigint").withColumn("origin", origin(F.col("f2")))


def test_division(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (0D, 0D), (1D, 0D), (-1D, 0D), (CAST(NULL AS DOUBLE), 0D) AS t(a, b)")
    got = [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.5 and math.isnan(got[1]) and got[2:] == [math.inf, -math.inf, None]


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-6, 0.02, 0.07, 0.3, 0.5, 0.8, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-12, atol=1e-14)


def test_tails_against_commons_math(spark):
    m = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((2.0, 10.0), (0.3, 3.0), (-4.0, 55.5)):
        assert tails.t_two_sided(t, df) == pytest.approx(2 * m.TDistribution(df).cumulativeProbability(-abs(t)), rel=1e-9)
    for f, a, b in ((3.2, 1.0, 20.0), (0.4, 4.0, 7.0)):
        assert tails.f_upper(f, a, b) == pytest.approx(1 - m.FDistribution(a, b).cumulativeProbability(f), rel=1e-9)
    for x, k in ((3.84, 1.0), (12.0, 5.0), (0.2, 2.0)):
        assert tails.chi2_upper(x, k) == pytest.approx(1 - m.ChiSquaredDistribution(k).cumulativeProbability(x), rel=1e-9)


def test_exact_rank_sum_by_enumeration():
    from itertools import combinations

    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert tails.mann_whitney_p(u, n1, n2, 0) == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))


def test_ranks_with_ties_nulls_and_ranges(spark, monkeypatch):
    from statloom.operators import ranks

    monkeypatch.setattr(ranks, "PER_RANGE", 3)
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k in (1, None) for v in rng.integers(0, 25, 200)] + [(1, None)]
    df = spark.createDataFrame(data, "k int, v double")
    for key in (1, None):
        values = sorted(v for k, v in data if k == key and v is not None)
        for r in (x for x in value_ranks(df, ["k"], "v").collect() if x["k"] == key):
            assert r["before"] == sum(x < r["v"] for x in values) and r["cnt"] == values.count(r["v"]) and r["n"] == len(values)


def test_ranges_hold_under_outliers(spark, monkeypatch):
    from statloom.operators import ranks

    monkeypatch.setattr(ranks, "PER_RANGE", 200), monkeypatch.setattr(ranks, "CUTS", 16)
    values = [float(v) for v in range(20_000)] + [1e15, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0), (2, 5.0), (None, 1.0)], "k int, v double")
    cut = ranks._cut(ranks._cut(df, ["k"], "v", "_range"), ["k", "_range"], "v", "_part")
    sizes = [r["count"] for r in cut.groupBy("k", "_range", "_part").count().collect()]
    assert max(sizes) <= 400 and sum(sizes) == len(values) + 3
    got = {(r["k"], str(r["v"])): (r["before"], r["cnt"], r["n"], r["least"]) for r in value_ranks(df, ["k"], "v").collect()}
    assert got[2, "5.0"] == (0, 2, 2, 5.0) and got[None, "1.0"] == (0, 1, 1, 1.0) and got[1, "-inf"] == (0, 1, 20_004, -math.inf)
    assert all(got[1, str(float(v))][0] == v + 1 for v in range(20_000)) and got[
        1, "1000000000000000.0" if (1, "1000000000000000.0") in got else "1e+15"
    ][0] == 20_001
    assert got[1, "inf"][0] == 20_002 and got[1, "nan"][0] == 20_003


def test_describe_nearest_quantiles_and_edges(spark):
    data = [(1, 1, 1, "P", v) for v in (3.0, 1.0, 2.0, None, 4.0)] + [(1, 2, 1, "P", 5.0)] + [(1, 3, 1, "M", v) for v in (-1.0, 1.0)]
    df = spark.createDataFrame(data, "chra int, windowa int, trait_id int, origin string, v double")
    a, b, c = describe.describe(df, "v").collect()
    assert (a["count"], a["min"], a["max"], a["median"], a["q25"], a["q75"]) == (5, 1, 4, 2.5, 2, 3)
    assert b["std"] is None and b["cv"] is None and b["iqr"] == 0
    assert c["mean"] == 0 and c["cv"] == math.inf and c["qcd"] == math.inf


def test_quality_control_thresholds(spark):
    data = [(1, i) for i in range(4)] + [(2, 7)] * 4 + [(3, 1)] * 3 + [(None, 5)]
    kept, gone = describe.quality_control(spark.createDataFrame(data, "g int, v int"), "g", "v", 4, 25.0)
    assert {r[0] for r in kept.collect()} == {1, 2} and {r[0] for r in gone.collect()} == {3, None}
    kept, gone = describe.quality_control(spark.createDataFrame(data[:4] + [(None, 5)] * 4, "g int, v int"), "g", "v", 1, -1.0)
    assert kept.count() == 8 and gone.count() == 0


def test_shapiro_published(spark):
    got = difference.shapiro(
        traits(spark, {1: (WEIGHTS, []), 2: ([1, 2], []), 3: ([1, 2, 4], []), 4: ([5] * 6, [])}), "trait_value"
    ).orderBy("trait_id").collect()
    assert got[0]["statistic"] == pytest.approx(0.78881, abs=1e-5) and got[0]["pvalue"] == pytest.approx(0.006704, abs=1e-6)
    assert got[1]["statistic"] is None and got[1]["pvalue"] is None
    assert got[2]["statistic"] == pytest.approx(0.9642857, abs=1e-6) and got[3]["pvalue"] == 1


def test_two_group_tests(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(0, 1, 20).round(1), rng.normal(0.5, 2, 15).round(1)
    df, back = traits(spark, {1: (p, q)}), traits(spark, {1: (q, p)})
    t = difference.student(df, "trait_value").first()
    java = spark._jvm.org.apache.commons.math3.stat.inference.TTest()
    gate = spark.sparkContext._gateway

    def arr(x):
        a = gate.new_array(gate.jvm.double, len(x))
        for i, v in enumerate(x):
            a[i] = float(v)
        return a

    assert t["pvalue"] == pytest.approx(java.homoscedasticTTest(arr(p), arr(q)), rel=1e-9)
    w = difference.welch(df, "trait_value").first()
    assert w["pvalue"] == pytest.approx(java.tTest(arr(p), arr(q)), rel=1e-9) and w["statistic"] == pytest.approx(java.t(arr(p), arr(q)))
    assert difference.student(back, "trait_value").first()["statistic"] == pytest.approx(-t["statistic"])
    u = difference.mann_whitney(df, "trait_value").first()["statistic"]
    assert u == sum((a > b) + 0.5 * (a == b) for a in p for b in q)
    assert u + difference.mann_whitney(back, "trait_value").first()["statistic"] == len(p) * len(q)
    z = [np.abs(x - np.median(x)) for x in (p, q)]
    f = spark._jvm.org.apache.commons.math3.stat.inference.OneWayAnova()
    both = gate.jvm.java.util.ArrayList()
    for x in z:
        both.add(arr(x))
    lev = difference.levene(df, "trait_value").first()
    assert lev["statistic"] == pytest.approx(f.anovaFValue(both)) and lev["pvalue"] == pytest.approx(f.anovaPValue(both), rel=1e-8)
    for test in (difference.bartlett, difference.fligner):
        r = test(df, "trait_value").first()
        assert r["statistic"] >= 0 and r["pvalue"] == pytest.approx(tails.chi2_upper(r["statistic"], 1))


def test_router(spark):
    rng = np.random.default_rng(3)
    got = difference.significance(
        difference.difference_test(
            traits(spark, {1: (rng.normal(0, 1, 30), rng.normal(3, 1, 30)), 2: (rng.exponential(1, 40) ** 3, rng.exponential(1, 40) ** 3)}),
            "trait_value",
        )
    ).collect()
    assert {r["trait_id"]: r["method"] for r in got}[2] == "MannwhitneyU-test"


def test_router_agrees_with_the_single_tests(spark):
    rng = np.random.default_rng(8)
    groups = {k: (rng.normal(k, 1, 20).round(1) + 1e6, rng.normal(0, 1 + k % 3 * 2, 15).round(1) + 1e6) for k in range(8)}
    groups |= {
        10: (rng.exponential(1, 30) ** 2, rng.exponential(1, 20)),
        11: ([], rng.normal(0, 1, 9)),
        12: ([1.0], [2.0]),
        13: ([1.0, math.nan, 3.0], [2.0]),
        14: ([5.0] * 4, [5.0] * 4),
    }
    df = traits(spark, groups)
    one = lambda test: {r["trait_id"]: r for r in test(df, "trait_value").collect()}
    normal, t, w, u = map(one, (difference.shapiro, difference.student, difference.welch, difference.mann_whitney))
    for name, test in (("levene", difference.levene), ("bartlett", difference.bartlett), ("fligner", difference.fligner)):
        equal = one(test)
        got = {r["trait_id"]: r for r in difference.difference_test(df, "trait_value", name).collect()}
        assert set(got) == {k for k, r in normal.items() if r["pvalue"] is not None and not math.isnan(r["pvalue"])} >= {0, 10, 14}
        for k, r in got.items():
            method, want = (
                "MannwhitneyU-test", u[k]
            ) if normal[k]["pvalue"] < 0.05 else ("T-test", t[k]) if (equal[k]["pvalue"] or 0) > 0.05 else ("Welchs-test", w[k])
            assert r["method"] == method, (name, k)
            for c in ("statistic", "pvalue"):
                same = lambda x: None if x is None or math.isnan(x) else pytest.approx(x, rel=1e-6)
                assert (None if r[c] is None or math.isnan(r[c]) else r[c]) == same(want[c]), (name, k, c)
    with pytest.raises(ValueError):
        difference.difference_test(df, "trait_value", "other")


def test_scores_of_ties_are_sums(spark):
    from statistics import NormalDist

    rows = [(0, 1, 10), (3, 4, 10), (9, 1, 10)]
    got = spark.createDataFrame(rows, "b long, c long, n long").select(tails.score_sums("b", "c", "n").alias("s")).select("s.*").collect()
    for (b, c, n), r in zip(rows, got, strict=True):
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(b + 1, b + c + 1)]
        assert r["sum"] == pytest.approx(sum(m)) and r["squares"] == pytest.approx(sum(x * x for x in m))


def test_variance(spark):
    rng = np.random.default_rng(4)
    data = [(1, 0, 1, g, float(x)) for g, m in (("P", 0), ("M", 1)) for x in rng.normal(m, 1, 30)] + [
        (1, 1, 1, "P", 1.0), (1, 1, 1, "P", 2.0), (1, 2, 1, "X", 2.0)
    ]
    df = spark.createDataFrame(data, "chra int, windowa int, trait_id int, origin string, v double")
    a, one = variance.anova(df, "v").orderBy("windowa").collect()
    y = np.array([r[4] for r in data[:60]])
    assert a["ssb"] + a["ssw"] == pytest.approx(
        ((y - y.mean()) ** 2).sum()
    ) and 0 <= a["anova_repeatability"] <= 1 and math.isnan(one["anova_f_value"])
    t = difference.student(df.where("windowa = 0").withColumnRenamed("v", "trait_value"), "trait_value").first()["statistic"]
    assert a["anova_f_value"] == pytest.approx(t * t)
    names = "chra windowa trait_id anova_sigma_alpha_sq anova_sigma_epsilon_sq anova_repeatability anova_f_value bayes_sigma_alpha_sq bayes_sigma_epsilon_sq bayes_repeatability"
    assert variance.variance_components(df, "v").columns == names.split()
    b = variance.bayes(df, "v").where("windowa = 0").first()
    assert 0 < b["bayes_repeatability"] < 1
    coarse, fine = (variance.posterior_sds(np.array([30.0, 30]), np.array([-0.4, 0.4]), 50.0, k) for k in (300, 500))
    assert np.allclose(coarse, fine, atol=1e-3)


def test_box_cox(spark):
    x = np.exp(np.random.default_rng(5).normal(0, 1, 300))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    out, lam = shape.box_cox(df, "v")

    def llf(k):
        y = np.log(x) if k == 0 else np.expm1(k * np.log(x)) / k
        return (k - 1) * np.log(x).sum() - len(x) / 2 * math.log(y.var())

    assert llf(lam) >= max(llf(lam + e) for e in (-1e-3, 1e-3)) and "v_boxcox" in out.columns
    assert shape.box_cox(df.select((F.col("v") - 5).alias("v")), "v")[0].where("v_boxcox IS NULL OR isnan(v_boxcox)").count() == 0
    with pytest.raises(ValueError):
        shape.box_cox(spark.range(3).select(F.lit(1.0).alias("v")), "v")
    none, lam = shape.box_cox(df.where("v IS NULL"), "v")
    assert none.columns == ["v", "v_boxcox"] and none.count() == 0 and math.isnan(lam)
    assert shape.box_cox(df, "v", [-1.0, 0.1, 2.0])[1] == 0.1


def test_plot_data(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    h = shape.histogram(df, "v").collect()
    assert len(h) == 30 and sum(r["density"] * (r["right"] - r["left"]) for r in h) == pytest.approx(1) and sum(r["count"] for r in h) == 100
    q = shape.qq_points(df, "v").orderBy("i").collect()
    assert [r["sample"] for r in q] == [float(i) for i in range(1, 101)] and q[0]["theoretical"] == pytest.approx(-q[-1]["theoretical"])
    box = shape.box_statistics(df.union(spark.createDataFrame([(1000.0,)], "v double")), "v").first()
    assert box["fliers"] == 1 and box["whisker_high"] == 100 and box["median"] == 51


def test_reshape(spark):
    wide = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "id int, x string, y int")
    long = rows.wide_to_long(wide, ["id"], ["x", "y"])
    assert {tuple(r) for r in long.collect()} == {(1, "x", "a"), (1, "y", "2"), (2, "x", None), (2, "y", "3")}
    back = rows.long_to_wide(long, ["id"], ["variable"], ["value"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "a", "2"), (2, None, "3")]
    first = spark.createDataFrame([(1, "g", None, 1), (1, "g", 5, 2)], "id int, k string, v int, o int")
    assert rows.long_to_wide(first, ["id"], ["k"], ["v"], order="o").first()["g"] is None
    assert rows.long_to_wide(first, ["id"], ["k"], ["v", "o"], order="o").columns == ["id", "v_g", "o_g"]


def test_rows(spark, tmp_path):
    p = spark.createDataFrame(
        [(1, 1, 1, 0, 1, 1.0), (1, 1, 1, 1, 0, 1.0), (1, 1, 1, 0, 1, 0.0), (1, 1, 1, 0, 2, 1.0)],
        "chra int, windowa int, trait_id int, allelea int, allelea_mutant_paternal int, trait_male_diff_paternal double",
    )
    p = p.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("allelea", "allelea_mutant_paternal")})
    m = p.toDF("chra", "windowa", "trait_id", "peerallelea", "peerallelea_mutant_maternal", "trait_male_diff_maternal")
    assert [(r["origin"], r["allele"], r["mutant"]) for r in rows.mutation_flips(p, m, "pos_flip").collect()] == [("P", 0, 1), ("M", 0, 1)]
    with pytest.raises(ValueError):
        rows.mutation_flips(p, m, None)
    with pytest.raises(ValueError):
        rows.union_strict(spark.range(1), spark.range(1).select(F.col("id").cast("int")))
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert [r[0] for r in rows.preview(df, "v", True, 2).collect()] == [None, 3] and rows.preview(df, n=0).count() == 3
    with pytest.raises(ValueError):
        rows.preview(df, "nope")
    assert rows.string_lengths(spark.createDataFrame([("a😀é中",)], "s string"), "s").first()["length"] == 4
    sinks.write(df, str(tmp_path / "a"))
    with pytest.warns(UserWarning):
        assert tables.scan_many(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 3
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        tables.scan_many(spark, [str(tmp_path / "b")])
    (tmp_path / "w.txt").write_text("1 3\n2 x\n1 4\njunk\n 2\t7 \n")
    assert {tuple(r) for r in tables.read_windows(spark, str(tmp_path / "w.txt")).collect()} == {(1, 4), (2, 7)}


def test_database(spark, tmp_path):
    url = "jdbc:derby:memory:engine;create=true"
    spark.range(20).select("id", (F.col("id") * 2).alias("v")).write.format("jdbc").options(
        url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"
    ).save()
    sql = tmp_path / "q.sql"
    sql.write_text('SELECT * FROM t WHERE "v" >= 10;')
    got = database.read_database(spark, url, str(sql), '"id"', 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.count() == 15 and got.rdd.getNumPartitions() == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from statloom.cli import main

    url, driver = "jdbc:derby:memory:cli;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rng = np.random.default_rng(6)
    rows_ = [(t, float(v), i) for t in (1, 2) for i, v in enumerate(rng.normal(t, 1, 40) + (np.arange(40) % 2) * 3)] + [(3, 1.0, 1)]
    df = spark.createDataFrame(rows_, "trait_id int, trait_value double, f2 int")
    df.write.format("jdbc").options(url=url, dbtable="traits", driver=driver, user="u", password="p").save()
    monkeypatch.setenv("STATLOOM_DB_USER", "u"), monkeypatch.setenv("STATLOOM_DB_PASSWORD", "p")
    (tmp_path / "folder").mkdir()
    query = 'SELECT * FROM traits'
    assert main(
        [
            "save",
            "--url",
            url,
            "--driver",
            driver,
            "--query",
            query,
            "--partition-on",
            '"trait_id"',
            "--size",
            "5",
            "--partitions",
            "2",
            "--output",
            str(tmp_path / "folder"),
        ]
    ) == 0
    saved = str(tmp_path / "folder" / "query.parquet")
    assert "groups left out: 1 3" in capsys.readouterr().out and spark.read.parquet(saved).where("origin IS NOT NULL").count() == 80
    assert main(["difference", saved, "--variances", "bartlett", "--output", str(tmp_path / "d")]) == 0
    said = capsys.readouterr().out
    assert "traits significant: 2 1, 2" in said and "traits not significant: 0" in said and " s\n" in said
    assert main(["show", saved, "--count"]) == 0 and capsys.readouterr().out.endswith("rows\n80\n")
    assert main(["show", saved]) == 0 and len(capsys.readouterr().out.splitlines()) == 81
    assert main(["show", saved, "--rows", "3", "--sort", "trait_id"]) == 0 and len(capsys.readouterr().out.splitlines()) == 4
    for tool, lines in (("box", 2), ("curve", 101), ("histogram", 31), ("plot", 2)):
        assert main([tool, saved, "--value", "trait_value"]) == 0 and len(capsys.readouterr().out.splitlines()) == lines
    windows = df.select(
        F.col("trait_id").alias("chra"),
        F.lit(0).alias("windowa"),
        "trait_id",
        F.col("trait_value").alias("v"),
        origin(F.col("f2")).alias("origin"),
    )
    sinks.write(windows, str(tmp_path / "w"))
    (tmp_path / "w.txt").write_text("1 1\n2 1\n")
    assert main(["variance", str(tmp_path / "w"), "--value", "v", "--windows", str(tmp_path / "w.txt"), "--chromosome", "2"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["chra", "2"]


def test_every_query_has_sql():
    from statloom.plans.queries import QUERIES, SQL

    assert set(QUERIES) == set(SQL)


def test_oracle_at_small_scale(spark):
    import glob
    import os

    import duckdb

    from statloom.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in SQL:
        mine = QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(mine.columns)
        want = con.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})').fetchall()
        assert sorted(repr(tuple(r)) for r in mine.select(cols).collect()) == sorted(map(repr, want)), name


def test_entry_from_a_folder_without_write_permission(tmp_path):
    """The archive for workers holds sources and nothing is written beside them, __pycache__ included."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(f"{here}/statloom", copy / "statloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{here}/{name}"):
            shutil.copy(f"{here}/{name}", copy)
    script = """
import os, sys, zipfile
import __spark_entry__ as e
class Context:
    applicationId = "one"
    def addPyFile(self, path):
        names = zipfile.ZipFile(path).namelist()
        assert "statloom/operators/ranks.py" in names and all(n.endswith(".py") for n in names), names
        sys.path.insert(0, path)
e._ship(type("Session", (), {"sparkContext": Context()}))
"""
    folders = [d for d, _, _ in os.walk(copy)]
    for d in folders:
        os.chmod(d, 0o555)
    try:
        run = [sys.executable, "-B", "-c", script]
        done = subprocess.run(run, cwd=copy, capture_output=True, text=True, timeout=120)
    finally:
        for d in folders:
            os.chmod(d, 0o755)
    assert done.returncode == 0, done.stderr
    assert not [f for _, names, files in os.walk(copy) for f in (*names, *files) if f.endswith(("__pycache__", ".pyc"))]  # root may write anywhere
