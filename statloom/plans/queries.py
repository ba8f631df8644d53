"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CENTRE, MIDDLE, TAIL, origin
from ..operators import describe, difference, rows, shape, variance
from ..sources import database, sinks, tables

QUERIES, SQL = {}, {}


def sql_quantile(p: str) -> str:
    """SQL text of the standard normal quantile of p."""

    def ratio(x: str, form: tuple) -> str:
        parts = []
        for coefficients in form:
            text = f"{coefficients[-1]!r}::DOUBLE"
            for c in reversed(coefficients[:-1]):
                text = f"({text} * {x} + {c!r}::DOUBLE)"
            parts.append(text)
        return f"({parts[0]} / {parts[1]})"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    far = f"CASE WHEN {r} <= 5 THEN {ratio(f'({r} - 1.6)', MIDDLE)} ELSE {ratio(f'({r} - 5)', TAIL)} END"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(f'(0.180625 - {q} * {q})', CENTRE)} ELSE sign({q}) * {far} END)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.scan(spark, f"{d}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _known(c: str | F.Column, digits: int | None = None) -> F.Column:
    """A number rounded, with null in the place of NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.when(F.abs(c) < float("inf"), c)
    return c if digits is None else F.round(c, digits)


def _effects(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("chra"),
        F.month("l_shipdate").alias("windowa"),
        F.lit(1).alias("trait_id"),
        F.col("l_returnflag").alias("origin"),
        F.col("l_extendedprice").alias("effect_value"),
    )


def _traits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("trait_id"),
        F.col("l_extendedprice").alias("trait_value"),
        F.col("l_orderkey").alias("f2"),
        origin(F.col("l_orderkey")).alias("origin"),
    )


TRAITS = "SELECT l_partkey AS trait_id, l_extendedprice AS v, CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'P' END AS g FROM lineitem"
TWO = f"""SELECT trait_id, count(v) FILTER (g = 'P') AS n1, count(v) FILTER (g = 'M') AS n2, avg(v) FILTER (g = 'P') AS m1, avg(v) FILTER (g = 'M') AS m2,
 var_samp(v) FILTER (g = 'P') AS v1, var_samp(v) FILTER (g = 'M') AS v2 FROM ({TRAITS}) GROUP BY 1"""


@query("SELECT * FROM nation")
def s01_scan(spark, d):
    return _t(spark, d, "nation")


@query("SELECT * FROM orders")
def s02_scan_many(spark, d):
    """Two files of unequal size, which hold all orders, and one that isn't there."""
    at, orders = sinks.scratch(spark, "parts"), _t(spark, d, "orders")
    third = F.col("o_orderkey") % 3 == 0
    paths = [sinks.write(orders.where(part), f"{at}/{name}") for name, part in (("a", third), ("b", F.coalesce(~third, F.lit(True))))]
    return tables.scan_many(spark, [*paths, f"{at}/no_such_file"])


@query("SELECT value FROM events")
def s03_scan_column(spark, d):
    return tables.scan_column(spark, f"{d}/events.parquet", "value")


def _embedded(spark, df: DataFrame, table: str) -> tuple[str, dict[str, str]]:
    """Puts a table into a new database of the driver's process, which only a local session's tasks can reach; gives its url and options."""
    url = f"jdbc:derby:memory:{table}{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df.coalesce(4).write.format("jdbc").options(url=url, dbtable=table, batchsize="5000", **options).save()
    return url, options


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s04a_database_read(spark, d):
    """All orders, put into an embedded database and read back in 16 ranges of their price."""
    url, options = _embedded(spark, _t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "orders")
    back = database.read_database(spark, url, "SELECT * FROM orders", '"o_totalprice"', 16, **options)
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


TRAIT_READ = """WITH s AS (SELECT c_nationkey AS k, count(*) AS c, count(DISTINCT c_mktsegment) * 100.0 / count(c_nationkey) AS r FROM customer GROUP BY 1)"""


@query(
    TRAIT_READ
    + """ SELECT c_nationkey AS trait_id, c_mktsegment AS trait_value, c_custkey AS f2, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'P' END AS origin
 FROM customer WHERE c_nationkey NOT IN (SELECT k FROM s WHERE c < 60 OR r < 8)"""
)
def s04b_trait_read(spark, d):
    """A trait's rows from an embedded database, in ranges of the trait, through quality control."""
    traits = _t(spark, d, "customer").select(
        F.col("c_nationkey").alias("trait_id"), F.col("c_mktsegment").alias("trait_value"), F.col("c_custkey").alias("f2")
    )
    url, options = _embedded(spark, traits, "traits")
    back = database.read_database(spark, url, "SELECT * FROM traits", '"trait_id"', 16, **options)
    return describe.quality_control(back, "trait_id", "trait_value", 60, 8.0)[0]


@query("SELECT * FROM lineitem")
def s05_write(spark, d):
    """All line items, written in ranges of l_partkey in the place of an older result, and read back."""
    at = f"{sinks.scratch(spark, 'written')}/lineitem"
    sinks.write(_t(spark, d, "region"), at)
    return tables.scan(spark, sinks.write(_t(spark, d, "lineitem"), at, sort=["l_partkey", "l_orderkey"]))


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders")
def s06_sink(spark, d):
    """Files as one table, sunk into one result and read back."""
    orders = f"{d}/orders.parquet"
    at = sinks.scratch(spark, "sunk")
    both = tables.scan(spark, orders).unionByName(tables.scan(spark, orders))
    return tables.scan(spark, sinks.write(both, at, file_bytes=sinks.FILE_BYTES))


@query("SELECT l_partkey AS trait_id, l_extendedprice AS trait_value FROM lineitem WHERE l_partkey = 17")
def s09_extract_trait(spark, d):
    return rows.extract_trait(_traits(spark, d), 17).select("trait_id", "trait_value")


@query(
    "SELECT l_linenumber AS chra, month(l_shipdate)::INT AS windowa, l_returnflag AS origin, l_extendedprice AS effect_value FROM lineitem WHERE l_linenumber = 2 AND month(l_shipdate) = 3"
)
def s10_extract_window(spark, d):
    return rows.extract_window(_effects(spark, d), 2, 3).drop("trait_id")


def _flip_sides(spark, d):
    base = _t(spark, d, "lineitem").select(
        "l_linestatus",
        F.col("l_linenumber").alias("chra"),
        F.month("l_shipdate").alias("windowa"),
        F.col("l_orderkey").alias("trait_id"),
        (F.col("l_partkey") % 3).alias("a"),
        (F.col("l_suppkey") % 3).alias("m"),
        (F.col("l_extendedprice") - 50000).alias("e"),
    )
    p = base.where("l_linestatus = 'O'").withColumnsRenamed({"a": "allelea", "m": "allelea_mutant_paternal", "e": "trait_male_diff_paternal"})
    m = base.where("l_linestatus = 'F'").withColumnsRenamed({"a": "peerallelea", "m": "peerallelea_mutant_maternal", "e": "trait_male_diff_maternal"})
    return p, m


FLIP = """SELECT l_linenumber::TINYINT AS chra, month(l_shipdate)::INT AS windowa, l_orderkey AS trait_id, CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'M' END AS origin,
 (l_partkey % 3)::TINYINT AS allele, (l_suppkey % 3)::TINYINT AS mutant, l_extendedprice - 50000 AS effect_value
 FROM lineitem WHERE l_linestatus IN ('O', 'F') AND l_extendedprice - 50000 > 0 AND l_partkey % 3 - l_suppkey % 3 = {}"""


@query(FLIP.format(-1))
def s11_positive_flips(spark, d):
    return rows.mutation_flips(*_flip_sides(spark, d), "pos_flip")


@query(FLIP.format(1))
def s11_negative_flips(spark, d):
    return rows.mutation_flips(*_flip_sides(spark, d), "nega_flip")


@query("SELECT l_orderkey AS f2, CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'P' END AS origin FROM lineitem")
def s12_origin(spark, d):
    return _traits(spark, d).select("f2", "origin")


DESCRIBE = """WITH e AS (SELECT l_linenumber AS chra, month(l_shipdate)::INT AS windowa, 1 AS trait_id, l_returnflag AS origin, l_extendedprice AS v FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY chra, windowa, origin ORDER BY v) - 1 AS i, count(v) OVER (PARTITION BY chra, windowa, origin) AS n FROM e),
 g AS (SELECT chra, windowa, trait_id, origin, count(*) AS count, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, var_samp(v) AS var, median(v) AS median,
 max(v) FILTER (i = 0) AS q0, max(v) FILTER (i = floor((n - 1) * 0.25 + 0.5)) AS q25, max(v) FILTER (i = floor((n - 1) * 0.75 + 0.5)) AS q75,
  max(v) FILTER (i = n - 1) AS q100 FROM r GROUP BY 1, 2, 3, 4)
 SELECT chra, windowa, trait_id, origin, count, min, max, round(mean, 4) AS mean, round(std, 4) AS std, round(var, 2) AS var, round(std / mean, 6) AS cv,
 round(median, 4) AS median, q0, q25, q75, q100,
 round(q75 - q25, 4) AS iqr, round((q75 - q25) / median, 6) AS qcd FROM g"""


@query(DESCRIBE)
def s13_describe(spark, d):
    out = describe.describe(_effects(spark, d), "effect_value")
    digits = {"mean": 4, "std": 4, "var": 2, "cv": 6, "median": 4, "iqr": 4, "qcd": 6}
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1")
def s14_sizes(spark, d):
    return describe.sizes(_t(spark, d, "lineitem"), "l_partkey")


@query("SELECT p_brand, round(count(DISTINCT p_size) * 100.0 / count(p_brand), 6) AS ratio FROM part GROUP BY 1")
def s15_distinct_ratio(spark, d):
    return _rounded(describe.distinct_ratio(_t(spark, d, "part"), "p_brand", "p_size"))


@query("SELECT count(*) AS n FROM lineitem")
def s15c_row_count(spark, d):
    return _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT trait_id, round(m1 + 1e-7, 4) AS mean_p, round(m2 + 1e-7, 4) AS mean_m FROM ({TWO})")
def s15d_conditional(spark, d):
    v = F.col("trait_value")
    return _traits(spark, d).groupBy("trait_id").agg(
        *[F.round(F.avg(F.when(F.col("origin") == g, v)) + 1e-7, 4).alias(n) for g, n in (("P", "mean_p"), ("M", "mean_m"))]
    )


@query("SELECT min(value) AS lo, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events")
def s15e_whole_column(spark, d):
    return _t(spark, d, "events").agg(
        F.min("value").alias("lo"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd")
    )


QUANTILE = sql_quantile
RANKED = f"""SELECT trait_id, v, row_number() OVER (PARTITION BY trait_id ORDER BY v) AS i, count(*) OVER (PARTITION BY trait_id) AS n FROM ({TRAITS})"""
SHAPIRO = f"""WITH r AS ({RANKED}), s AS (SELECT *, {QUANTILE("((i - 0.375) / (n + 0.25))")} AS m FROM r),
 a AS (SELECT trait_id, n, sum(m * m) AS sq, sum(m * v) AS mx, var_pop(v) * n AS ss, max(v) FILTER (i = 1) AS x1, max(v) FILTER (i = 2) AS x2,
  max(v) FILTER (i = n - 1) AS y2, max(v) FILTER (i = n) AS y1, max(m) FILTER (i = n) AS c1, max(m) FILTER (i = n - 1) AS c2, 1 / sqrt(n) AS u FROM s GROUP BY 1, 2),
 b AS (SELECT *, ((((-2.706056 * u + 4.434685) * u - 2.071190) * u - 0.147981) * u + 0.221157) * u + c1 / sqrt(sq) AS a1,
  ((((-3.582633 * u + 5.682633) * u - 1.752461) * u - 0.293762) * u + 0.042981) * u + c2 / sqrt(sq) AS a2 FROM a),
 w AS (SELECT trait_id, n, CASE WHEN n < 3 THEN NULL WHEN ss = 0 THEN 1 WHEN n = 3 THEN pow((y1 - x1) * sqrt(0.5), 2) / ss
  WHEN n <= 5 THEN pow(a1 * (y1 - x1) + (mx - c1 * (y1 - x1)) / sqrt((sq - 2 * c1 * c1) / (1 - 2 * a1 * a1)), 2) / ss
  ELSE pow(a1 * (y1 - x1) + a2 * (y2 - x2) + (mx - c1 * (y1 - x1) - c2 * (y2 - x2)) / sqrt((sq - 2 * c1 * c1 - 2 * c2 * c2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss END AS w FROM b)"""


def _upper(z: str) -> str:
    """SQL of the standard normal's probability above z, by Simpson's rule."""
    end = f"least(abs({z}), 12.0::DOUBLE)"
    weight = "CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(401), lambda k: ({weight}) * exp(-pow({end} * k / 400, 2) / 2))) * {end} / 1200"
    return f"(0.5 - sign({z}) * {area} / sqrt(2 * pi()))"


#: SQL of W's p-value from w and n (6/pi etc. for three values; Royston's transforms beyond).
W_PLACE = """CASE WHEN n <= 11 THEN (-ln(0.459 * n - 2.273 - ln(1 - w)) - (((-0.0006714 * n + 0.025054) * n - 0.39978) * n + 0.5440))
  / exp(((-0.0020322 * n + 0.062767) * n - 0.77857) * n + 1.3822)
 ELSE (ln(1 - w) - (((0.0038915 * ln(n) - 0.083751) * ln(n) - 0.31082) * ln(n) - 1.5861)) / exp((0.0030302 * ln(n) - 0.082676) * ln(n) - 0.4803) END"""
W_P = f"""CASE WHEN w >= 1 THEN 1.0 WHEN n = 3 THEN greatest(0.0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))))
 WHEN n <= 11 AND ln(1 - w) >= 0.459 * n - 2.273 THEN 0.0 ELSE {_upper("z")} END"""


def _tested_p(df: DataFrame, *more: str) -> DataFrame:
    """trait_id, more columns, the statistic and its p-value, rounded; null where the statistic isn't known."""
    p = F.when(_known("statistic").isNotNull(), _known("pvalue", 6))
    return df.select("trait_id", *more, _known("statistic", 6).alias("statistic"), p.alias("pvalue"))


@query(f"""{SHAPIRO}, p AS (SELECT *, CASE WHEN w < 1 AND n > 3 AND NOT (n <= 11 AND ln(1 - w) >= 0.459 * n - 2.273) THEN {W_PLACE} END AS z FROM w)
 SELECT trait_id, n, round(w, 6) AS statistic, round(CASE WHEN w IS NOT NULL THEN {W_P} END, 6) AS pvalue FROM p""")
def s16_shapiro(spark, d):
    return _tested_p(difference.shapiro(_traits(spark, d), "trait_value"), "n")


U = f"""u AS (SELECT a.trait_id, sum(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS u
 FROM ({TRAITS}) a JOIN ({TRAITS}) b ON a.trait_id = b.trait_id WHERE a.g = 'P' AND b.g = 'M' GROUP BY 1)"""


#: How many of the choices of a of a + b ranks give each U, for all a of at most 8 and b of at most 64 (trait sizes of the tables are below).
WAYS = """ways AS (SELECT 0 AS a, 0 AS b, 0 AS u, 1.0::DOUBLE AS c, 0 AS s UNION ALL
 SELECT a, b, u, sum(c) AS c, s FROM (SELECT a + 1 AS a, b, u + b AS u, c, s + 1 AS s FROM ways WHERE a < 8 AND s < 72 UNION ALL
  SELECT a, b + 1, u, c, s + 1 FROM ways WHERE b < 64 AND s < 72) GROUP BY a, b, u, s)"""
RANK_P = f"""RECURSIVE {U}, {WAYS},
 tie AS (SELECT trait_id, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT trait_id, v, count(*) AS t FROM ({TRAITS}) GROUP BY 1, 2) GROUP BY 1),
 two AS (SELECT trait_id, n1, n2, ties, u, greatest(u, n1 * n2 - u) AS top, n1 + n2 AS n FROM ({TWO}) JOIN tie USING (trait_id) LEFT JOIN u USING (trait_id)),
 exact AS (SELECT trait_id, 2 * sum(c) FILTER (ways.u >= ceil(top)) / sum(c) AS p FROM two JOIN ways ON a = least(n1, n2) AND b = greatest(n1, n2)
  WHERE least(n1, n2) <= 8 AND ties = 0 AND two.u IS NOT NULL GROUP BY 1),
 scale AS (SELECT *, n1 * n2 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1))) AS var FROM two WHERE u IS NOT NULL),
 place AS (SELECT *, CASE WHEN var > 0 AND NOT (least(n1, n2) <= 8 AND ties = 0) THEN (top - n1 * n2 / 2.0::DOUBLE - 0.5) / sqrt(var) END AS z FROM scale),
 up AS (SELECT trait_id, least(1.0, CASE WHEN z IS NOT NULL THEN 2 * {_upper("z")} ELSE p END) AS u_p FROM place LEFT JOIN exact USING (trait_id))"""


@query(f"WITH {RANK_P} SELECT trait_id, u AS statistic, round(u_p, 6) AS pvalue FROM two LEFT JOIN up USING (trait_id)")
def s17_mann_whitney(spark, d):
    return _tested_p(difference.mann_whitney(_traits(spark, d), "trait_value"))


def _t_p(t: str, df: str) -> str:
    """SQL of the two-sided p-value of t, by Simpson's rule on the angle."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weight = "CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(401), lambda k: ({weight}) * pow(cos({angle} * k / 400), {df} - 1))) * {angle} / 1200"
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area})"


STUDENT = f"""s AS (SELECT *, n1 + n2 - 2.0::DOUBLE AS df, CASE WHEN n1 > 0 AND n2 > 0 AND n1 + n2 > 2 THEN
 (m1 - m2) / nullif(sqrt(((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0) END AS t FROM ({TWO}))"""
WELCH = f"""w AS (SELECT *, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t, CASE WHEN n1 > 1 AND n2 > 1 THEN
 pow(v1 / n1 + v2 / n2, 2) / nullif(v1 / n1 * v1 / n1 / (n1 - 1) + v2 / n2 * v2 / n2 / (n2 - 1), 0) END AS df FROM ({TWO}))"""


def _tested(df: DataFrame) -> DataFrame:
    return df.select(
        "trait_id",
        _known("statistic", 6).alias("t"),
        _known("df", 6).alias("df"),
        F.when(_known("statistic").isNotNull(), _known("pvalue", 6)).alias("pvalue"),
    )


@query(f"WITH {STUDENT} SELECT trait_id, round(t, 6) AS t, df, round(CASE WHEN t IS NOT NULL THEN {_t_p('t', 'df')} END, 6) AS pvalue FROM s")
def s18a_student(spark, d):
    return _tested(difference.student(_traits(spark, d), "trait_value"))


@query(
    f"WITH {WELCH} SELECT trait_id, round(t, 6) AS t, round(df, 6) AS df, round(CASE WHEN t IS NOT NULL THEN {_t_p('t', 'df')} END, 6) AS pvalue FROM w"
)
def s18b_welch(spark, d):
    return _tested(difference.welch(_traits(spark, d), "trait_value"))


DISTANCES = f"z AS (SELECT trait_id, g, abs(v - median(v) OVER (PARTITION BY trait_id, g)) AS z FROM ({TRAITS}))"
LEVENE = f"""{DISTANCES},
 a AS (SELECT trait_id, g, count(z) AS n, avg(z) AS m, var_pop(z) * count(z) AS ss FROM z GROUP BY 1, 2),
 b AS (SELECT trait_id, sum(n * m) / sum(n) AS mean FROM a GROUP BY 1),
 l AS (SELECT trait_id, sum(n) AS n, CASE WHEN count(*) = 2 AND sum(n) > 2 THEN (sum(n) - 2) * sum(n * (m - mean) * (m - mean)) / nullif(sum(ss), 0) END AS f
  FROM a JOIN b USING (trait_id) GROUP BY 1)"""


@query(f"WITH {LEVENE} SELECT trait_id, round(f, 5) AS f, round(CASE WHEN f IS NOT NULL THEN {_t_p('sqrt(f)', '(n - 2)')} END, 6) AS pvalue FROM l")
def s19a_levene(spark, d):
    out = difference.levene(_traits(spark, d), "trait_value")
    return out.select("trait_id", _known("statistic", 5).alias("f"), F.when(_known("statistic").isNotNull(), _known("pvalue", 6)).alias("pvalue"))


@query(f"""WITH b AS (SELECT trait_id, CASE WHEN n1 > 1 AND n2 > 1 AND v1 > 0 AND v2 > 0 THEN
 ((n1 + n2 - 2) * ln(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) - (n1 - 1) * ln(v1) - (n2 - 1) * ln(v2))
 / (1 + (1.0 / (n1 - 1) + 1.0 / (n2 - 1) - 1.0 / (n1 + n2 - 2)) / 3) END AS t FROM ({TWO}))
 SELECT trait_id, round(t, 6) AS statistic, round(CASE WHEN t IS NOT NULL THEN 2 * {_upper("sqrt(greatest(t, 0))")} END, 6) AS pvalue FROM b""")
def s19b_bartlett(spark, d):
    return _tested_p(difference.bartlett(_traits(spark, d), "trait_value"))


@query(f"""WITH {DISTANCES}, r AS (SELECT *, rank() OVER (PARTITION BY trait_id ORDER BY z) + (count(*) OVER (PARTITION BY trait_id, z) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY trait_id) AS n FROM z),
 a AS (SELECT trait_id, g, {QUANTILE("(0.5 + r / (2 * (n + 1)))")} AS a FROM r),
 b AS (SELECT trait_id, g, count(a) AS c, sum(a) AS s, sum(a * a) AS q FROM a GROUP BY 1, 2),
 c AS (SELECT trait_id, count(*) AS k, sum(c) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / c) AS b FROM b GROUP BY 1),
 x AS (SELECT trait_id, CASE WHEN k = 2 THEN (b - s * s / n) / nullif((q - s * s / n) / (n - 1), 0) END AS x FROM c)
 SELECT trait_id, round(x, 6) AS statistic, round(CASE WHEN x IS NOT NULL THEN 2 * {_upper("sqrt(greatest(x, 0))")} END, 6) AS pvalue FROM x""")
def s19c_fligner(spark, d):
    return _tested_p(difference.fligner(_traits(spark, d), "trait_value"))


#: Whether W's p-value is above 0.05, as a bound on its transform (6/pi etc. for three values); -1.6448536269514722 is the normal quantile of 0.05.
NORMAL = """CASE WHEN w >= 1 THEN true WHEN n = 3 THEN 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))) > 0.05
 WHEN n <= 11 THEN ln(1 - w) < 0.459 * n - 2.273 AND (-ln(0.459 * n - 2.273 - ln(1 - w)) - (((-0.0006714 * n + 0.025054) * n - 0.39978) * n + 0.5440))
  / exp(((-0.0020322 * n + 0.062767) * n - 0.77857) * n + 1.3822) < 1.6448536269514722
 ELSE (ln(1 - w) - (((0.0038915 * ln(n) - 0.083751) * ln(n) - 0.31082) * ln(n) - 1.5861)) / exp((0.0030302 * ln(n) - 0.082676) * ln(n) - 0.4803) < 1.6448536269514722 END"""
ROUTED = f"""WITH {RANK_P}, shapiro AS ({SHAPIRO} SELECT * FROM w), spread AS (WITH {LEVENE} SELECT * FROM l), {STUDENT}, {WELCH},
 equal AS (SELECT trait_id, f IS NOT NULL AND {_t_p("sqrt(f)", "(n - 2)")} > 0.05 AS same FROM spread),
 route AS (SELECT trait_id, {NORMAL} AS normal, coalesce(same, false) AS same FROM shapiro JOIN equal USING (trait_id) WHERE w IS NOT NULL)"""


@query(f"""{ROUTED} SELECT trait_id, CASE WHEN NOT normal THEN 'MannwhitneyU-test' WHEN same THEN 'T-test' ELSE 'Welchs-test' END AS method,
 round(CASE WHEN NOT normal THEN u WHEN same THEN s.t ELSE w.t END, 6) AS statistic,
 round(CASE WHEN NOT normal THEN u_p WHEN same THEN {_t_p("s.t", "s.df")} ELSE {_t_p("w.t", "w.df")} END, 6) AS pvalue
 FROM route LEFT JOIN u USING (trait_id) LEFT JOIN up USING (trait_id) JOIN s USING (trait_id) JOIN w USING (trait_id)""")
def s19d_difference_test(spark, d):
    out = difference.difference_test(_traits(spark, d), "trait_value")
    p = F.when(_known("statistic").isNotNull(), _known("pvalue", 6))
    return out.select("trait_id", "method", _known("statistic", 6).alias("statistic"), p.alias("pvalue"))


@query(f"""WITH {STUDENT}, p AS (SELECT trait_id, CASE WHEN t IS NOT NULL THEN {_t_p("t", "df")} END AS p FROM s)
 SELECT p < 0.05 AS significant, count(*) AS traits FROM p GROUP BY 1""")
def s19e_significance(spark, d):
    tested = difference.student(_traits(spark, d), "trait_value")
    return difference.significance(tested).groupBy("significant").agg(F.count(F.lit(1)).alias("traits"))


def _windows(spark, d):
    t = _t(spark, d, "lineitem")
    return t.select(
        F.col("l_linenumber").alias("chra"),
        F.month("l_shipdate").alias("windowa"),
        F.lit(1).alias("trait_id"),
        origin(F.col("l_orderkey")).alias("origin"),
        F.col("l_extendedprice").alias("v"),
    )


WINDOWS = "SELECT l_linenumber AS chra, month(l_shipdate)::INT AS windowa, l_orderkey % 2 AS g, l_extendedprice AS v FROM lineitem"
ANOVA = f"""WITH e AS ({WINDOWS}),
 a AS (SELECT chra, windowa, g, count(v) AS n, avg(v) AS m, var_pop(v) * count(v) AS ss FROM e GROUP BY 1, 2, 3),
 b AS (SELECT chra, windowa, sum(n * m) / sum(n) AS mean FROM a GROUP BY 1, 2),
 c AS (SELECT chra, windowa, sum(n) AS n, count(*) AS k, sum(n * (m - mean) * (m - mean)) AS ssb, sum(ss) AS ssw FROM a JOIN b USING (chra, windowa) GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN k > 1 THEN ssb / (k - 1) END AS msb, ssw / nullif(n - k, 0) AS msw FROM c),
 t AS (SELECT *, greatest((msb - msw) / (n / k), 0) + msb * 0 AS alpha FROM s)
 SELECT chra, windowa, 1 AS trait_id, round(ssb, -5) AS ssb, round(ssw, -5) AS ssw, round(alpha, -2) AS anova_sigma_alpha_sq, round(msw, -2) AS anova_sigma_epsilon_sq,
 round(alpha / (alpha + msw), 8) AS anova_repeatability, round(msb / msw, 6) AS anova_f_value FROM t"""
DIGITS = {"ssb": -5, "ssw": -5, "anova_sigma_alpha_sq": -2, "anova_sigma_epsilon_sq": -2, "anova_repeatability": 8, "anova_f_value": 6}
DIGITS |= {"bayes_sigma_alpha_sq": -2, "bayes_sigma_epsilon_sq": -2, "bayes_repeatability": 7}


def _digits(df: DataFrame) -> DataFrame:
    return df.select(*[_known(c, DIGITS[c]).alias(c) if c in DIGITS else c for c in df.columns])


@query(ANOVA)
def s20_anova(spark, d):
    return _digits(variance.anova(_windows(spark, d), "v"))


def _log_p(a: str, e: str) -> str:
    """SQL of the log posterior of two standard deviations, for a window's standardised groups; means integrated out."""
    v1, v2 = f"({a} * {a} + {e} * {e} / n1)", f"({a} * {a} + {e} * {e} / n2)"
    s, t, q = f"(1 / {v1} + 1 / {v2})", f"(z1 / {v1} + z2 / {v2})", f"(z1 * z1 / {v1} + z2 * z2 / {v2})"
    one = f"(1 + 0.25 * {s})"
    return f"""(-(n1 + n2 - 2) * ln({e}) - r / (2 * {e} * {e}) - 0.5 * (ln({v1}) + ln({v2}) + ln({one})) - 0.5 * ({q} - 0.25 * {t} * {t} / {one})
 - ({a} * {a} + {e} * {e}) / 0.5)"""


BAYES = f"""WITH e AS ({WINDOWS}),
 h AS (SELECT chra, windowa, count(v) FILTER (g = 0) AS n1, avg(v) FILTER (g = 0) AS m1, var_pop(v) FILTER (g = 0) * count(v) FILTER (g = 0) AS s1,
  count(v) FILTER (g = 1) AS n2, avg(v) FILTER (g = 1) AS m2, var_pop(v) FILTER (g = 1) * count(v) FILTER (g = 1) AS s2 FROM e GROUP BY 1, 2),
 y AS (SELECT *, (n1 * m1 + n2 * m2) / (n1 + n2) AS mean FROM h WHERE n1 > 0 AND n2 > 0),
 x AS (SELECT *, sqrt((s1 + s2 + n1 * pow(m1 - mean, 2) + n2 * pow(m2 - mean, 2)) / (n1 + n2)) AS scale FROM y),
 w AS (SELECT chra, windowa, n1::DOUBLE AS n1, n2::DOUBLE AS n2, (m1 - mean) / scale AS z1, (m2 - mean) / scale AS z2, (s1 + s2) / (scale * scale) AS r, scale FROM x),
 i AS (SELECT range::INT AS k, pow(10.0::DOUBLE, -3 + range * (log10(3) + 3) / 299) AS x FROM range(300)),
 p AS (SELECT w.chra, w.windowa, a.k AS i, e.k AS j, {_log_p("a.x", "e.x")} AS p FROM w, i a, i e),
 m AS (SELECT chra, windowa, max(p) AS top FROM p GROUP BY 1, 2),
 f AS (SELECT chra, windowa, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM p JOIN m USING (chra, windowa) WHERE p > top - 40 GROUP BY 1, 2),
 b AS (SELECT f.*, CASE WHEN i0 > 0 THEN a0.x ELSE 0 END AS alo, a1.x AS ahi, CASE WHEN j0 > 0 THEN e0.x ELSE 0 END AS elo, e1.x AS ehi FROM f
  JOIN i a0 ON a0.k = greatest(i0 - 1, 0) JOIN i a1 ON a1.k = least(i1 + 1, 299) JOIN i e0 ON e0.k = greatest(j0 - 1, 0) JOIN i e1 ON e1.k = least(j1 + 1, 299)),
 c AS (SELECT w.*, alo + (i.k + 0.5) / 300 * (ahi - alo) AS a, elo + (j.k + 0.5) / 300 * (ehi - elo) AS e FROM w JOIN b USING (chra, windowa), i, i j),
 q AS (SELECT chra, windowa, scale, a, e, {_log_p("a", "e")} AS p FROM c),
 t AS (SELECT chra, windowa, max(p) AS top FROM q GROUP BY 1, 2),
 z AS (SELECT chra, windowa, any_value(scale) AS scale, sum(exp(p - top) * a) / sum(exp(p - top)) AS a,
  sum(exp(p - top) * e) / sum(exp(p - top)) AS e FROM q JOIN t USING (chra, windowa) GROUP BY 1, 2)
 SELECT chra, windowa, 1 AS trait_id, round(pow(a * scale, 2), -2) AS bayes_sigma_alpha_sq, round(pow(e * scale, 2), -2) AS bayes_sigma_epsilon_sq,
 round(a * a / (a * a + e * e), 7) AS bayes_repeatability FROM z"""


@query(BAYES)
def s21_bayes(spark, d):
    return _digits(variance.bayes(_windows(spark, d), "v"))


@query(f"WITH v AS ({ANOVA}) SELECT v.* FROM v WHERE chra = 2 AND windowa BETWEEN 0 AND 3")
def s21b_windows(spark, d):
    sizes = spark.createDataFrame([(2, 4), (3, 9)], "chra int, windows int")
    return _digits(variance.anova(variance.windows_of(_windows(spark, d), sizes, 2), "v"))


REASONS = """WITH e AS (SELECT l_linenumber AS chra, month(l_shipdate)::INT AS windowa,
  CASE WHEN l_linenumber = 6 AND month(l_shipdate) = 2 THEN l_returnflag WHEN l_linenumber = 1 AND month(l_shipdate) = 3 THEN 'P' WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'P' END AS g,
  CASE WHEN l_linenumber = 5 AND month(l_shipdate) = 3 THEN 1.0::DOUBLE WHEN l_linenumber = 4 AND month(l_shipdate) = 4 THEN NULL ELSE l_extendedprice END AS v FROM lineitem),
 d AS (SELECT range::INT AS chra, 10 AS windows FROM range(1, 7)),
 w AS (SELECT chra, windowa, count(*) AS n, count(v) AS k, count(DISTINCT g) FILTER (v IS NOT NULL) AS groups,
  bool_or(g NOT IN ('P', 'M')) FILTER (v IS NOT NULL) AS other, min(v) = max(v) AS same FROM e GROUP BY 1, 2),
 x AS (SELECT chra, unnest(range(windows))::INT AS windowa FROM d),
 a AS (SELECT coalesce(w.chra, x.chra) AS chra, coalesce(w.windowa, x.windowa) AS windowa, x.chra IS NOT NULL AS listed, n, k, groups, other, same
  FROM w FULL JOIN x ON w.chra = x.chra AND w.windowa = x.windowa)
 SELECT chra, windowa, coalesce(n, 0) AS rows, CASE WHEN NOT listed THEN 'no dictionary row' WHEN n IS NULL THEN 'no rows' WHEN k = 0 THEN 'no values'
  WHEN other THEN 'unknown group' WHEN groups = 1 THEN 'one group' WHEN same THEN 'constant' END AS reason FROM a"""


@query(REASONS)
def s21c_window_reasons(spark, d):
    """All windows of lineitem, some of them spoilt, with why they have no result."""
    c, m = F.col("chra"), F.col("windowa")
    flags = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("chra"), F.month("l_shipdate").alias("windowa"), F.lit(1).alias("trait_id"),
        F.when((F.col("l_linenumber") == 6) & (F.month("l_shipdate") == 2), F.col("l_returnflag")).when(
            (F.col("l_linenumber") == 1) & (F.month("l_shipdate") == 3), "P").otherwise(origin(F.col("l_orderkey"))).alias("origin"), F.col("l_extendedprice").alias("v"))
    v = F.when((c == 5) & (m == 3), 1.0).when((c == 4) & (m == 4), None).otherwise(F.col("v"))
    sizes = spark.createDataFrame([(k, 10) for k in range(1, 7)], "chra int, windows int")
    return variance.window_reasons(flags.withColumn("v", v), "v", windows=sizes)


@query("SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS code, count(*) AS n FROM lineitem GROUP BY 1, 2")
def s12b_codes(spark, d):
    code = variance.category_codes(F.col("l_returnflag"), ("A", "R"))
    return _t(spark, d, "lineitem").groupBy("l_returnflag", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS chra, n_regionkey AS windows FROM nation")
def s04c_dictionary(spark, d):
    """A text file with a line for each nation, and lines that don't count: other words, an earlier line of the same chromosome."""
    at = sinks.scratch(spark, "dictionary")
    two = lambda x: F.concat_ws(" ", "n_nationkey", x)
    lines = F.explode(F.array(two(F.col("n_regionkey") + 7), two(F.lit("x")), F.concat(two("n_regionkey"), F.lit(" 9")), two("n_regionkey")))
    _t(spark, d, "nation").select(lines.alias("value")).coalesce(1).write.text(at)
    return tables.read_windows(spark, at)


SINGLE = "SELECT '{0}' AS name, CASE WHEN count(DISTINCT {1}) = 1 AND count({1}) = count(*) THEN min({1})::VARCHAR END AS value FROM lineitem"


@query(" UNION ALL ".join(SINGLE.format(*x) for x in (("flag", "l_returnflag"), ("letters", "length(l_linestatus)"), ("line", "l_linenumber"))))
def s15b_single_value(spark, d):
    """The single value of each of three columns of all line items, null where a column has several."""
    t, out = _t(spark, d, "lineitem"), []
    t = t.select(F.col("l_returnflag").alias("flag"), F.length("l_linestatus").alias("letters"), F.col("l_linenumber").alias("line"))
    for name in t.columns:
        try:
            out.append((name, str(describe.single_value(t, name))))
        except ValueError:
            out.append((name, None))
    return spark.createDataFrame(out, "name string, value string")


BOX_COX = """WITH RECURSIVE x AS (SELECT event_id, value, CASE WHEN (SELECT min(value) FROM events) > 0 THEN value ELSE value - (SELECT min(value) FROM events) + 1e-6 END AS x FROM events),
 z AS (SELECT ln(x) - (SELECT avg(ln(x)) FROM x) AS z FROM x WHERE x IS NOT NULL),
 r AS (SELECT 0 AS k, -2.0::DOUBLE AS lo, 2.0::DOUBLE AS hi UNION ALL
  SELECT k + 1, lo + (hi - lo) * greatest(j - 1, 0) / 32, lo + (hi - lo) * least(j + 1, 32) / 32
  FROM (SELECT k, lo, hi, arg_min(j, s) AS j FROM (SELECT k, lo, hi, range AS j, var_pop(CASE WHEN lo + (hi - lo) * range / 32 = 0 THEN z
    ELSE (exp((lo + (hi - lo) * range / 32) * z) - 1) / (lo + (hi - lo) * range / 32) END) AS s FROM r, range(33), z WHERE k < 8 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)),
 b AS (SELECT round((lo + hi) / 2, 4) AS lam FROM r WHERE k = 8)
 SELECT event_id, value, round((pow(x, lam) - 1) / lam, 6) AS value_boxcox FROM x, b"""


@query(BOX_COX)
def s22_box_cox(spark, d):
    out = shape.box_cox(_t(spark, d, "events").select("event_id", "value"), "value", digits=4)[0]
    return out.withColumn("value_boxcox", F.round("value_boxcox", 6))


@query("""WITH x AS (SELECT event_id, value, CASE WHEN (SELECT min(value) FROM events) > 0 THEN value ELSE value - (SELECT min(value) FROM events) + 1e-6 END AS x FROM events),
 g AS (SELECT (range - 20)::DOUBLE / 10 AS lam FROM range(41)),
 s AS (SELECT lam, (lam - 1) * sum(ln(x)) - count(x) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END)) AS llf FROM x, g WHERE x IS NOT NULL GROUP BY 1),
 b AS (SELECT arg_max(lam, llf) AS lam FROM s)
 SELECT event_id, value, round(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END, 6) AS value_boxcox FROM x, b""")
def s22_box_cox_grid(spark, d):
    out = shape.box_cox(_t(spark, d, "events").select("event_id", "value"), "value", [(k - 20) / 10 for k in range(41)])[0]
    return out.withColumn("value_boxcox", F.round("value_boxcox", 6))


@query(
    "SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) UNPIVOT INCLUDE NULLS (value FOR variable IN (o_orderstatus, o_orderpriority))"
)
def s23_wide_to_long(spark, d):
    return rows.wide_to_long(_t(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    "SELECT n_regionkey, " + ", ".join(
        f"arg_min(n_name, n_nationkey) FILTER (n_nationkey % 3 = {k}) AS \"{k}\"" for k in range(3)
    ) + " FROM nation GROUP BY 1"
)
def s24_long_to_wide(spark, d):
    n = _t(spark, d, "nation").withColumn("g", F.col("n_nationkey") % 3)
    return rows.long_to_wide(n, ["n_regionkey"], ["g"], ["n_name"], order="n_nationkey", names=[0, 1, 2])


FIRSTS = "arg_min(o_totalprice, (o_orderkey % 3 = 0)::INT * 1000000000000 + o_orderkey) FILTER (o_orderstatus = '{0}') AS \"{0}\""


@query("SELECT o_custkey, " + ", ".join(FIRSTS.format(x) for x in "FOP") + " FROM orders GROUP BY 1")
def s24b_pivot_of_files(spark, d):
    """The first price of each customer and status, in the order of two files (the longer one first) and of their rows."""
    at, orders = sinks.scratch(spark, "pivot"), _t(spark, d, "orders")
    third = F.coalesce(F.col("o_orderkey") % 3 == 0, F.lit(False))
    paths = [sinks.write(orders.where(part), f"{at}/{name}", sort=["o_orderkey"]) for name, part in (("b", ~third), ("a", third))]
    both = tables.scan_many(spark, paths, order="at")
    return rows.long_to_wide(both, ["o_custkey"], ["o_orderstatus"], ["o_totalprice"], order="at", names=["F", "O", "P"])


@query("""WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w, count(value) AS n FROM events),
 c AS (SELECT least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS count FROM events, s WHERE value IS NOT NULL GROUP BY 1)
 SELECT range::INT AS bin, coalesce(count, 0)::BIGINT AS count, round(coalesce(count, 0) / (n * w), 8) AS density FROM range(30), s LEFT JOIN c ON range = bin""")
def s25a_histogram(spark, d):
    return shape.histogram(_t(spark, d, "events"), "value").select("bin", "count", F.round("density", 8).alias("density"))


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd FROM events)
 SELECT range::INT AS i, round(lo + range * (hi - lo) / 99, 6) AS x, round(exp(-pow((lo + range * (hi - lo) / 99 - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 8) AS density FROM range(100), s""")
def s25b_normal_curve(spark, d):
    return shape.normal_curve(_t(spark, d, "events"), "value").select("i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
 p AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM r)
 SELECT i, round({sql_quantile("p")}, 8) AS theoretical, round(value, 8) AS sample FROM p""")
def s25c_qq_points(spark, d):
    return _rounded(shape.qq_points(_t(spark, d, "events"), "value"), 8)


@query(f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
 k AS (SELECT DISTINCT CASE WHEN n <= 256 THEN range ELSE floor(range * (n - 1) / 255.0::DOUBLE + 0.5)::BIGINT END AS place FROM range(256), (SELECT max(n) AS n FROM r)),
 p AS (SELECT place + 1 AS i, value, CASE WHEN place + 1 = n THEN pow(0.5, 1.0 / n) WHEN place = 0 THEN 1 - pow(0.5, 1.0 / n)
  ELSE (place + 1 - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM r JOIN k USING (place))
 SELECT i, round({sql_quantile("p")}, 8) AS theoretical, round(value, 8) AS sample FROM p""")
def s25c_qq_picked(spark, d):
    return _rounded(shape.qq_picked(_t(spark, d, "events"), "value"), 8)


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events)
 SELECT round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
 max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers FROM events, q WHERE value IS NOT NULL GROUP BY ALL""")
def s25d_box(spark, d):
    out = shape.box_statistics(_t(spark, d, "events"), "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC NULLS FIRST LIMIT 25")
def s26_preview(spark, d):
    return rows.preview(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate, o_orderkey", True, 25)


@query("SELECT concat_ws(chr(9), o_orderkey, coalesce(o_orderstatus, 'null'), coalesce(o_totalprice::VARCHAR, 'null')) AS line FROM orders")
def s08_console_lines(spark, d):
    return rows.lines(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("SELECT * FROM nation ORDER BY n_name DESC LIMIT 5")
def s26b_sort_by_map(spark, d):
    n = _t(spark, d, "nation").withColumn("m", F.create_map(F.lit("name"), F.col("n_name")))
    return rows.preview(n, "m", True, 5).drop("m")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def s28_union(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return rows.union_strict(
        n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
        r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")),
    )


QC = """WITH s AS (SELECT l_partkey AS k, count(*) AS c, count(DISTINCT l_quantity) * 100.0 / count(l_partkey) AS r FROM lineitem GROUP BY 1)"""


@query(
    QC
    + """ SELECT l_partkey AS trait_id, l_quantity AS trait_value, l_orderkey AS f2, CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'P' END AS origin
 FROM lineitem WHERE l_partkey NOT IN (SELECT k FROM s WHERE c < 28 OR r < 80)"""
)
def s31_quality_control(spark, d):
    t = _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("trait_id"), F.col("l_quantity").alias("trait_value"), F.col("l_orderkey").alias("f2")
    )
    return describe.quality_control(t, "trait_id", "trait_value", 28, 80.0)[0]


@query(QC + " SELECT k AS trait_id, c AS count, round(r, 6) AS ratio FROM s WHERE c < 28 OR r < 80")
def s31_deleted_groups(spark, d):
    t = _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("trait_id"), F.col("l_quantity").alias("trait_value"), F.col("l_orderkey").alias("f2")
    )
    return _rounded(describe.quality_control(t, "trait_id", "trait_value", 28, 80.0)[1])


@query("SELECT doc_id, length(text) AS length FROM documents")
def s32_string_lengths(spark, d):
    return rows.string_lengths(_t(spark, d, "documents").select("doc_id", "text"), "text").select(
        "doc_id", F.col("length").cast("bigint").alias("length")
    )
