"""Source divergence audit: how a language's sources differ in the terms they use.

Terms are runs of bytes a-z and those beyond ASCII, A-Z lower-cased; null texts, languages and sources are read as empty. Terms are
counted on slices of a few megabytes of text and summed over (lang, source, term); a language keeps those that enough of its
documents hold. A group's share of a term, in billionths, is smoothed: a term that it lacks has the group's baseline share.

Pairs: the distance of two groups over all kept terms is that of their baselines times the number of terms, plus corrections
for terms that either has. Those of a single group against the other's baseline are summed over its distinct shares (few, as equal
counts give equal shares); those of a term that both have come from a join on the term. No row is made for a term that neither has,
or only one; the number of rows of the join is the sum over kept terms of the pairs of sources that use it, of which one is made for each two.

Terms: a group's largest excesses over its language are found by radix selection. Histograms of ten bits of the value, for all
groups at once, give the value of the k-th; where values equal to it are many, histograms of two UTF-8 bytes of the
terms narrow them. So only counts are shuffled, and a group is never sorted; at most k + TIES rows of it are numbered at the end.

Arithmetic is on whole numbers throughout (shares by division of decimals of up to 38 digits). Equal rows count each by itself. A group
whose texts are null or empty has a row in every pair; without kept terms every distance is 0. Empty tables give none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textbatch import only, slices, unique, words

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
SLICE = 4 << 20  # bytes of text counted at a time
DIGIT, BITS = 10, 30  # bits of a histogram, and of a value: at most SCALE + 1
BYTES, TIES = 2, 1024  # UTF-8 bytes of a histogram of equal values; so many of them, beyond those wanted, are sorted at once
GAPS = only((97, 122))
GROUP = ["lang", "source"]
COUNTS = "lang string, source string, term string, c long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's terms by group, with how often and in how many documents they are; a row without a term for each group."""
    for batch in slices(batches, "text", SLICE):
        found = words(batch["text"], True, GAPS)
        lang, source = (pc.fill_null(batch[c], "").dictionary_encode() for c in GROUP)
        pair = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy(zero_copy_only=False)
        group, first = np.unique(pair, return_index=True)
        own, n = np.searchsorted(group, pair), max(len(found.distinct), 1)
        doc = np.repeat(np.arange(len(pair)), np.diff(found.offsets))
        key, times = unique(doc * n + found.codes)
        cell, place, docs = np.unique(own[key // n] * n + key % n, return_inverse=True, return_counts=True)
        count = np.bincount(place, times, len(cell)).astype(np.int64)
        rows = np.r_[first[cell // n], first].astype(np.int64)
        terms = pa.concat_arrays([found.distinct.cast(pa.string()).take(pa.array(cell % n)), pa.nulls(len(first), pa.string())])
        zeros = np.zeros(len(first), np.int64)
        columns = [pc.fill_null(batch[c].take(pa.array(rows)), "") for c in GROUP] + [terms, pa.array(np.r_[count, zeros]), pa.array(np.r_[docs, zeros])]
        yield pa.RecordBatch.from_arrays(columns, names=[*GROUP, "term", "c", "docs"])


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exactly; null if v is 0."""
    whole = lambda x: x.cast("decimal(20,0)")
    top, bottom = whole(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), whole(n) + whole(v) * F.lit(SMOOTH).cast("decimal(1,0)")
    return F.when(v > 0, F.call_function("div", top, bottom) + 1)


def kept_counts(docs: DataFrame, least: int, at: str) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, c, total) of kept terms that a group has, and (lang, source, n, v, base, lang_n) of every group."""
    some = docs.select("lang", "source", "text").mapInArrow(_counted, COUNTS)
    counts = shared.saved(some.groupBy(*GROUP, "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")), f"{at}/counts")
    of_term = Window.partitionBy("lang", "term")  # at most a row for each source
    known = counts.where("term IS NOT NULL").withColumn("held", F.sum("docs").over(of_term)).withColumn("total", F.sum("c").over(of_term))
    kept = shared.saved(known.where(F.col("held") >= least).select(*GROUP, "term", "c", "total"), f"{at}/kept")
    sums = kept.groupBy(*GROUP).agg(F.sum("c").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = counts.where("term IS NULL").select(*GROUP).join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    return kept, shared.saved(groups.withColumn("base", share(F.lit(0), F.col("n"), F.col("v"))), f"{at}/groups")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of each two sources of a language, both ways. kept has p."""
    side = lambda df, name: df.select("lang", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "lang"])
    some = groups.select("lang", "source", "v", "base")
    two = side(some, "a").join(side(some, "b"), "lang")  # as many rows as the result has, and one for each group
    apart = F.abs(F.col("a_base") - F.col("b_base"))
    ordered = lambda value: (F.least("a_source", "b_source").alias("x"), F.greatest("a_source", "b_source").alias("y"), value.cast("long").alias("value"))
    base = two.where("a_source < b_source").select("lang", *ordered(F.coalesce(F.col("a_v") * apart, F.lit(0))))
    levels = kept.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("terms")).withColumnsRenamed({"source": "a_source", "p": "a_p"})
    one = two.where("a_source <> b_source").join(levels, ["lang", "a_source"])
    one = one.select("lang", *ordered(F.col("terms") * (F.abs(F.col("a_p") - F.col("b_base")) - apart)))
    held = kept.join(some.drop("v"), GROUP).select("lang", "term", "source", "p", "base")
    put = lambda name: held.select("lang", "term", *[F.col(c).alias(f"{name}_{c}") for c in ("source", "p", "base")])
    both = put("a").join(put("b"), ["lang", "term"]).where("a_source < b_source")
    d = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = both.select("lang", *ordered(d("a_p", "b_p") - d("a_p", "b_base") - d("a_base", "b_p") + d("a_base", "b_base")))
    sums = base.unionByName(one).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return sums.select("lang", way.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def _narrowed(rows: DataFrame, by: list[str], digit: Column, largest: bool) -> DataFrame:
    """Of a histogram of each group's rows (with need): the digit that holds the need-th row, and which one of its own rows that is."""
    bars = rows.groupBy(*by, "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"))
    order = F.col("digit").desc() if largest else F.col("digit").asc()
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("upto", F.sum("c").over(upto))
    return bars.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need"))).select(*by, "digit", (F.col("need") - F.col("upto") + F.col("c")).alias("need"))


def largest(rows: DataFrame, by: list[str], value: str, item: str, k: int, at: str, ties: int = TIES) -> DataFrame:
    """The k rows of the largest value (0 to 2 ** BITS - 1) of each group, by item where values are equal, with their rank. An item is once in a group."""
    rows = shared.saved(rows, f"{at}/rows")
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > k)  # smaller groups are whole
    state = wide.select(*by, F.lit(0).cast("long").alias("above"), F.lit(k).cast("long").alias("need"))
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inside = rows.join(state, by).where(F.shiftright(value, shift + DIGIT) == F.col("above"))
        digit = F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1)
        state = _narrowed(inside, [*by, "above"], digit, True).select(*by, (F.col("above") * (1 << DIGIT) + F.col("digit")).alias("above"), "need")
        state = shared.saved(state, f"{at}/state-{shift}")
    threshold = state.withColumnRenamed("above", "least")
    told = rows.join(threshold, by, "left")
    sure = told.where(F.col("least").isNull() | (F.col(value) > F.col("least"))).select(*rows.columns)
    equal = shared.saved(told.where(F.col(value) == F.col("least")).drop("least"), f"{at}/equal")
    for turn in range(1 << 30):
        over = equal.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("n")).where(F.col("c") > F.col("n") + ties).select(*by)
        if over.isEmpty():
            break
        chunk = F.hex(F.substring(F.encode(item, "UTF-8"), 1 + turn * BYTES, BYTES))  # an ended item comes first
        many = equal.join(over, by, "left_semi").withColumn("digit", chunk)
        found = shared.saved(_narrowed(many, by, F.col("digit"), False).withColumnsRenamed({"digit": "at", "need": "left"}), f"{at}/bytes-{turn}")
        many = many.join(found, by)
        sure = sure.unionByName(many.where("digit < at").select(*rows.columns))
        rest = many.where("digit = at").select(*rows.columns, F.col("left").alias("need"))
        equal = shared.saved(equal.join(over, by, "left_anti").unionByName(rest), f"{at}/equal-{turn}")
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(item))
    ranked = sure.unionByName(equal.select(*rows.columns)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: each source's distance from the others of its language, and the terms it uses more than its language does."""
    at = shared.folder(docs.sparkSession, "divergence")
    kept, groups = kept_counts(docs, least, at)
    placed = kept.join(groups, GROUP)
    placed = placed.select(
        *GROUP, "term", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")
    )
    placed = shared.saved(placed, f"{at}/shares")
    two = pairs(placed.drop("q"), groups).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item")))
    )
    more = placed.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = largest(more, GROUP, "value", "item", top, f"{at}/terms")
    parts = [df.select(*GROUP, F.lit(name).alias("part"), "item", "value", "rank") for name, df in (("pair", two), ("term", terms))]
    return parts[0].unionByName(parts[1])
