"""Mixing sources to target weights by a low-discrepancy schedule.

The slots of the mix are numbered 0 to N - 1, N a power of two. The van der Corput
point of a slot (its number's bits in reverse, over N) falls into one interval of
the cumulative target weights: that source has the slot. Points in any interval
are spread evenly over the slots, so every stretch of the mix is near the weights.
A source's slots are ranked; the slot of rank r takes the r-th of equal blocks of
tokens of the source's documents in shuffled order, read again from the start
when they end. Blocks of one source differ by one token at most. mixed_documents
gives its rows in the order of the slots, so every stretch of what is written is near the weights too. Its texts
are shuffled once: where each row goes is written in sorted arrays, a file for each partition of rows, which the tasks that read them map.

The shuffle orders documents by md5 of the seed, doc_id and size. A source's documents
are cut into `buckets` by that hash, so prefix sums never bring a source to one
task, and rows of one doc_id only as far as they have one size. One row for each source is ordered in one task. Null doc_ids are hashed as empty; rows that tie in all of it are alike. Null
or empty texts have size 0 and are never taken. Null is a source of its own, the
last. Tables may be empty. The results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textbatch import slices

WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "taken", "first_slot")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: _sid (its place by code point, null last), source_size, target, _total (the target in whole tokens).

    Targets share `share` of all sizes by weight; those that reach `cap` times
    their source's size stop there and the rest is shared again. In order of
    cap * size / weight the stopped sources come first, so one pass finds them.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_sid", F.row_number().over(one).cast("long"))
    out = out.withColumn("w", table[((F.col("_sid") - 1) % len(weights)).cast("int")]).withColumn("full", F.col("source_size") * F.lit(cap)).withColumn(
        "ratio", F.col("full") / F.col("w")
    )
    order = Window.orderBy("ratio", "_sid")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    out = out.withColumn("level", rest / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "_sid", "level"))).over(every)["level"]
    out = out.withColumn("target", F.when(level.isNull(), F.col("full")).otherwise(F.least("full", level * F.col("w"))))
    return out.select("source", "_sid", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("_total"))


def schedule(targets: DataFrame, slots: int, cells: int = 4096, chunk: int = 4096) -> DataFrame:
    """The mix's slots in order: slot, _sid, rank (of the slot among its source's), n (that source's slots).

    slots is a power of two. A source with a target but no slot gets one after the others.
    """
    bits = slots.bit_length() - 1
    whole = Window.orderBy("_sid")
    upto = F.sum("target").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy())
    ranges = targets.where("_total > 0").withColumn("hi", F.floor(upto / total * slots + 0.5).cast("long"))
    ranges = ranges.withColumn("lo", F.lag("hi", 1, 0).over(whole)).select("_sid", "lo", "hi")
    width = max(1, slots // cells)
    spread = ranges.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    point = F.lit(0).cast("long")
    for k in range(bits):
        point = point + F.when(F.col("slot").bitwiseAND(F.lit(1 << k)) != 0, F.lit(1 << (bits - 1 - k))).otherwise(F.lit(0))
    points = targets.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn(
        "cell", F.floor(F.col("point") / width)
    )
    owned = points.join(spread, "cell").where("point >= lo AND point < hi").select("_sid", "slot")
    extra = ranges.where("hi <= lo").select("_sid", (F.col("_sid") + slots).alias("slot"))
    owned = owned.unionByName(extra).withColumn("chunk", F.floor(F.col("slot") / chunk))
    part = owned.groupBy("_sid", "chunk").agg(F.count(F.lit(1)).alias("c"))
    each = Window.partitionBy("_sid")
    part = part.withColumn(
        "base", F.sum("c").over(each.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ).withColumn("n", F.sum("c").over(each)).drop("c")
    rank = F.row_number().over(Window.partitionBy("_sid", "chunk").orderBy("slot")) - 1
    return owned.withColumn("r", rank).join(part, ["_sid", "chunk"]).select("slot", "_sid", (F.col("base") + F.col("r")).alias("rank"), "n")


class Mix(NamedTuple):
    placed: DataFrame  # the rows, with _sid, _start (their first token in their source's order), source_size, target, _total and n (their source's slots)
    pieces: DataFrame  # a row for each time a row is taken: _row, _sid, _start, lo and hi in the tokens that the source gives
    plan: DataFrame  # slot, _sid and rank of each block
    slots: int
    total: int  # tokens


def _rank(x) -> F.Column:
    """The rank of the block that holds token x: the first _total % n blocks are longer by one."""
    q, m = F.expr("_total div n"), F.expr("_total % n")
    return F.when(x < m * (q + 1), F.floor(x / (q + 1))).otherwise(m + F.floor((x - m * (q + 1)) / F.greatest(q, F.lit(1))))


def _mixed(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, block_tokens: int, buckets: int, seed: str) -> Mix:
    """The mix of sized: doc_id, source, size and _row (anything)."""
    spark = sized.sparkSession
    sizes = shared.saved(sized.groupBy("source").agg(F.sum("size").alias("size")), shared.folder(spark, "mix-sizes"))
    targets = shared.saved(source_targets(sizes, weights, share, cap), shared.folder(spark, "mix-targets"))
    total = targets.agg(F.sum("_total")).first()[0] or 0
    slots = 1 << max(0, (-(-total // block_tokens) - 1)).bit_length()
    plan = schedule(targets, slots)
    info = targets.join(plan.groupBy("_sid").agg(F.max("n").alias("n")), "_sid", "left")

    rows = sized.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size"))))
    rows = rows.withColumn("_bucket", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    named = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    info = info.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    sums = named.groupBy("_name", "_bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("base", F.sum("s").over(before) - F.col("s")).drop("s").join(info, "_name")
    inside = Window.partitionBy("_name", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("_at", F.sum("size").over(inside) - F.col("size")).join(sums, ["_name", "_bucket"])
    placed = placed.withColumn("_start", F.col("base") + F.col("_at"))

    pieces = placed.where("size > 0 AND n IS NOT NULL").select("_row", "_sid", "_start", "size", "source_size", "_total", "n")
    times = F.sequence(F.col("_start"), F.col("_start") + F.lit(int(cap + 0.999)) * F.col("source_size"), F.col("source_size"))
    pieces = pieces.withColumn("lo", F.explode(times)).withColumn("hi", F.least(F.col("lo") + F.col("size"), "_total")).where("lo < hi")
    return Mix(placed, pieces, plan, slots, total)


def mix(
    docs: DataFrame,
    text: str | None = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 1024,
    buckets: int = 4096,
    seed: str = "mix",
) -> DataFrame:
    """Adds size, source_size, target, taken (the words the mix takes of this row, repeats counted) and first_slot (of the block with its first word; null if none is taken) to docs.

    docs has doc_id and source, and either the text column or, with text=None, size.
    """
    size = F.col("size") if text is None else F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
    held = shared.others(docs, RESULTS, "doc_id", "source")
    # whatever the other columns are called, they're out of the way in one
    sized = docs.select("doc_id", "source", size.cast("long").alias("size"), (F.struct(*held) if held else F.lit(0)).alias("_row"))
    found = _mixed(sized, weights, share, cap, block_tokens, buckets, seed)
    blocks = found.pieces.drop("_row").withColumn("rank", F.explode(F.sequence(_rank(F.col("lo")), _rank(F.col("hi") - 1))))
    first = F.expr("rank * (_total div n) + least(rank, _total % n)")
    last = F.expr("(rank + 1) * (_total div n) + least(rank + 1, _total % n)")
    words = F.sum(F.least("hi", last) - F.greatest("lo", first))
    # a source's slots grow with their ranks, and a row's first time comes before its second
    blocks = blocks.join(found.plan.select("slot", "_sid", "rank"), ["_sid", "rank"])
    taken = blocks.groupBy("_sid", "_start").agg(words.alias("taken"), F.min("slot").alias("first_slot"))
    out = [F.col(f"_row.`{c}`") if c in held else c for c in shared.others(docs, RESULTS)] + [*RESULTS]
    none = F.lit(0).cast("long")
    some = found.placed.where("size > 0").join(taken, ["_sid", "_start"], "left").withColumn("taken", F.coalesce("taken", none))
    nothing = found.placed.where("NOT size > 0").withColumn("taken", none).withColumn("first_slot", F.lit(None).cast("long"))
    return some.select(*out).unionByName(nothing.select(*out))


def mixed_documents(
    docs: DataFrame,
    text: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 1024,
    buckets: int = 4096,
    seed: str = "mix",
    slot: str | None = None,
    part_tokens: int = 1 << 24,
) -> DataFrame:
    """The mix as rows of docs' own columns: a row for each time a document is taken, the last with only the words taken.

    Rows come in the mix's order: partition by partition (of about part_tokens tokens, if that makes more than Spark's
    shuffle partitions), sorted in each by the slot of the block with their first word. slot: the name of a column to add for that slot.
    """
    spark = docs.sparkSession
    row = shared.unused(docs, "_row")
    at = shared.folder(spark, "mix-docs")
    kept = shared.saved(docs.withColumn(row, F.monotonically_increasing_id()), f"{at}/docs")  # numbers are fixed once written
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = shared.saved(kept.select("doc_id", "source", size, F.col(row).alias("_row")), f"{at}/rows")
    found = _mixed(sized, weights, share, cap, block_tokens, buckets, seed)
    times = found.pieces.withColumn("rank", _rank(F.col("lo"))).join(found.plan.select("slot", "_sid", "rank"), ["_sid", "rank"])
    part_of = F.shiftright("_row", 33).alias("of")  # the partition that wrote a row
    times = times.select(part_of, "_row", "slot", "lo", (F.col("hi") - F.col("lo")).alias("part"), "size")
    none = [F.lit(None).cast("long").alias(c) for c in TIMES]
    every = sized.select(part_of).distinct().select("of", *none)  # so that each partition's file is there
    shared.saved(times.unionByName(every).groupBy("of").applyInPandas(_write_times(f"{at}/times"), "of long, n long"), f"{at}/times-done").count()

    # whatever the columns of docs are called, they're out of the way in one
    rest = [c for c in docs.columns if c != text]
    packed = kept.select(F.col(row).alias("_row"), F.col(text).alias("_body"), F.struct(*rest).alias("_doc"))
    schema = T.StructType([*packed.schema, *(T.StructField(c, T.LongType()) for c in TIMES[1:])])
    mixed = packed.mapInArrow(_taken(f"{at}/times"), schema)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.total // part_tokens)
    place = F.least(F.col("slot"), F.lit(found.slots - 1))  # sources of less than half a slot come last
    mixed = mixed.repartitionById(parts, (place * parts / found.slots).cast("int")).sortWithinPartitions("slot", "lo")
    body = F.col("_body")
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("part").cast("int")), " ")
    mixed = mixed.withColumn("_text", F.when(F.col("part") >= F.col("size"), body).otherwise(cut))
    length = lambda c: F.length("_text").cast(docs.schema[c].dataType)
    new = {text: F.col("_text"), "n_chars": length("n_chars") if "n_chars" in docs.columns else None}
    out = [(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns if c != slot]
    return mixed.select(*out, *([F.col("slot").alias(slot)] if slot else []))


TIMES = ("_row", "slot", "lo", "part", "size")


def _write_times(at: str):
    """Writes a partition's times, by row and place: each column of TIMES, one after another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = int(rows["of"].iloc[0])
        rows = rows[rows["_row"].notna()].sort_values(["_row", "lo"])
        shared.put(f"{at}/{of}", [rows[c].to_numpy(np.int64) for c in TIMES])
        return pd.DataFrame({"of": [of], "n": [len(rows)]})

    return run


def _taken(at: str):
    """Each row as often as it's taken, with its times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shared.Files(at)
        for batch in slices(batches, "_body"):
            rows = batch["_row"].to_numpy(zero_copy_only=False)
            for of in np.unique(rows >> 33).tolist():
                here = np.flatnonzero(rows >> 33 == of)
                table = files[of].view(np.int64).reshape(len(TIMES), -1)
                first, behind = (np.searchsorted(table[0], rows[here], side) for side in ("left", "right"))
                times = behind - first
                ends = np.cumsum(times)
                place = np.arange(ends[-1]) + np.repeat(first - (ends - times), times)
                taken = batch.take(pa.array(np.repeat(here, times)))
                columns = [*taken.columns, *(pa.array(table[k][place]) for k in range(1, len(TIMES)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *TIMES[1:]])

    return run
