"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models of random strings.

Two first-order Markov models over the characters of ALPHABET are trained from labelled
samples: random strings (hex and base64 digests of numbers) and ordinary identifiers
(words of IDENTIFIERS joined as programs join them). Long tokens of a text, without the spans
of fixed patterns, are scored by the log-likelihood ratio of the models for each step between
characters, less LEAST. Each stretch whose sum reaches EVIDENCE is a span of kind random, however long the names
beside it are: a running maximum ends where the sum has fallen by FALL. A stretch is carried on to the joint (JOINTS) or end beside it
if that is near. A token without such a stretch is a span if its mean ratio is LEAST or more. Either needs LETTERS letters, and a digit or TURNS
changes from small to large letters.

Spans are in code points, end exclusive, and have their place in UTF-8 bytes as well. Places are running sums in rounds that double
their reach, and new texts are joined from pieces once, so the work grows with a text's length and its number of
spans (times that number's logarithm), not its square. Null and empty texts have no span. Very long
texts are whole; no shuffle moves a text. The results replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The patterns, in the order of kinds, and the least length of what is kept.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
JOINTS = 64  # codes from this on join names: / _ = -
LEAST = 0.35
LENGTH, EVIDENCE, FALL, JOINT = 20, 9.0, 8.0, -0.5  # least characters and sum of a stretch; its end; the score of a step at a joint
LETTERS, TURNS = 6, 4  # least letters of a random span; without a digit it needs so many small letters before large ones
#: Words of ordinary identifiers and texts, for the labelled samples.
IDENTIFIERS = (
    "user account name value index count total number first last next previous current default create update delete remove insert select filter "
    "group order limit offset table column row record field schema database connection session request response server client message error warning "
    "debug info handler manager factory builder service controller model view template render parse format convert encode decode read write open close "
    "file path directory image video audio document page section header content article comment author title description category keyword language "
    "country region address street phone email website profile setting option config parameter argument function method class object instance property "
    "attribute element component module package library version release build deploy test result status state event action listener callback promise "
    "thread process memory buffer stream queue stack graph node edge weight height width length size color font style border margin position transform "
    "international administration responsibility understanding communication environmental representative transportation characteristics approximately "
    "haus wasser arbeit zeit jahr stadt land schule kirche freund bruder schwester wirtschaft regierung ordnung leistung verkehr strasse garten bahnhof "
    "krankenhaus geschwindigkeit begrenzung durchschnitt entscheidung wahrscheinlich nachricht sprache schreiben zwischen gleichung werkzeug handel "
    "nevertheless entwicklung verantwortung wissenschaft gesellschaft beziehungen unternehmen developpement gouvernement informacion desarrollo"
).split()


def _samples(spark: SparkSession, n: int = 1200) -> DataFrame:
    """label 1: random strings; label 0: ordinary identifiers. The same rows each time."""
    rows = spark.range(4 * n).withColumn("h", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512))
    digest = F.base64(F.unhex("h"))
    long = F.when(F.col("id") % 2 == 0, F.substring(digest, 1, 40)).otherwise(F.substring("h", 1, 40))
    names = F.split(F.lit(" ".join(IDENTIFIERS)), " ")
    picked = [F.element_at(names, (F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int") % len(IDENTIFIERS) + 1)) for k in range(4)]
    plain = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *picked))
        .when(F.col("id") % 4 == 1, F.concat(picked[0], *[F.initcap(x) for x in picked[1:]]))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", *picked, F.expr("cast(id % 100 as string)")))
        .otherwise(F.upper(F.concat_ws("_", *picked)))
    )
    return rows.select(F.lit(1).alias("label"), long.alias("s")).unionByName(rows.select(F.lit(0).alias("label"), plain.alias("s")))


def train(spark: SparkSession, samples: DataFrame | None = None) -> list[float]:
    """The log-likelihood ratio of each step between two characters, by WIDTH * first + second; 0 is any other character.

    samples: label (1 random, 0 ordinary) and s. At most 2 * WIDTH * WIDTH counts reach the driver.
    """
    samples = _samples(spark) if samples is None else samples
    step = samples.where("length(s) > 1").select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr("s", i, F.lit(1)))
    counts = step.select("label", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b")).groupBy("label", "a", "b").count().collect()
    import math

    table = [[[0.5] * WIDTH for _ in range(WIDTH)] for _ in range(2)]
    for r in counts:
        table[r["label"]][r["a"]][r["b"]] += r["count"]
    ratio = lambda a, b: math.log(table[1][a][b] / sum(table[1][a])) - math.log(table[0][a][b] / sum(table[0][a]))
    return [round(ratio(a, b), 6) for a in range(WIDTH) for b in range(WIDTH)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's steps."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("t")),
        lambda acc, c: F.struct(
            c.alias("a"), F.when(acc["a"] < 0, acc["t"]).otherwise(acc["t"] + F.element_at(table, acc["a"] * WIDTH + c + 1)).alias("t")
        ),
    )
    return total["t"] / F.greatest(F.length(token) - 1, F.lit(1))


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, join) -> Column:
    """Running sums or maxima (join) of an array of ints from 0 on, each with its own: every round doubles the reach."""

    def reach(held, k):
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(held, F.concat(F.array_repeat(F.lit(0), by), F.slice(held, F.lit(1), F.size(held) - by)), join)

    rounds = lambda v: F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)
    return _bound(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, reach)).otherwise(v))


def _bytes(data: Column, start: Column, end: Column) -> Column:
    """The text of these bytes; a string's own substr would count characters from its start each time."""
    return F.substr(data, start + 1, F.greatest(end - start, F.lit(0))).cast("string")


def stretches(token: Column, data: Column, model: list[float]) -> Column:
    """The token's random stretches: start and end. data: the token as bytes, one for each character."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    many = F.greatest(F.length(token) - 1, F.lit(0))
    joint = lambda a, c: (a >= JOINTS) | (c >= JOINTS)
    score = lambda a, c: F.when(joint(a, c), F.lit(JOINT)).otherwise(F.element_at(table, a * WIDTH + c + 1) - LEAST)
    scores = _bound(codes, lambda x: F.zip_with(F.slice(x, F.lit(1), many), F.slice(x, F.lit(2), many), score))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    first = F.struct(
        F.lit(0).alias("i"),
        F.lit(0.0).alias("t"),
        F.lit(0.0).alias("best"),
        F.lit(0).alias("start"),
        F.lit(0).alias("end"),
        none.alias("out"),
    )

    def kept(best, start, end, out):
        return F.when(best >= EVIDENCE, F.concat(out, F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(out)

    def step(acc, x):
        t, i = acc["t"] + x, acc["i"]
        best, end = F.greatest(acc["best"], t), F.when(t > acc["best"], i + 2).otherwise(acc["end"])
        fallen = (t <= 0) | (t < best - FALL)
        put = lambda yes, no, name: F.when(fallen, yes).otherwise(no).alias(name)
        out = put(kept(best, acc["start"], end, acc["out"]), acc["out"], "out")
        return F.struct(
            (i + 1).alias("i"),
            put(F.lit(0.0), t, "t"),
            put(F.lit(0.0), best, "best"),
            put(i + 1, acc["start"], "start"),
            put(i + 1, end, "end"),
            out,
        )

    found = F.aggregate(scores, first, step, lambda acc: kept(acc["best"], acc["start"], acc["end"], acc["out"]))

    def widened(x):
        # nine characters before and twelve behind tell all that the patterns ask
        head = _bytes(data, F.greatest(x["start"] - 9, F.lit(0)), x["start"])
        tail, rest = _bytes(data, x["end"], F.least(x["end"] + 12, F.length(data))), F.length(data) - x["end"]
        near = F.length(F.regexp_extract(head, "(?:^|[/_=-])([A-Za-z0-9+]{0,8})$", 1))
        before = F.when(x["start"] <= 4, F.length(F.regexp_extract(head, "^[/_=-]*(.*)$", 1))).otherwise(near)
        after = F.when(rest <= 4, rest).otherwise(F.length(F.regexp_extract(tail, "^([A-Za-z0-9+]{0,8}(?:==?$)?)(?:$|[/_=-])", 1)))
        return F.struct((x["start"] - before).alias("start"), (x["end"] + after).alias("end"))

    def like_a_key(s: Column) -> Column:
        # rules, digit runs, article numbers and names of letters alone are none, whatever the models say
        letters, digits, turns = (F.regexp_count(s, F.lit(p)) for p in ("[A-Za-z]", "[0-9]", "[a-z][A-Z]"))
        return (letters >= LETTERS) & ((digits > 0) | (turns >= TURNS))

    wide = F.filter(F.transform(found, widened), lambda x: (x["end"] - x["start"] >= LENGTH) & like_a_key(_bytes(data, x["start"], x["end"])))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(token).alias("end")))
    return _bound(wide, lambda w: F.when(F.size(w) > 0, w).when(like_a_key(token) & (likelihood_ratio(token, model) >= LEAST), whole).otherwise(none))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Every match, leftmost and without overlaps. The gaps between them give the places."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,s:string,at:int,to:int>>)")

    def placed(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        add = lambda a, b: a + b
        size = lambda f: lambda g, m: f(g) + f(m)
        ends = _bound(
            gaps,
            lambda g: F.zip_with(
                _running(F.zip_with(g, found, size(F.length)), add),
                _running(F.zip_with(g, found, size(F.octet_length)), add),
                lambda c, o: F.struct(c.alias("c"), o.alias("o")),
            ),
        )
        return F.zip_with(
            found,
            ends,
            lambda m, e: F.struct(
                (e["c"] - F.length(m)).alias("start"),
                F.lit(kind).alias("kind"),
                e["c"].alias("end"),
                m.alias("s"),
                (e["o"] - F.octet_length(m)).alias("at"),
                e["o"].alias("to"),
            ),
        )

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _replaced(text: Column, spans: Column, filler) -> Column:
    """text with something else in the place of its spans (sorted): filler(span, end of those before it)."""

    def whole(data, xs):
        upto = lambda name: F.concat(F.array(F.lit(0)), _running(F.transform(xs, lambda x: x[name]), lambda a, b: F.greatest(a, b)))
        before = F.zip_with(upto("end"), upto("to"), lambda c, o: F.struct(c.alias("c"), o.alias("o")))

        def joined(seen):
            pieces = F.zip_with(xs, F.slice(seen, F.lit(1), F.size(xs)), lambda x, p: F.concat(_bytes(data, p["o"], x["at"]), filler(x, p["c"])))
            return F.concat(F.array_join(pieces, ""), _bytes(data, F.element_at(seen, -1)["o"], F.length(data)))

        return _bound(before, joined)

    return F.when(F.size(spans) > 0, _bound(text.cast("binary"), lambda data: _bound(spans, lambda xs: whole(data, xs)))).otherwise(text)


def with_spans(docs: DataFrame, model: list[float], text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds base and spans: arrays of (start, kind, end, s, and its first byte and end in bytes), by start and kind."""
    docs = docs.select(shared.others(docs, (base, spans)))
    long, rest = shared.unused(docs, "_long"), shared.unused(docs, "_rest")
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_spans(body, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 8)
    access = F.filter(_spans(body, ACCESS, 1), lambda x: F.length(x["s"]) >= 16)
    found = docs.withColumn(base, F.array_sort(F.concat(assign, access, _spans(body, HEX, 2))))
    # spaces for base spans: what is left of long tokens beside them is found at its own place
    blank = lambda x, end: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], end), F.lit(0)))
    found = found.withColumn(rest, _replaced(body, F.col(base), blank))
    found = found.withColumn(long, _spans(F.col(rest), RANDOM, 3))

    def parts(x):
        piece = lambda data, y: F.struct(
            (x["start"] + y["start"]).alias("start"),
            x["kind"].alias("kind"),
            (x["start"] + y["end"]).alias("end"),
            _bytes(data, y["start"], y["end"]).alias("s"),
            (x["at"] + y["start"]).alias("at"),
            (x["at"] + y["end"]).alias("to"),
        )
        return _bound(x["s"].cast("binary"), lambda data: F.transform(stretches(x["s"], data, model), lambda y: piece(data, y)))

    more = F.flatten(F.transform(long, parts))
    return found.withColumn(spans, F.array_sort(F.concat(base, more))).drop(long, rest)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
        ),
        ",",
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with a mark in the place of each run of overlapping spans; n_chars follows."""
    base, spans = shared.unused(docs, "_base"), shared.unused(docs, "_spans")
    found = with_spans(docs, train(docs.sparkSession), text, base, spans)
    clean = _replaced(F.col(text), F.col(spans), lambda x, end: F.when(x["start"] >= end, F.lit(mark)).otherwise(F.lit("")))
    out = found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
