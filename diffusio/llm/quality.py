"""Quality rules: fixed base rules and adaptive ones from mergeable quantile sketches.

Everything is DataFrame functions. Measures of each text are computed once and written as a
table. Each (language, source) gets a quantile sketch of each measure over all its rows: counts of
buckets whose bounds grow by two percent, so that a quantile is within a percent of its value
whatever the rows (DDSketch). Sketches are merged by adding counts: those of a language from its
sources, that of the corpus from all; nothing is drawn at random, so any run and any layout gives the same.
A measure's fence is ``high + reach * max(high - low, spread)`` (and mirrored below), with two
quantiles of the measure, so that a clean group loses nothing whatever its level is. Repeats are 0 in
most rows, so their quantiles are the median and the 9th decile, of rows within the base cutoff
alone, and their spread puts the fence of a group without repeats at half the cutoff. Groups
with fewer than ``least`` rows take the fence of their language, and small languages that of
the corpus. Thresholds are then joined to the rows.

Defined cases: a null text has no words and fails the base rules; null languages and sources
are groups of their own; repeated rows are each kept or not alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.session import written

#: White space of the word class, as one translation to blanks.
_SPACE = "\t\n\x0b\x0c\r"
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEAT_PERCENT = 5, 10, 20
#: Buckets of the sketches: each ends at GAMMA times its beginning; what is at most TINY is 0.
GAMMA, TINY, LOWEST = 1.02, 1e-9, -2_000
#: How many spreads beyond the quantile a fence is.
REACH = 3.0
#: measure: (smallest spread taken as meaningful, whether too small a value fails as well, the two quantiles)
MEASURES = {"symbols": (0.05, False, (0.25, 0.75)), "dup_lines": (0.1, False, (0.25, 0.75)), "repeats": (MOST_REPEAT_PERCENT / 100 / 2 / REACH, False, (0.5, 0.9)), "word_length": (1.0, True, (0.25, 0.75))}


def measure(docs: DataFrame) -> DataFrame:
    """The measures of each text: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are compared by 64-bit hashes of their words, within one text. Each select builds
    on columns of the one before, which lambdas read more than once.
    """
    keys = ("doc_id", "lang", "source")
    rows = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = rows.select(*keys, "t", F.translate("t", _SPACE, " " * len(_SPACE)).alias("blank"))
    rows = rows.select(
        *keys,
        F.filter(F.split("blank", " "), lambda x: x != "").alias("w"),
        F.length(F.replace("blank", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n_lines = F.size("lines") - F.size(F.array_distinct("lines"))
    counts = (*keys, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", n_lines.cast("long").alias("n_dup_lines"))
    rows = rows.select(*counts, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    counts = (*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines")
    window = F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)]))
    rows = rows.select(*counts, window.alias("v"))
    paired = F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    none = F.array().cast("array<struct<v: bigint, i: int>>")
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("v")) < F.size("v"), paired).otherwise(none).alias("s"))
    twice = F.filter("s", lambda x, i: x["v"].eqNullSafe(F.get("s", i - 1)["v"]) | x["v"].eqNullSafe(F.get("s", i + 1)["v"]))
    rows = rows.select(*counts, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get("p", i - 1), F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return rows.select(*counts, covered.cast("long").alias("n_repeat_words"))


def _values() -> dict[str, Column]:
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / n * 10.0,  # by ten words, about a line
        "repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def _repetitive() -> Column:
    """Whether a row fails the base cutoff on repeats."""
    return 100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")


def _bucket(value: Column) -> Column:
    """The number of a value's bucket: values of one bucket differ by GAMMA at most; LOWEST is that of 0."""
    return F.when(value <= TINY, F.lit(LOWEST)).otherwise(F.ceil(F.ln(F.when(value > TINY, value)) / math.log(GAMMA)).cast("int"))


def _middle(bucket: Column) -> Column:
    """The value that stands for a bucket's values."""
    return F.when(bucket == LOWEST, 0.0).otherwise(F.pow(F.lit(GAMMA), bucket.cast("double")) * (2 / (GAMMA + 1)))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts k of rows by lang, source, measure m and bucket b. Sums over groups are the sketches of their union.

    Repeats are of rows within the base cutoff. Measure "rows" counts all rows.
    """
    values = _values() | {"rows": F.lit(0.0)}
    values["repeats"] = F.when(~_repetitive(), values["repeats"])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), v.alias("v")) for m, v in values.items()]))
    rows = measured.select("lang", "source", each.alias("x")).where("x.v IS NOT NULL")
    return rows.groupBy("lang", "source", F.col("x.m").alias("m"), _bucket(F.col("x.v")).alias("b")).agg(F.count("x.m").alias("k"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """For each group: n (rows), and for each measure a struct of its two quantiles, from counts (by, m, b, k)."""
    merged = sketch.groupBy(*by, "m", "b").agg(F.sum("k").alias("k"))
    group = Window.partitionBy(*by, "m")  # some hundred buckets at most
    rows = merged.select(*by, "m", "b", F.sum("k").over(group.orderBy("b")).alias("upto"), F.sum("k").over(group).alias("n"))
    out = [F.max(F.when(F.col("m") == "rows", F.col("n"))).alias("n")]
    for m, (_, _, qs) in MEASURES.items():
        q1, q3 = (_middle(F.min(F.when((F.col("m") == m) & (F.col("upto") >= F.ceil(F.col("n") * q)), F.col("b")))) for q in qs)
        out.append(F.struct(q1.alias("low"), q3.alias("high")).alias(m))
    return rows.groupBy(*by).agg(*out)


def fences(measured: DataFrame, reach: float = REACH, least: int = 100) -> DataFrame:
    """For each (lang, source): low and high of each measure, from merged sketches of all rows (for repeats, of those within the base cutoff)."""
    own = written(sketches(measured), "sketches")

    def fenced(*by: str) -> DataFrame:
        out = [*by, "n"]
        for m, (spread, both, _) in MEASURES.items():
            q1, q3 = F.col(m)["low"], F.col(m)["high"]
            width = reach * F.greatest(q3 - q1, F.lit(spread))
            out.append(F.struct((q1 - width if both else F.lit(float("-inf"))).alias("low"), (q3 + width).alias("high")).alias(m))
        return quantiles(own, *by).select(*out)

    a = fenced("lang", "source").alias("a")
    b = fenced("lang").alias("b")
    c = fenced().alias("c")
    rows = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").join(c, F.lit(True), "left")  # c is one row
    pick = [F.when(F.col("a.n") >= least, F.col(f"a.{m}")).when(F.col("b.n") >= least, F.col(f"b.{m}")).otherwise(F.col(f"c.{m}")).alias(m) for m in MEASURES]
    return rows.select("a.lang", "a.source", *pick)


def quality(docs: DataFrame, reach: float = REACH, least: int = 100) -> DataFrame:
    """documents' measures, base_failed and kept.

    kept: not base_failed, and each measure within the fences of the row's language and source.
    """
    measured = written(measure(docs), "measures")
    limits = fences(measured, reach, least).select(F.col("lang").alias("l"), F.col("source").alias("s"), *MEASURES)
    base = (F.col("n_words") < LEAST_WORDS) | _repetitive()
    inside = F.lit(True)
    for m, v in _values().items():
        inside = inside & F.coalesce((v >= F.col(m)["low"]) & (v <= F.col(m)["high"]), F.lit(True))
    rows = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    out = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*out, base.alias("base_failed"), (~base & inside).alias("kept"))
