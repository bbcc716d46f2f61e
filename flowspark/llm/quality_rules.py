"""Quality rules whose cutoffs adapt to each language and source (DataFrame functions only).

Every document gets its statistics inside its own row: no shuffle of words. The values of each statistic, in each language
and source, are gathered in a quantile sketch with logarithmic buckets: a positive value x counts in bucket
ceil(ln x / ln GAMMA), so any quantile is known to within 1 %, whatever the range. Such sketches merge by adding counts,
in any order and with the same result, which sketches that draw at random do not give; a language's sketch is the sum of
its sources', and the number of buckets grows with the logarithm of the range only.

A document is dropped if a statistic lies beyond the outer fence of its own language and source: on the logarithmic
scale, three times the distance between the quartiles of the positive values above the third quartile (or, for the mean
length of a word, also below the first). The quartiles of a source with n documents are averaged with those of its
language, which count as WEIGHT documents, and those of a language in the same way with those of all documents, so small
groups lean on larger ones by degrees. Documents that fail the base rule are no examples.

Nulls: a null text has no words (and fails the base rule); null lang or source count as the empty string. Repeated rows
each get a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, pick

GAMMA = 1.02
WEIGHT = 200
REACH = 3
#: Statistics: numerator, denominator, whether there is a lower fence too.
METRICS = {"others": ("n_other", "word_chars", False), "upper": ("n_upper", "word_chars", False), "dup_lines": ("n_dup_lines", "n_lines", False), "repeats": ("n_repeat_words", "n_words", False), "word_length": ("word_chars", "n_words", True)}


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; one row for each input row."""
    t = F.col("t")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    df = pick(docs, "doc_id", "text", "lang", "source").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumn("words", F.array_remove(F.split(t, SPACE_CLASS), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"), (F.length(t) - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"), count("[A-Z]").cast("long").alias("n_upper"), count(r"[^\p{L}\p{N}\x20\x09-\x0D]").cast("long").alias("n_other"), lines.alias("lines"),
        # Three words as one 64-bit hash: a false repeat inside one text is as likely as n * n / 2**65.
        F.when(F.size("words") >= 3, F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).alias("grams"),
    ).drop("words")
    df = df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", "n_other", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "grams")
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("sorted", F.when(again, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("sorted")), F.lit(0)).cast("long")).drop("sorted")


def _covered(s: Column) -> Column:
    """Words inside windows of three whose hash stands beside an equal one in the sorted array."""
    at = lambda k, f: F.get(s, k)[f]
    same = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (at(k, "g") == at(k - 1, "g")) | (at(k, "g") == at(k + 1, "g")))
    places = F.sort_array(F.transform(same, lambda k: at(k, "i")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.when(s.isNotNull(), F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"]))


def graded(stats: DataFrame) -> DataFrame:
    """stats, base_failed, and the logarithm of each statistic: null where it is not positive."""
    value = lambda n, of: F.when(F.col(n) > 0, F.log(F.col(n) / F.col(of)))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumns({"base_failed": failed, **{m: value(n, of) for m, (n, of, _) in METRICS.items()}})


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, metric, bucket, n. Counted before the shuffle, so a hot source costs no more."""
    bucket = lambda m: F.ceil(F.col(m) / math.log(GAMMA)).cast("int")
    long = rows.filter("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in METRICS])).alias("x"))
    return long.filter("x.bucket is not null").groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, the logarithms q1 (the lower edge of its bucket) and q3 (the upper edge), and the number of values."""
    group = [*keys, "metric"]
    merged = sketch.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    cum = merged.withColumns({"upto": F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")), "total": F.sum("n").over(Window.partitionBy(*group))})
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    return cum.groupBy(*group).agg(((at(1) - 1) * math.log(GAMMA)).alias("q1"), (at(3) * math.log(GAMMA)).alias("q3"), F.max("total").alias("n"))


def fences(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Logarithms low and high of each metric for each lang and source that has any value."""
    lean = lambda c: ((F.col("n") * F.col(c) + weight * F.col(f"{c}_up")) / (F.col("n") + weight)).alias(c)
    above = lambda df: df.withColumnsRenamed({"q1": "q1_up", "q3": "q3_up"}).drop("n")
    lang = quartiles(sketch, "lang").join(above(quartiles(sketch)), "metric").select("lang", "metric", lean("q1"), lean("q3"))
    own = quartiles(sketch, "lang", "source").join(above(lang), ["lang", "metric"]).select("lang", "source", "metric", lean("q1"), lean("q3"))
    wide = REACH * (F.col("q3") - F.col("q1"))
    ends = {"low": F.col("q1") - wide, "high": F.col("q3") + wide}
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, c)).alias(f"{m}_{x}") for m in METRICS for x, c in ends.items()])


def quality_rules(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept. The counts are written once, since both the sketches and
    the filter read them. The fences, a row for each lang and source, are written too: their size on disk decides whether
    Spark broadcasts them (below its threshold) or joins by key, where it splits hot keys."""
    rows = cut(graded(text_stats(docs)), "quality-stats")
    limits = cut(fences(sketches(rows), weight), "quality-fences")
    inside = F.lit(True)
    for m, (_, _, both) in METRICS.items():
        inside = inside & ~F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
        if both:
            inside = inside & ~F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
    return rows.join(limits, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & inside)
