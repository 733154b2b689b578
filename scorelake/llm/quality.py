"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Base counts come from each whole text alone.  Three rates are then held against fences that each group of
language and source sets for itself: symbols per letter, repeated lines per line (with six lines more, so that a short text can repeat one), and letters per word.  A
group's quantiles come from a log-linear histogram: integer values fall into buckets of at most 1/32 of their
size, bucket counts of any parts of the data add up, so the sketch is exact to merge, the same on every run,
and of bounded size.  A group with fewer than ``least`` texts uses its language's sketch, merged from the
groups, and a language with fewer than that the one merged from all.

A fence stands ``spread`` interquartile ranges outside the quartiles, and not nearer to them than the
rate's own grain (`RATES`), below which a difference is none: most texts have no symbols and no repeated line, so
both quartiles are 0, and a single mark would be outside.  For these two rates the grain decides wherever three
quarters of a group's texts have none; the README has the shares.

Nulls: a null text is empty and fails the base rules; null languages and sources form groups of their own.
Repeated rows are judged alike.  Extra columns stay untouched, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import SPACES, boxed, code_points, cut, let, unboxed, words

#: For each rate: its value in ten-thousandths from the counts, whether the low side counts too, and its grain.
RATES = {
    "symbol_rate": ("n_symbols * 10000 div greatest(word_chars, 1)", False, 300),
    "dup_line_rate": ("n_dup_lines * 10000 div (n_lines + 6)", False, 2500),
    "word_length": ("word_chars * 10000 div greatest(n_words, 1)", True, 5000),
}
SUB = 5  # buckets of 1/32 of their value
#: Thresholds are sent to every task only up to so many groups; beyond that they are joined by group.
MOST_SENT, SALTS = 100_000, 64


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of eight that occur twice or more in the text."""
    hashes = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 7), lambda i: F.xxhash64(F.slice(a, i, 8)))

    def covered(h: Column) -> Column:
        places = lambda s: F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), (((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                    lambda x: x["twice"],
                ),
                lambda x: x["at"],
            )
        )
        count = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8)))), F.lit(0), lambda a, b: a + b)
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(ordered, lambda s: let(places(s), count))

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(w) < 9, F.lit(0)).otherwise(let(hashes(w), count))


def with_rates(docs: DataFrame, repeats: bool) -> DataFrame:
    """``docs`` with a struct ``q`` of the base counts, and of the repeated words if asked for."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    fields = [
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), (repeated_words(w) if repeats else F.lit(None)).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (code_points(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    ]
    # A generator stands in the way of filters, which would otherwise be moved below and count everything again.
    found = docs.select("*", F.explode(F.array(F.struct(*fields))).alias("_q"))
    q = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "lines.dup", "n_repeat_words": "w.r", "n_lines": "lines.n"}
    return found.withColumn("q", F.struct(*(F.col(f"_q.{v}").alias(k) for k, v in q.items()))).drop("_q")


def rate(name: str) -> Column:
    expr = RATES[name][0]
    for c in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_words"):
        expr = expr.replace(c, f"q.{c}")
    return F.expr(expr)


def bucket(v: Column) -> Column:
    """The least value of the bucket that ``v`` (0 or more) falls into."""
    shift = F.greatest(F.length(F.bin(v)) - (SUB + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """(lang, source, rate, at, n): the histogram of each group over texts of at least ``least_words`` words."""
    q = with_rates(docs.select("lang", "source", "text"), repeats=False)
    cells = F.explode(F.array(*(F.when(F.col("q.n_words") >= least_words, F.struct(F.lit(i).alias("rate"), bucket(rate(r)).alias("at"))) for i, r in enumerate(RATES))))
    return q.select("lang", "source", cells.alias("c")).where("c is not null").groupBy("lang", "source", "c.rate", "c.at").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, spread: int, least: int) -> DataFrame:
    """(lang, source, low array, high array): one pair of bounds for each rate."""
    own = sketch.groupBy("lang", "source").agg(F.sum(F.when(F.col("rate") == 0, F.col("n")).otherwise(0)).alias("texts"))

    def bounds(by: list[str]) -> DataFrame:
        merged = sketch.groupBy(*by, "rate", "at").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "rate")
        run = merged.select(*by, "rate", "at", F.sum("n").over(w.orderBy("at")).alias("upto"), F.sum("n").over(w).alias("all"))
        q = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("all") * p, F.col("at")))
        q = run.groupBy(*by, "rate").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("all").alias("texts"))
        grain = F.element_at(F.array(*(F.lit(g) for _, _, g in RATES.values())), F.col("rate") + 1)
        sided = F.element_at(F.array(*(F.lit(s) for _, s, _ in RATES.values())), F.col("rate") + 1)
        room = F.greatest((F.col("q3") - F.col("q1")) * spread, grain)
        q = q.select(*by, "texts", F.struct("rate", F.when(sided, F.col("q1") - room).otherwise(F.lit(-1)).alias("low"), (F.col("q3") + room).alias("high")).alias("b"))
        return q.groupBy(*by).agg(F.max("texts").alias("texts"), F.sort_array(F.collect_list("b")).alias("b"))

    level = lambda by, name: bounds(by).select(*(F.col(c).alias(f"{name}_{c}") for c in by), F.when(F.col("texts") >= least, F.col("b")).alias(name))
    out = own.join(level(["lang", "source"], "fine"), F.col("lang").eqNullSafe(F.col("fine_lang")) & F.col("source").eqNullSafe(F.col("fine_source")), "left")
    out = out.join(level(["lang"], "mid"), F.col("lang").eqNullSafe(F.col("mid_lang")), "left")
    whole = bounds([]).select(F.col("b").alias("whole"), F.lit(1).alias("one"))
    out = out.withColumn("one", F.lit(1)).join(whole, "one", "left").withColumn("b", F.coalesce("fine", "mid", "whole"))
    return out.select("lang", "source", F.transform("b", lambda x: x["low"]).alias("low"), F.transform("b", lambda x: x["high"]).alias("high"))


OWN = ("text", "lang", "source")


def _judged(docs: DataFrame, spread: int, least: int) -> DataFrame:
    limits = cut(fences(cut(sketches(docs.select(*OWN))), spread, least))
    return _against(boxed(docs, *OWN), limits, limits.count() <= MOST_SENT)


def judged(docs: DataFrame, spread: int = 6, least: int = 25) -> DataFrame:
    """``docs`` (text, lang, source, ...) with the base counts, ``base_failed`` and ``kept``.

    Two passes over the texts and no shuffle of them: the first gathers the sketches, the second judges each
    row against its group's fences.
    """
    counts = {c: F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return unboxed(_judged(docs, spread, least), docs.columns, OWN, **counts, base_failed=F.col("base_failed"), kept=F.col("kept"))


def keep(docs: DataFrame, spread: int = 6, least: int = 25) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return unboxed(_judged(docs, spread, least).where("kept"), docs.columns, OWN)


def _against(docs: DataFrame, limits: DataFrame, few: bool) -> DataFrame:
    """Broadcasts the bounds while they are few; else joins by group, each group's rows dealt over ``SALTS`` parts."""
    sent = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if few:
        both = docs.join(F.broadcast(sent), on, "left")
    else:
        salted = docs.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = salted.join(sent, on & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    q = with_rates(both, repeats=True)
    failed = (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    inside = reduce(lambda a, b: a & b, ((rate(r) >= F.get("_low", F.lit(i))) & (rate(r) <= F.get("_high", F.lit(i))) for i, r in enumerate(RATES)))
    return q.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_lang", "_source", "_low", "_high")
