"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power ``a``, normalised.  ``a`` is the least exponent between 0
(all alike) and 1 (as they are) for which the weights' entropy stays at or below the target and no source
repeats more than the limit; both fall as ``a`` grows, so it is found by section.

A source that should give ``r`` times its tokens gives each text ``floor(r)`` times; the rest of ``r`` is dealt
out by blocks.  Blocks are drawn by hash and hold about ``block`` texts; each has its own permutation and, as
its budget, the same part of its own tokens, and takes texts in that order while their middle lies within the
budget.  So no source is sorted as a whole, however large, and the errors of the blocks cancel.

Tokens are words.  Nulls: a null text has no tokens; a null source is a source.  A source without tokens keeps
each text once.  Equal rows (doc_id and text) are placed alike.  Extra columns stay untouched,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import WORD_CLASS, boxed, cut, unboxed


def chance(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 that only depends on the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, budget: float, flatten: float, repeats: float, ways: int = 16, rounds: int = 9) -> float:
    """The exponent for a table of sources with their shares ``p`` of all tokens.

    The target entropy lies ``flatten`` of the way from the entropy of the shares to that of equal weights.
    Each round asks one small aggregate for ``ways`` exponents at once.
    """
    n, base = sources.agg(F.count("*"), F.sum(-F.col("p") * F.log("p"))).first()
    if not n:
        return 1.0
    target = base + flatten * (math.log(n) - base)
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        tried = [lo + (hi - lo) * k / ways for k in range(ways)]
        s = sources.select("p", F.explode(F.array(*map(F.lit, tried))).alias("a"))
        q = F.pow("p", F.col("a"))
        seen = s.groupBy("a").agg(F.sum(q).alias("z"), F.sum(q * F.log("p")).alias("l"), F.max(q / F.col("p")).alias("top")).collect()
        good = [r.a for r in seen if math.log(r.z) - r.a * r.l / r.z <= target + 1e-12 and r.top / r.z * budget <= repeats + 1e-12]
        hi = min([hi, *good])
        lo = max([lo, *(r.a for r in seen if r.a < hi)])
        if hi == 0.0:
            break
    return hi


def plan(docs: DataFrame, budget: float = 1.0, flatten: float = 0.5, repeats: float = 4.0, block: int = 128, seed: int = 1) -> DataFrame:
    """(doc_id, source, _th, n_tokens, epoch, block, place): a row for each time that a text is used.

    ``budget`` is the size of the mix as a multiple of all tokens.  Reading epochs in order, in each the blocks
    by ``chance(epoch, source, block)`` and in each block the places, gives the permuted mix.
    """
    if not 0 <= flatten <= 1 or budget <= 0 or repeats < budget:
        raise ValueError("flatten must lie in 0..1, and budget above 0 and not above repeats")
    rows = cut(docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("_th"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS + "+")).cast("long").alias("n_tokens")))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    sources = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")))
    shares = sources.where("tokens > 0").select(F.col("source").alias("_source"), (F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    a = exponent(shares, budget, flatten, repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    part = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a - 1)) * F.lit(budget / z)
    wanted = sources.select(F.col("source").alias("_source"), F.when(F.col("tokens") > 0, part).otherwise(1.0).alias("times"), F.ceil(F.col("texts") / block).alias("blocks"))

    at = rows.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    name = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_th"), F.lit(str(seed)))
    at = at.withColumn("block", chance(*name, F.lit("block")) % F.col("blocks")).withColumn("_order", chance(*name, F.lit("order")))
    whole = Window.partitionBy("source", "block")
    run = whole.orderBy("_order", "doc_id", "_th")
    upto = F.sum("n_tokens").over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # The whole number of times is taken with a little slack, so that 2.9999999 counts as 3.
    full = F.floor(F.col("times") + 1e-6)
    rest = F.greatest(F.col("times") - full, F.lit(0.0))
    taken = (rest > 1e-6) & (F.col("_upto") - F.col("n_tokens") / 2 <= rest * F.col("_all"))
    at = at.withColumns({"_upto": upto, "_all": F.sum("n_tokens").over(whole), "place": F.rank().over(run).cast("long")})
    copies = (full + F.when(taken, 1).otherwise(0)).cast("long")
    return at.where(copies > 0).select("doc_id", "source", "_th", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("epoch"), "block", "place")


OWN = ("doc_id", "text", "source")


def _mixed(docs: DataFrame, **options) -> DataFrame:
    used = plan(docs, **options).distinct().select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.col("source").alias("_s"), "epoch", "block", "place")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s"))
    return boxed(docs, *OWN).withColumn("_th", F.md5(F.coalesce("text", F.lit("")))).join(used, on)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with each row as often as the plan uses it, and its ``epoch``, ``block`` and ``place``."""
    return unboxed(_mixed(docs, **options), docs.columns, OWN, **{c: F.col(c) for c in ("epoch", "block", "place")})


def keep(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of ``docs`` only."""
    return unboxed(_mixed(docs, **options), docs.columns, OWN)
