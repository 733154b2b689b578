"""I-Match fingerprints over several randomised lexicon subsets.

The terms of a text are its runs of ASCII letters and digits and of all characters beyond ASCII, in lower case.  The lexicon is the terms in a closed band
of document frequency, that is of inverse document frequency: in at least two texts and a share ``least`` of all,
and in a share ``most`` at most.  It has at most the mean number of distinct terms divided by ``least`` terms,
however large the corpus is.  A text keeps its distinct terms of the lexicon, sorted (by their md5).

Lexicon subsets are drawn at random, and overlap: the whole lexicon, and for each of ``FAMILIES`` draws nested
subsets of graded sizes (`SUBSETS`).  The terms that a text has in a subset are hashed together, all of them.  Any
change among a text's kept terms changes the hash of the whole lexicon and of most large subsets; small ones miss
an edit more often, so texts of any length find subsets that an edit spared.  The fingerprint is the list of
these hashes; likeness is the share of equal ones among the subsets in which either text has a term.

A text without a term of the lexicon keeps all its terms; one without any term is hashed whole; the empty
text has a fingerprint of its own.  Null texts are empty.  The next text is the next by (doc_id, hash of the
text), equal rows counting once, and after the last the first; null ids come first.  An empty table gives an empty
table.  Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import cut, let, partitions
from scorelake.llm.lexicon import Lexicon, once

#: What an empty subset gives: the md5 of nothing.
EMPTY = "d41d8cd9"
#: Separators of terms: every ASCII character but letters and digits.
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FAMILIES = 4
#: A subset keeps the terms whose md5 has, at the family's three digits, less than this of 4096.
LARGE, SMALL = (2048, 1024, 512), (256, 128, 64, 32, 16, 8)
TOP = f"{SMALL[0]:03x}"
#: (first digit, bound) of every subset but the whole lexicon: one family has large ones, all have small ones.
SUBSETS = [(3 * f + 1, f"{size:03x}") for size in LARGE for f in (0,)] + [(3 * f + 1, f"{size:03x}") for f in range(FAMILIES) for size in SMALL]
#: The lexicon has an upper bound (see above); more than this raises, as the band was set too wide.
MOST_LISTED = 500_000
#: Keys put in order by one task.
IN_ORDER = 1 << 20


def distinct(text: str) -> str:
    """The distinct terms of a text column, as SQL."""
    return f"array_remove(array_distinct(split(lower({text}), r'{SPLIT}')), '')"


def terms(text: str) -> Column:
    return F.expr(distinct(text))


def lexicon(docs: DataFrame, least: float, most: float) -> Lexicon:
    """The terms in the band, counted over all texts."""
    n = docs.count()
    seen = docs.select(F.explode(terms("text")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = seen.where((F.col("df") >= 2) & (F.col("df") >= least * n) & (F.col("df") <= most * n))
    return Lexicon.of(band, MOST_LISTED)


def fingerprint(text: str, known: Lexicon) -> Column:
    """The hashes of the text column's terms in each subset, the whole lexicon's first, with commas.

    Written as SQL text: it is long, and putting it together function by function takes seconds.
    """
    digest = lambda kept: f"substring(md5(array_join({kept}, '')), 1, 8)"
    part = lambda within, at, bound: f"filter({within}, m -> substring(m, {at}, 3) < '{bound}')"
    large = [digest(part("kept", at, bound)) for at, bound in SUBSETS if bound > TOP]
    # A family's small subsets are nested, so they are read off its largest one.
    small = [once(part("kept", at, TOP), "p", f"array({', '.join([digest('p'), *(digest(part('p', a, bound)) for a, bound in SUBSETS if a == at and bound < TOP)])})") for at, bound in SUBSETS if bound == TOP]
    hashes = f"array_join(concat(array({', '.join([digest('kept'), *large])}), {', '.join(small)}), ',')"
    inside = once(known.table(), "cells", f"filter(every, t -> {known.has('cells', 't')})") if known.terms else "slice(every, 1, 0)"
    banded = once(inside, "b", f"case when size(b) > 0 then b when size(every) > 0 then every else array({text}) end")
    return F.expr(once(f"sort_array(transform({once(distinct(text), 'every', banded)}, t -> md5(t)))", "kept", hashes))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    both = F.zip_with(F.split(a, ","), F.split(b, ","), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
    return F.when(a == b, 1.0).otherwise(let(F.filter(both, lambda x: x.isNotNull()), lambda z: F.size(F.filter(z, lambda x: x == 1)) / F.greatest(F.size(z), F.lit(1))))


def following(keys: DataFrame, at_once: int = IN_ORDER) -> DataFrame:
    """``keys`` (a struct column ``k``, distinct) with ``after``, the next in order; the last has null.

    Ranges of keys of about ``at_once`` are put in order each by one task, and the first key of each range
    is what follows the last of the range before, whatever values the ids have.
    """
    n = max(1, -(-keys.count() // at_once), min(partitions(keys.sparkSession), keys.count()))
    ranged = cut(keys.select("k").repartitionByRange(n, "k").select("k", F.spark_partition_id().alias("_part")))
    heads = ranged.groupBy("_part").agg(F.min("k").alias("k"))  # one row for each range
    heads = heads.select("_part", F.lead("k").over(Window.orderBy("_part")).alias("_next"))
    inner = ranged.withColumn("after", F.lead("k").over(Window.partitionBy("_part").orderBy("k")))
    return inner.join(F.broadcast(heads), "_part").select("k", F.coalesce("after", "_next").alias("after"))


def fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.05) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the next text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs, least, most)
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    prints = cut(keyed.select("doc_id", "_th", F.length("text").alias("n"), fingerprint("text", known).alias("fingerprint")))
    keys = cut(prints.groupBy(F.struct("doc_id", "_th").alias("k")).agg(F.max("n").alias("n"), F.max("fingerprint").alias("fingerprint"), F.count("*").alias("rows")), prints)
    first = keys.agg(F.min("k").alias("k"), F.max("rows").alias("rows")).first()
    if first.k is None:
        after = keys.select("k", F.col("k").alias("after"))
    else:
        wrap = F.struct(F.lit(first.k.doc_id).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(first.k._th).alias("_th"))
        after = following(keys).select("k", F.coalesce("after", wrap).alias("after"))
    after = cut(after.join(keys.select("k", "n", "fingerprint"), "k"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h"))

    wanted = after.select(F.col("after.doc_id").alias("_id"), F.col("after._th").alias("_h"), F.col("k").alias("_for"), F.floor(F.col("n") / 4).cast("int").alias("_take"))
    heads = keyed.join(wanted, same).select(F.col("_for.doc_id").alias("_id"), F.col("_for._th").alias("_h"), F.substring(F.col("text"), F.lit(1), F.col("_take")).alias("_head"))
    if (first.rows or 0) > 1:  # equal rows would each bring the same head
        heads = heads.groupBy("_id", "_h").agg(F.first("_head").alias("_head"))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.coalesce("_head", F.lit("")))
    made = keyed.join(heads, same, "left").select(F.struct("doc_id", "_th").alias("k"), n.cast("long").alias("n_chars"), F.explode(F.array(edited)).alias("_edited"))
    made = cut(made.select("k", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint("_edited", known).alias("edited_fingerprint")))
    small = after.select("k", "fingerprint", "after").join(keys.select(F.col("k").alias("after"), F.col("fingerprint").alias("_next")), "after").drop("after")
    both = made.join(small, "k")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return both.select("k.doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("_next").alias("near_next"))
