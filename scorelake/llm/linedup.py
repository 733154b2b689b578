"""Line dedup by content-defined line chunks.

Each text is a list of lines that have a word.  A rolling hash over the hashes of two neighbouring lines slides
down the text.  A boundary stands between two lines wherever that hash occurs nowhere else in the corpus; so the
chunks are the longest runs of lines whose neighbourhoods are repeated, whatever lines were put before, after or
between, and no chunk is cut because of a number chosen beforehand.  (Boundaries where the hash is 0 modulo some
number, the usual choice, miss nearly every passage of a few lines: see the README.)

Chunks of two lines or more are compared byte by byte, pair of lines by pair of lines.  The first occurrence, by
(doc_id, hash of the text, place), stays; the lines of later ones go, so the content of a removed line always
stays at an earlier place.  A line of ``long_words`` words or more is as much as several lines, and is a chunk of
its own too.  Blank lines go with the line before them.  The other lines of a text stay as they are; a text
that loses all becomes empty.

Nulls: a null text stays null; rows without a doc_id come before all others.  Equal rows (doc_id and text) keep
or lose a chunk together.  An empty table gives an empty table.  Extra columns stay untouched, whatever their
names; one named like a result, in any case, gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACES, WORD_CLASS, boxed, cut, dealt, hot_keys, let, spread, unboxed

KEY = ("doc_id", "_th")
#: What a place stands for: a line with the next one, a long line alone, or the whole row.
PAIR, ALONE, WHOLE = 0, 1, 2
#: The repeated hashes are sent to every task up to so many; beyond that rows are joined with them by hash.
MOST_SENT = 2_000_000


def numbered(lines: Column) -> Column:
    """Of an array of lines those that have a word, as (s, at) with their place among all."""
    return F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("at"))), lambda x: F.length(F.translate(x["s"], SPACES, "")) > 0)


def pieces(text: Column, long_words: int, chunk: bool) -> Column:
    """(kind, place, h) of every pair of neighbouring lines and every long line; places count lines with a word.

    With ``chunk`` their text is there too.
    """

    def of(lines: Column) -> Column:
        after = lambda i: F.get(lines, i + 1)
        one = lambda kind, i, h, c: F.struct(F.lit(kind).alias("kind"), i.alias("place"), h.alias("h"), *([c.alias("chunk")] if chunk else []))
        pairs = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: one(PAIR, i, F.xxhash64(x["h"], after(i)["h"]), F.concat_ws("\n", x["s"], after(i)["s"])))
        # So many words need so many characters and spaces; only then they are counted.
        is_long = lambda s: (F.length(s) >= 2 * long_words - 1) & (F.regexp_count(s, F.lit(WORD_CLASS + "+")) >= long_words)
        alone = F.filter(F.transform(lines, lambda x, i: F.when(is_long(x["s"]), one(ALONE, i, F.xxhash64(x["s"], F.lit(ALONE)), x["s"]))), lambda x: x.isNotNull())
        return F.concat(pairs, alone)

    worded = F.filter(F.split(text, "\n", -1), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    return let(F.transform(worded, lambda s: F.struct(s.alias("s"), F.xxhash64(s).alias("h"))), of)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, _th) of the rows whose whole text, of one word at least, is that of a row with a smaller doc_id."""
    rows = docs.where(F.col("text").rlike(WORD_CLASS)).select("doc_id", F.xxhash64("text").alias("_th"), "text")
    key = F.struct("doc_id")
    # Aggregates are written before they are joined with their own rows, so that hot keys are known and dealt.
    again = cut(rows.groupBy("_th").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n")).where("a < b").select("_th", "n"))
    seen = cut(_repeated(rows, again, "_th", "doc_id"))
    first = cut(seen.groupBy("_th", "text").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").drop("last"))
    hot = hot_keys(again, "_th")
    return dealt(seen, "_th", hot, "doc_id").join(spread(first, "_th", hot), ["_th", "text", "_salt"]).where(key > F.col("first")).select(*KEY)


def _repeated(rows: DataFrame, again: DataFrame, key: str, *by: str) -> DataFrame:
    """The rows whose key is in ``again`` (key, n)."""
    few = again.limit(MOST_SENT + 1).count() <= MOST_SENT
    if few:
        return rows.join(F.broadcast(again.select(key)), key, "left_semi")
    hot = hot_keys(again, key)
    return dealt(rows, key, hot, *by).join(spread(again.select(key), key, hot), [key, "_salt"], "left_semi").drop("_salt")


def removals(docs: DataFrame, long_words: int = 50, whole: bool = False) -> DataFrame:
    """(doc_id, _th, gone): what each row loses, as (kind, place); with ``whole``, WHOLE for exact copies."""
    own = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_th"), "text")
    again = cut(own.select(F.explode(pieces(F.col("text"), long_words, False)).alias("c")).groupBy(F.col("c.h").alias("h")).agg(F.count("*").alias("n")).where("n > 1"))
    rows = own.select(*KEY, F.explode(pieces(F.col("text"), long_words, True)).alias("c")).select(*KEY, F.struct("c.kind", "c.place").alias("place"), "c.chunk", "c.h")
    seen = cut(_repeated(rows, again, "h", *KEY, "place"))
    at = F.struct(*KEY, "place")
    first = cut(seen.groupBy("h", "chunk").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    hot = hot_keys(again, "h")
    later = dealt(seen, "h", hot, *KEY, "place").join(spread(first, "h", hot), ["h", "chunk", "_salt"]).where(at > F.col("first")).select(*KEY, "place")
    if whole:
        later = later.unionByName(copies(docs).select(*KEY, F.struct(F.lit(WHOLE).alias("kind"), F.lit(0).alias("place")).alias("place")))
    return later.groupBy(*KEY).agg(F.collect_set("place").alias("gone"))


OWN = ("doc_id", "text")


def _deduped(docs: DataFrame, long_words: int, whole: bool = False) -> DataFrame:
    # Merged at every size: what goes can be as many rows as there are texts.
    gone = cut(removals(docs.select(*OWN), long_words, whole)).select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "gone").hint("merge")
    both = boxed(docs, *OWN).withColumn("_th", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    if whole:
        both = both.where(F.col("gone").isNull() | ~F.exists("gone", lambda g: g["kind"] == WHOLE))

    def left(lines: Column) -> Column:
        """What is left of the text, the number of lines that went and that of their runs."""
        lost = F.sort_array(F.array_distinct(F.flatten(F.transform("gone", lambda g: F.when(g["kind"] == PAIR, F.array(g["place"], g["place"] + 1)).otherwise(F.array(g["place"]))))))

        def of(own: Column, ks: Column) -> Column:
            # Each line with a word takes the blank lines behind it along.
            out = F.flatten(F.transform(ks, lambda u: F.sequence(F.get(own, u)["at"], F.coalesce(F.get(own, u + 1)["at"], F.size(lines)) - 1)))
            stay = let(out, lambda o: F.struct(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), o).alias("at"), F.size(o).alias("n")))
            runs = F.size(F.filter(F.transform(ks, lambda u, i: (i == 0) | (F.get(ks, i - 1) < u - 1)), lambda x: x))
            return let(stay, lambda k: F.struct(F.array_join(F.transform(k["at"], lambda i: F.get(lines, i)), "\n").alias("text"), k["n"].alias("n"), runs.alias("runs")))

        return let(numbered(lines), lambda own: let(lost, lambda ks: of(own, ks)))

    # A generator, so that the lines are made once for all that is read off them, and only where some go.
    done = both.select("doc_id", "text", "gone", "_rest", F.explode(F.array(F.when(F.col("gone").isNotNull(), let(F.split("text", "\n", -1), left)))).alias("_d"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("_d.text"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return done.select("doc_id", text.alias("text"), "_rest", n_lines.alias("n_lines"), count("_d.n").alias("n_gone_lines"), count("_d.runs").alias("n_gone_chunks"))


def dedup(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated chunks, with ``n_lines`` before, ``n_gone_lines`` and ``n_gone_chunks``."""
    counts = {c: F.col(c) for c in ("n_lines", "n_gone_lines", "n_gone_chunks")}
    return unboxed(_deduped(docs, long_words), docs.columns, OWN, **counts)


def keep(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """``docs`` without repeated chunks, with its columns.

    A row that has no word left after losing some goes, and so does an exact copy of a row with a smaller doc_id:
    a text of one short line, which has no chunk, could otherwise stay twice.
    """
    left = _deduped(docs, long_words, whole=True).where((F.col("n_gone_chunks") == 0) | F.col("text").rlike(WORD_CLASS))
    return unboxed(left, docs.columns, OWN)
