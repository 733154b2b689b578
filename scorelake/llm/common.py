"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.shared import discard, scratch
from scorelake.workers import ship

__all__ = ["boxed", "code_points", "cut", "dealt", "documents", "hot_keys", "let", "partitions", "quoted", "remainder", "ship", "spread", "unboxed", "words"]

#: A key is hot if it holds more than one in so many rows; its rows are then dealt over so many parts.
HOT, SALTS = 1000, 64

#: White space that separates words: the six ASCII characters of ``[\x20\x09-\x0D]``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, nothing is computed twice.

    The tables ``done``, made by earlier cuts, are removed after that.  What is left goes with the application.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    for old in done:
        discard(spark, old._cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def boxed(df: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator works on, and all others in one struct ``_rest``, where no name can clash."""
    rest = [F.col(quoted(c)) for c in df.columns if c.lower() not in own]
    return df.select(*own, (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))


def unboxed(df: DataFrame, columns: list[str], own: tuple[str, ...], **results: Column) -> DataFrame:
    """The columns again in their order, then the results; a column named like a result, in any case, gives way to it."""
    back = [F.col(c.lower()).alias(c) if c.lower() in own else F.col("_rest").getField(c).alias(c) for c in columns if c.lower() not in results]
    return df.select(*back, *(v.alias(k) for k, v in results.items()))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """The keys that hold more than one in ``HOT`` of all rows; there can be ``HOT`` of them at most."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * HOT > total).select(key).collect()]


def dealt(rows: DataFrame, key: str, keys: list, *by: str) -> DataFrame:
    """``rows`` with a ``_salt`` that deals those of a hot key over ``SALTS`` parts."""
    return rows.withColumn("_salt", F.when(F.col(key).isin(keys), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))


def spread(rows: DataFrame, key: str, keys: list) -> DataFrame:
    """The other side, one row for each key: a hot key's row is there for every part."""
    every, first = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")), F.array(F.lit(0).cast("long"))
    return rows.withColumn("_salt", F.explode(F.when(F.col(key).isin(keys), every).otherwise(first)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
