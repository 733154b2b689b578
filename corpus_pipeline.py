"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet to the shared folder and read again.  Rows that
repeat an id are one document: they stay or go together.  Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import bpe, jaccard, linedup, mixing, quality
from scorelake.llm.common import boxed, cut, documents, unboxed
from scorelake.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's fences reject go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go; so does a document that has no word left after losing some, or that is an exact copy."""
    left = linedup.keep(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    Rows without a doc_id count behind all others, in the order of a hash of their text; equal ones are one document.
    """
    behind = F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + F.lit(1 << 62)
    rows = boxed(docs, "doc_id", "text").withColumn("_rank", F.coalesce("doc_id", behind))
    found = jaccard.jaccard_components(rows.select(F.col("_rank").alias("doc_id"), "text"), words=5, percent=75)
    others = found.where("component_id < doc_id").select(F.col("doc_id").alias("_rank")).distinct()
    return unboxed(rows.join(others, "_rank", "left_anti"), docs.columns, ("doc_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights uses it; one that it doesn't use goes."""
    return mixing.keep(docs, budget=1.0, flatten=0.5, repeats=4.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express BPE; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
