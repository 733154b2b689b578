"""Exact nearest neighbours: a stated set of queries against the whole corpus, in blocks.

A block of queries is small by construction and is sent to every task; the corpus is only streamed past it, in
Arrow batches.  Each task keeps the k best of each query, so k rows for each query and task are shuffled and
ranked, however large the corpus is.  The order is total: distance, then id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.config import Limits
from scorelake.functions.vectors import sq_l2
from scorelake.operators.batched import nearest_rows, take_block


def small(df: DataFrame) -> DataFrame:
    """``df`` marked to be sent to every task if it is small enough for that."""
    return F.broadcast(df) if df.limit(Limits.broadcast_rows + 1).count() <= Limits.broadcast_rows else df


def blocks(queries: DataFrame, size: int = Limits.query_block) -> list[DataFrame]:
    """The queries in blocks of about ``size`` rows, dealt by hash of their id."""
    n = -(-queries.count() // size)
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, n)))
    return [queries] if n <= 1 else [queries.where(part == i) for i in range(n)]


def ranked(rows: DataFrame, k: int, dist: str = "dist", by: str = "query_id", tie: str = "vec_id", out: str = "rank") -> DataFrame:
    """The k rows of least (dist, id) of each group, with their rank from 1."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(dist, tie))).where(F.col(out) <= k)


def distances(queries: DataFrame, corpus: DataFrame, dims: int, q: str = "qvector", c: str = "vector", exact_int: bool = False) -> DataFrame:
    """Every pair's distance; the queries are one block."""
    d: Column = sq_l2(F.col(q), F.col(c), dims, exact_int)
    return corpus.crossJoin(F.broadcast(queries)).withColumn("dist", d).drop(q, c)


def exact_knn(queries: DataFrame, corpus: DataFrame, k: int, dims: int, q: str = "qvector", c: str = "vector", exact_int: bool = False, block: int = Limits.query_block) -> DataFrame:
    """``queries`` (query_id, q) against ``corpus`` (vec_id, c, ...): the k nearest with rank and distance.

    Queries without a whole vector have no neighbours; equal ones are answered once; an id with two different
    vectors is refused.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    own = queries.select("query_id", q)
    parts = [ranked(nearest_rows(take_block(b, dims, **{q: np.int8 if exact_int else np.float32}), own, corpus, k, dims, q, c, exact_int), k) for b in blocks(own, block)]
    return reduce(DataFrame.unionByName, parts)
