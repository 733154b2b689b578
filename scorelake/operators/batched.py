"""Distances in Arrow batches: nearest rows of a corpus for a block of queries, nearest centroid of each row.

The built-in ranking has to sort every (query, row) pair of a task before it can drop any; here a task keeps
k rows for each query in arrays and looks at each batch once.  A matrix product in double precision gives
every distance to within rounding; only the pairs that could still be among the k best are computed again in the
engine's own arithmetic (single precision from left to right, or whole numbers), so results are those of the
column expressions, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.workers import ship

#: Corpus rows compared at once with a block of queries.
ROWS = 512


def _matrix(column, dims: int, kind) -> np.ndarray:
    """A list column's first ``dims`` values; rows are as long as that by the filter on valid vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if len(flat) == n * dims:
        return flat.reshape(n, dims).astype(kind)
    return np.array([v[:dims] for v in column.to_pylist()], kind).reshape(n, dims)


def pair_distances(a: np.ndarray, b: np.ndarray, exact_int: bool) -> np.ndarray:
    """Squared distance of row i of ``a`` and row i of ``b``, added up from left to right."""
    kind = np.int32 if exact_int else np.float32
    total = np.zeros(len(a), kind)
    for d in range(a.shape[1]):
        gap = a[:, d].astype(kind) - b[:, d].astype(kind)
        total += gap * gap
    return total


def _rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances in double precision."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def _slack(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """How far the two arithmetics can be apart: a share of the distance, and an absolute part from the product."""
    size = float(np.nanmax(np.abs(a), initial=0)) + float(np.nanmax(np.abs(b), initial=0))
    return 4 * (a.shape[1] + 2) * float(np.finfo(np.float32).eps), a.shape[1] * size * size * 1e-12 + 1e-30


class Nearest:
    """The k nearest rows so far of each query, by (distance, id)."""

    def __init__(self, queries: np.ndarray, k: int, exact_int: bool):
        self.q, self.k, self.exact_int = queries, k, exact_int
        self.rows: dict[str, np.ndarray] = {}
        self.kth = np.full(len(queries), np.inf)

    def add(self, vectors: np.ndarray, columns: dict[str, np.ndarray], which: np.ndarray | None = None, own: dict[str, np.ndarray] | None = None, second: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Looks at some rows; ``which`` says for which queries (``own`` has columns of these), else for all.

        ``second`` has the rows and the queries in full precision: their distance becomes the column ``exact``.
        """
        which = np.arange(len(self.q)) if which is None else which
        q = self.q[which]
        share, fixed = _slack(vectors, q)
        with np.errstate(invalid="ignore", over="ignore"):
            rough, bound = _rough(vectors, q), self.kth[which]
            if len(vectors) > self.k and np.isinf(bound).any():
                bound = np.fmin(bound, np.partition(rough, self.k - 1, axis=0)[self.k - 1] * (1 + share) + fixed)
            near = ~(rough > bound[None, :] * (1 + share) + fixed)
        i, j = np.nonzero(near)
        new = {"dist": pair_distances(vectors[i], q[j], self.exact_int)} | {c: v[i] for c, v in columns.items()} | {c: v[j] for c, v in (own or {}).items()}
        j = which[j]
        new["query"] = j
        if second:
            new["exact"] = pair_distances(second[0][i], second[1][j], False)
        if self.rows:
            touched = np.zeros(len(self.q), bool)
            touched[j] = True
            old = touched[self.rows["query"]]
            rest = {c: v[~old] for c, v in self.rows.items()}
            new = {c: np.concatenate((v[old], new[c])) for c, v in self.rows.items()}
        order = np.lexsort((new["vec_id"], new["dist"], new["query"]))
        q = new["query"][order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = order[place < self.k]
        new = {c: v[best] for c, v in new.items()}
        q = new["query"]
        full = np.flatnonzero((np.arange(len(q)) - np.searchsorted(q, q)) == self.k - 1)
        self.kth[q[full]] = new["dist"][full]
        self.rows = {c: np.concatenate((rest[c], v)) for c, v in new.items()} if self.rows else new


@dataclass
class Block:
    """Queries on the driver: their ids, which differ, and their vectors."""

    ids: object
    vectors: dict[str, np.ndarray]


def take_block(queries: DataFrame, dims: int, **kinds: type) -> Block:
    """One block of ``queries`` (query_id, vector columns): rows without a whole vector are left out, equal rows count once.

    An id that stands for two different vectors is an error, as its neighbours couldn't be told apart.
    """
    rows = queries.where(F.size(next(iter(kinds))) >= dims).select("query_id", *kinds).toArrow().combine_chunks()
    if not rows.num_rows:
        return Block(rows.column("query_id"), {})
    ids, vectors = rows.column("query_id").chunk(0), {c: _matrix(rows.column(c).chunk(0), dims, k) for c, k in kinds.items()}
    first: dict = {}
    for at, i in enumerate(ids.to_pylist()):
        seen = first.setdefault(i, at)
        if seen != at and any(not np.array_equal(v[at], v[seen], equal_nan=v.dtype.kind == "f") for v in vectors.values()):
            raise ValueError(f"the query id {i!r} stands for different vectors")
    keep = np.array(sorted(first.values()))
    return Block(ids.take(keep), {c: v[keep] for c, v in vectors.items()})


def nearest_rows(block: Block, queries: DataFrame, corpus: DataFrame, k: int, dims: int, q: str, c: str, exact_int: bool) -> DataFrame:
    """Each task's k nearest rows of ``corpus`` (vec_id, c, further plain columns) for each query of one block.

    The block goes to the tasks as a broadcast variable; its size is the block's.
    """
    import pyarrow as pa

    spark = corpus.sparkSession
    ship(spark)
    further = [x for x in corpus.columns if x not in (c, "vec_id")]
    kind = np.int8 if exact_int else np.float32
    sent = spark.sparkContext.broadcast((block.ids, block.vectors.get(q)))
    schema = queries.select("query_id").crossJoin(corpus.select("vec_id", *further)).withColumn("dist", F.lit(0).cast("int" if exact_int else "float")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        best, types = Nearest(vectors, k, exact_int), {}
        for batch in batches:
            types = {x: batch.schema.field(x).type for x in ("vec_id", *further)}
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best.add(_matrix(part.column(c), dims, kind), {x: part.column(x).to_numpy(zero_copy_only=False) for x in types})
        if best.rows and len(best.rows["query"]):
            r = best.rows
            cols = [ids.take(pa.array(r["query"])), *(pa.array(r[x], types[x]) for x in types), pa.array(r["dist"], pa.int32() if exact_int else pa.float32())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", *types, "dist"])

    if not block.vectors:
        return spark.createDataFrame([], schema)
    return corpus.select("vec_id", *further, c).mapInArrow(run, schema)


def probe_ranks(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The places of the ``probes`` nearest centroids of each query, nearest first, the lower place in a tie."""
    out = []
    for at in range(0, len(queries), ROWS):
        q = queries[at : at + ROWS]
        total = np.zeros((len(q), len(centroids)), np.float32)
        with np.errstate(invalid="ignore", over="ignore"):
            for d in range(q.shape[1]):
                gap = q[:, d, None] - centroids[None, :, d]
                total += gap * gap
        out.append(np.argsort(total, axis=1, kind="stable")[:, :probes])
    return np.concatenate(out)


def nearest_probed(block: Block, queries: DataFrame, vectors: DataFrame, centroids: list[tuple[int, list[float]]], k: int, probes: int, dims: int, exact: bool, most_literal: int) -> DataFrame:
    """Each task's k nearest rows, by bytes, of each query's probed clusters.

    The probes are worked out once, on the driver; their clusters' ids go into the scan as literals.  A task
    compares a cluster's rows only with the queries that probe it.  With ``exact`` the distance in full precision is there too.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    schema = queries.select("query_id").crossJoin(vectors.select("vec_id", "is_fraud", "cluster_id")).selectExpr("*", "cast(0 as int) as probe_rank", "cast(0 as int) as dist", *(["cast(0 as float) as exact"] if exact else [])).schema
    if not block.vectors:
        return spark.createDataFrame([], schema)
    order = sorted(centroids)
    numbers = np.array([n for n, _ in order], np.int32)
    ranks = probe_ranks(block.vectors["qvector"], np.array([v[:dims] for _, v in order], np.float32).reshape(len(order), dims), probes)
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    flat, who, rank = ranks.ravel(), np.repeat(np.arange(len(ranks)), ranks.shape[1]), np.tile(np.arange(1, ranks.shape[1] + 1, dtype=np.int32), len(ranks))
    by = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], flat[by][1:] != flat[by][:-1])))
    for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
        asked[int(numbers[flat[by[a]]])] = (who[by[a:b]], rank[by[a:b]])
    sent = spark.sparkContext.broadcast((block.ids, block.vectors["qq"], block.vectors["qvector"] if exact else None, asked))
    columns = ("vec_id", "is_fraud", "cluster_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, small, full, table = sent.value
        best, types = Nearest(small, k, True), {}
        for batch in batches:
            types = {x: batch.schema.field(x).type for x in columns}
            cluster = batch.column("cluster_id").to_numpy(zero_copy_only=False)
            place = np.argsort(cluster, kind="stable")
            for a in np.flatnonzero(np.concatenate(([True], cluster[place][1:] != cluster[place][:-1]))) if len(place) else ():
                c = int(cluster[place[a]])
                if c not in table:
                    continue
                which, ranked = table[c]
                rows = place[a : np.searchsorted(cluster[place], c, "right")]
                for at in range(0, len(rows), ROWS):
                    part = batch.take(pa.array(rows[at : at + ROWS]))
                    held = {x: part.column(x).to_numpy(zero_copy_only=False) for x in columns}
                    second = (_matrix(part.column("vector"), dims, np.float32), full) if exact else None
                    best.add(_matrix(part.column("qvec"), dims, np.int8), held, which, {"probe_rank": ranked}, second)
        if best.rows and len(best.rows["query"]):
            r = best.rows
            cols = [ids.take(pa.array(r["query"])), *(pa.array(r[x], types[x]) for x in columns), pa.array(r["probe_rank"], pa.int32()), pa.array(r["dist"], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(r["exact"], pa.float32())] if exact else []), names=["query_id", *columns, "probe_rank", "dist", *(["exact"] if exact else [])])

    read = vectors.where(F.col("cluster_id").isin(sorted(asked))) if len(asked) <= most_literal else vectors
    return read.select(*columns, "qvec", *(["vector"] if exact else [])).mapInArrow(run, schema)


def nearest_centroid(vector: Column, centroids: list[tuple[int, list[float]]], dims: int) -> Column:
    """The number of the nearest centroid, the lower in a tie; distances that aren't numbers never win."""
    order = sorted(centroids)
    numbers = np.array([n for n, _ in order], np.int32)
    cents = np.array([v[:dims] for _, v in order], np.float32).reshape(len(order), dims)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            for at in range(0, len(batch), ROWS):
                x = np.stack([np.asarray(v, np.float32)[:dims] for v in batch.iloc[at : at + ROWS]])
                share, fixed = _slack(x, cents)
                with np.errstate(invalid="ignore", over="ignore"):
                    d = np.nan_to_num(_rough(x, cents), nan=np.inf, posinf=np.inf)
                    i, j = np.nonzero(d <= (d.min(axis=1) * (1 + share) + fixed)[:, None])
                    exact = np.nan_to_num(pair_distances(x[i], cents[j], False), nan=np.inf, posinf=np.inf)
                first = np.lexsort((j, exact, i))
                head = first[np.searchsorted(i[first], np.arange(len(x)))]
                out[at : at + len(x)] = numbers[j[head]]
            yield pd.Series(out)

    return run(vector)
