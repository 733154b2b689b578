"""The inverted-file index: build, store, load, search.

Stored as three Parquet tables: ``index_meta`` (one row), ``centroids`` and ``index``, the latter partitioned by
cluster and sorted within.  A search takes its queries in blocks: the driver ranks the centroids for a block, its
probed clusters' ids go into the scan as a literal list, and each task compares a cluster's rows, in Arrow batches,
with the queries that probe it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake import schemas
from scorelake.config import IndexParams, Limits
from scorelake.functions.vectors import first_dims, quantize_vector, sq_l2, valid_vector
from scorelake.operators.batched import nearest_probed, take_block
from scorelake.operators.kmeans import assign, kmeans, sample
from scorelake.operators.knn import blocks, exact_knn, ranked, small

VERSION = 1
STORED = "vec_id bigint, qvec array<tinyint>, vector array<float>, is_fraud boolean, cluster_id int"
#: Cluster ids go into the scan as literals up to so many; beyond, all clusters are read and those not asked for skipped.
MOST_LITERAL = 5000


class IndexFormatError(ValueError):
    """The stored index isn't one that this engine can read."""


def probe_select(queries: DataFrame, centroids: DataFrame, dims: int, probes: int | None) -> DataFrame:
    """(query_id, cluster_id, cent_dist, probe_rank): the nearest centroids of each query, all of them if probes is None."""
    pairs = queries.select("query_id", "qvector").where(valid_vector(F.col("qvector"), dims)).crossJoin(small(centroids))
    d = sq_l2(F.col("qvector"), F.col("centroid"), dims)
    rows = pairs.select("query_id", "cluster_id", d.alias("cent_dist"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("cent_dist", "cluster_id"))
    out = rows.withColumn("probe_rank", order)
    return out if probes is None else out.where(F.col("probe_rank") <= probes)


def cluster_offsets(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, size, lo, hi): where each cluster starts and ends in cluster order; empty clusters repeat a place."""
    sizes = centroids.select("cluster_id").join(assigned.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id", "left")
    upto = F.sum("size").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.withColumn("size", F.coalesce("size", F.lit(0))).select("cluster_id", "size", (upto - F.col("size")).alias("lo"), upto.alias("hi"))


def positions(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(pos, vec_id): each vector's place in the cluster-sorted order, without a global sort."""
    inside = F.row_number().over(Window.partitionBy("cluster_id").orderBy("vec_id")) - 1
    return assigned.select("vec_id", "cluster_id", inside.alias("i")).join(small(cluster_offsets(assigned, centroids).select("cluster_id", "lo")), "cluster_id").select((F.col("lo") + F.col("i")).alias("pos"), "vec_id")


def find_cluster(places: DataFrame, offsets: DataFrame) -> DataFrame:
    """``places`` (pos, ...) with the cluster whose range [lo, hi) holds them; the ranges are few and sent to every task."""
    ranges = offsets.where("size > 0").select("cluster_id", "lo", "hi")
    return places.join(small(ranges), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).drop("lo", "hi")


@dataclass
class IvfIndex:
    """A searchable index; ``vectors`` has vec_id, cluster_id, qvec, vector, is_fraud."""

    centroids: DataFrame
    vectors: DataFrame
    params: IndexParams

    @classmethod
    def build(cls, corpus: DataFrame, params: IndexParams, start: DataFrame | None = None) -> IvfIndex:
        """From ``corpus`` (vec_id, vector, is_fraud): k-means on a sample, then one assignment of everything."""
        centroids = kmeans(sample(corpus, params.sample_rate, params.seed), params, start)
        return cls.of(corpus, centroids, params)

    @classmethod
    def of(cls, corpus: DataFrame, centroids: DataFrame, params: IndexParams) -> IvfIndex:
        rows = assign(corpus, centroids, params.dims)
        return cls(centroids, rows.select("vec_id", "cluster_id", quantize_vector(F.col("vector")).alias("qvec"), "vector", "is_fraud"), params)

    def write(self, path: str) -> None:
        """Rows of a cluster lie together, in id order; a large cluster is split over tasks and files at run time."""
        rows = self.vectors.hint("rebalance", "cluster_id").sortWithinPartitions("cluster_id", "vec_id")
        rows.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("cluster_id").parquet(f"{path}/index")
        self.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark = self.vectors.sparkSession
        n, m = spark.read.schema(STORED).parquet(f"{path}/index").count(), self.centroids.count()
        meta = [(VERSION, n, m, self.params.dims, self.params.default_probes)]
        spark.createDataFrame(meta, schemas.INDEX_META).coalesce(1).write.mode("overwrite").parquet(f"{path}/index_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, probes: int = 0, k: int = 5) -> IvfIndex:
        """Checks the stored metadata; ``probes`` above 0 overrides the stored default."""
        meta = spark.read.schema(schemas.INDEX_META).parquet(f"{path}/index_meta").collect()
        if len(meta) != 1 or meta[0].version != VERSION:
            raise IndexFormatError(f"index version {[m.version for m in meta]}, expected [{VERSION}]")
        m = meta[0]
        centroids = spark.read.schema("cluster_id int, centroid array<float>").parquet(f"{path}/centroids")
        found = centroids.agg(F.count("*"), F.min(F.size("centroid")), F.max(F.size("centroid"))).first()
        if tuple(found) != (m.num_centroids, m.dims, m.dims):
            raise IndexFormatError(f"centroids (count, least and most dimensions) {tuple(found)}, expected {(m.num_centroids, m.dims, m.dims)}")
        vectors = spark.read.schema(STORED).parquet(f"{path}/index")
        if vectors.count() != m.num_vecs:
            raise IndexFormatError(f"the index doesn't hold {m.num_vecs} vectors")
        return cls(centroids, vectors, IndexParams(dims=m.dims, n_centroids=m.num_centroids, default_probes=probes or m.default_probes, k=k))

    def search(self, queries: DataFrame, k: int | None = None, probes: int | None = None, rerank: int = 0, block: int = Limits.query_block) -> DataFrame:
        """(query_id, rank, vec_id, dist, is_fraud, cluster_id, probe_rank) for ``queries`` (query_id, qvector).

        ``rerank`` above 0 takes that many by quantized distance and orders them anew by the exact one.  Queries
        without a whole vector have no neighbours; equal ones are answered once; an id with two different
        vectors is refused.
        """
        k, probes, dims = k or self.params.k, probes or self.params.default_probes, self.params.dims
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be 1 or more")
        own = queries.select("query_id", "qvector")
        centroids = [(r.cluster_id, r.centroid) for r in self.centroids.select("cluster_id", "centroid").collect()]
        parts = []
        for b in blocks(own, block):
            taken = take_block(b.where(valid_vector(F.col("qvector"), dims)).select("query_id", "qvector", quantize_vector(first_dims(F.col("qvector"), dims)).alias("qq")), dims, qvector=np.float32, qq=np.int8)
            found = nearest_probed(taken, own, self.vectors, centroids, max(k, rerank), probes, dims, bool(rerank), MOST_LITERAL)
            if rerank:
                found = ranked(found, max(k, rerank), out="coarse").drop("coarse", "dist").withColumnRenamed("exact", "dist")
            parts.append(ranked(found, k))
        return reduce(DataFrame.unionByName, parts).select("query_id", "rank", "vec_id", "dist", "is_fraud", "cluster_id", "probe_rank")

    def flat(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k nearest by quantized distance over the whole index, without probing."""
        q = queries.select("query_id", quantize_vector(F.col("qvector")).alias("qq"))
        rows = self.vectors.select("vec_id", "qvec", "is_fraud")
        return exact_knn(q, rows, k or self.params.k, self.params.dims, "qq", "qvec", True)
