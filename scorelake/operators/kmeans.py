"""Lloyd's k-means over a corpus: hashed sampling and start, assignment, mean, a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.config import IndexParams
from scorelake.operators.batched import nearest_centroid
from scorelake.workers import ship


def hash_order(seed: int, key: str = "vec_id") -> Column:
    """A pseudo-random order that depends on seed and id only, whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample(corpus: DataFrame, rate: float, seed: int, key: str = "vec_id") -> DataFrame:
    """Each row with probability ``rate``, decided by its id's hash."""
    return corpus.where(F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") < int(rate * 2**32))


def forgy(corpus: DataFrame, n: int, seed: int) -> DataFrame:
    """(cluster_id, centroid): n distinct rows of the corpus as first centroids, numbered in hash order."""
    first = corpus.select("vec_id", "vector").orderBy(hash_order(seed), "vec_id").limit(n).collect()
    if len(first) < n:
        raise ValueError(f"{n} centroids asked for, {len(first)} rows there")
    return centroid_frame(corpus.sparkSession, [r.vector for r in first])


def centroid_frame(spark: SparkSession, centroids: list | dict) -> DataFrame:
    """(cluster_id, centroid), numbered in order unless a dict has the numbers."""
    rows = sorted(centroids.items()) if isinstance(centroids, dict) else enumerate(centroids)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in rows], "cluster_id int, centroid array<float>").coalesce(1)


def assign(corpus: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """``corpus`` with the ``cluster_id`` of the nearest centroid, the lower number in a tie; NaN distances never win.

    A projection: the centroids, a few thousand at most, come to the driver and go along with the expression,
    so no row is shuffled or multiplied.
    """
    ship(corpus.sparkSession)
    rows = [(r.cluster_id, r.centroid) for r in centroids.select("cluster_id", "centroid").collect()]
    return corpus.withColumn("cluster_id", nearest_centroid(F.col("vector"), rows, dims))


def means(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, centroid): each cluster's mean, summed in double and stored in single precision."""
    sums = assigned.groupBy("cluster_id").agg(*(F.avg(F.get("vector", F.lit(i)).cast("double")).cast("float").alias(f"m{i}") for i in range(dims)))
    return sums.select("cluster_id", F.array(*(f"m{i}" for i in range(dims))).alias("centroid"))


def lloyd_round(corpus: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """One round; a cluster that nothing is assigned to keeps its centroid."""
    new = means(assign(corpus, centroids, dims), dims)
    return centroids.join(F.broadcast(new.withColumnRenamed("centroid", "moved")), "cluster_id", "left").select("cluster_id", F.coalesce("moved", "centroid").alias("centroid"))


def kmeans(corpus: DataFrame, params: IndexParams, start: DataFrame | None = None) -> DataFrame:
    """``params.iters`` rounds from the given or a hashed start.

    The centroids (``n_centroids`` rows) come to the driver after each round, so the plan doesn't grow.
    """
    ship(corpus.sparkSession)
    first = start if start is not None else forgy(corpus, params.n_centroids, params.seed)
    now = {r.cluster_id: r.centroid for r in first.select("cluster_id", "centroid").collect()}
    for _ in range(params.iters):
        at = nearest_centroid(F.col("vector"), list(now.items()), params.dims)
        now |= {r.cluster_id: r.centroid for r in means(corpus.select("vector", at.alias("cluster_id")), params.dims).collect()}
    return centroid_frame(corpus.sparkSession, now)
