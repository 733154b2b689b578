"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then ``REPEATS`` times; its figure is the median.  The work is forced by the
no-op sink, which reads every column of the result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINES = ("knn_exact_f32", "knn_exact_int8", "ivf_search_int8", "ivf_search_rerank", "nearest_centroid_assign", "lloyd_one_round", "fraud_decision", "featurize_events", "probe_calibration", "phase_histogram")
REPEATS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from scorelake.config import IndexParams
    from scorelake.operators.ivf import IvfIndex
    from scorelake.operators.knn import exact_knn
    from scorelake.plans import tables
    from scorelake.plans.queries import QUERIES, scratch

    def timed(make) -> float:
        spent = []
        for k in range(REPEATS + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if k:
                spent.append(time.perf_counter() - began)
        return round(statistics.median(spent), 3)

    seconds = {name: timed(lambda name=name: QUERIES[name](spark, sf)) for name in HEADLINES}
    path = scratch(spark)
    corpus = tables.corpus(spark, sf)
    began = time.perf_counter()
    IvfIndex.build(corpus, IndexParams(dims=tables.DIMS, n_centroids=16, sample_rate=1.0, iters=2, default_probes=4)).write(path)
    seconds["index_build"] = round(time.perf_counter() - began, 3)
    index = IvfIndex.load(spark, path)
    batch = tables.queries(spark, sf, 2).cache()
    n, q = corpus.count(), batch.count()
    for p in (1, 4, 16):
        seconds[f"stored_search_{q}q_probes{p}"] = timed(lambda p=p: index.search(batch, probes=p))
    exact = timed(lambda: exact_knn(batch, corpus, 5, tables.DIMS))
    seconds[f"exact_{q}q"] = exact
    want = {(r.query_id, r.vec_id) for r in exact_knn(batch, corpus, 5, tables.DIMS).select("query_id", "vec_id").collect()}
    recall = {p: round(len(want & {(r.query_id, r.vec_id) for r in index.search(batch, probes=p).select("query_id", "vec_id").collect()}) / max(1, len(want)), 4) for p in (1, 4, 16)}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of 3)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
                "exact_distances_per_s": round(n * q / exact),
                "exact_queries_per_s": round(q / exact, 1),
                "recall_at_5_by_probes": recall,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
