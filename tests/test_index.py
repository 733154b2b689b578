import random

import pytest
from pyspark.sql import functions as F

from scorelake.config import IndexParams
from scorelake.operators import classify, evaluate, ivf, kmeans, knn, telemetry
from scorelake.operators.decide import decide
from scorelake.operators.ivf import IndexFormatError, IvfIndex

DIMS = 6


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(DIMS)], rng.random() < 0.3) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(10)]  # ties
    return spark.createDataFrame(rows, "vec_id long, vector array<float>, is_fraud boolean").cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    return IvfIndex.build(corpus, IndexParams(dims=DIMS, n_centroids=12, sample_rate=1.0, iters=3, default_probes=3))


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("vec_id % 29 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvector"))


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_nearest_centroid(spark):
    one = spark.createDataFrame([(0, [0.0] * 14, False)], "vec_id long, vector array<float>, is_fraud boolean")
    cents = kmeans.centroid_frame(spark, [[10.0] * 14, [0.1] * 14, [0.1] * 14])
    assert kmeans.assign(one, cents, 14).first().cluster_id == 1


def test_exact_against_brute_force(corpus, queries):
    data = {r.vec_id: r.vector for r in corpus.collect()}
    for block in (4096, 3):
        got = knn.exact_knn(queries, corpus, 5, DIMS, block=block)
        for q in queries.collect():
            want = sorted((sum((a - b) ** 2 for a, b in zip(q.qvector, v, strict=True)), i) for i, v in data.items())[:5]
            mine = [r.vec_id for r in got.where(F.col("query_id") == q.query_id).orderBy("rank").collect()]
            assert {i for _, i in want} == set(mine)


def test_all_probes_is_flat_search(index, queries):
    full = index.search(queries, probes=12)
    assert rows_of(full, "query_id", "rank", "vec_id", "dist") == rows_of(index.flat(queries), "query_id", "rank", "vec_id", "dist")


def test_more_probes_are_never_worse(index, queries):
    last = None
    for p in (1, 2, 6, 12):
        kth = {r.query_id: r.d for r in index.search(queries, probes=p).groupBy("query_id").agg(F.max("dist").alias("d"), F.count("*").alias("n")).where("n = 5").collect()}
        assert last is None or all(kth[q] <= d for q, d in last.items())
        last = kth


def test_rerank_of_everything_is_exact(index, corpus, queries):
    got = index.search(queries, probes=12, rerank=1000)
    assert rows_of(got, "query_id", "rank", "vec_id") == rows_of(knn.exact_knn(queries, corpus, 5, DIMS), "query_id", "rank", "vec_id")


def test_clusters_partition_the_corpus(index, corpus):
    off = ivf.cluster_offsets(index.vectors, index.centroids).orderBy("cluster_id").collect()
    assert off[0].lo == 0 and off[-1].hi == corpus.count() and all(a.hi == b.lo for a, b in zip(off, off[1:], strict=False))
    found = ivf.find_cluster(ivf.positions(index.vectors, index.centroids), ivf.cluster_offsets(index.vectors, index.centroids))
    assert rows_of(found, "vec_id", "cluster_id") == rows_of(index.vectors, "vec_id", "cluster_id")


def test_offsets_with_an_empty_cluster(spark):
    cents = kmeans.centroid_frame(spark, [[0.0], [1.0], [2.0]])
    rows = spark.createDataFrame([(1, 0), (2, 2), (3, 2)], "vec_id long, cluster_id int")
    assert rows_of(ivf.cluster_offsets(rows, cents), "cluster_id", "size", "lo", "hi") == [(0, 1, 0, 1), (1, 0, 1, 1), (2, 2, 1, 3)]


def cost(corpus, cents):
    pairs = corpus.crossJoin(cents).select("vec_id", knn.sq_l2(F.col("vector"), F.col("centroid"), DIMS).alias("d"))
    return pairs.groupBy("vec_id").agg(F.min("d").alias("d")).agg(F.sum("d")).first()[0]


def test_lloyd_lowers_the_cost_and_repeats_itself(corpus):
    start = kmeans.forgy(corpus, 5, 1)
    one = kmeans.lloyd_round(corpus, start, DIMS)
    assert cost(corpus, one) <= cost(corpus, start) + 1e-4
    params = IndexParams(dims=DIMS, n_centroids=3, iters=2, seed=9)
    a, b = kmeans.kmeans(corpus, params), kmeans.kmeans(corpus.repartition(7), params)
    for x, y in zip(sorted(a.collect()), sorted(b.collect()), strict=True):
        assert x.centroid == pytest.approx(y.centroid, abs=1e-5)
    with pytest.raises(ValueError):
        kmeans.forgy(corpus, 10_000, 1)


def test_empty_cluster_keeps_its_centroid(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], False)], "vec_id long, vector array<float>, is_fraud boolean")
    got = kmeans.lloyd_round(rows, kmeans.centroid_frame(spark, [[1.0, 0.0], [9.0, 9.0]]), 2)
    assert rows_of(got, "cluster_id", "centroid") == [(0, [0.0, 0.0]), (1, [9.0, 9.0])]


def test_write_load_and_pruning(spark, index, queries, tmp_path):
    path = f"file://{tmp_path}/ivf"
    index.write(path)
    back = IvfIndex.load(spark, path)
    assert back.params.default_probes == 3 and IvfIndex.load(spark, path, probes=7).params.default_probes == 7
    assert rows_of(back.search(queries), "query_id", "rank", "vec_id") == rows_of(index.search(queries), "query_id", "rank", "vec_id")
    one = queries.limit(1)
    plan = back.search(one, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "cluster_id#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    spark.createDataFrame([(2, 1, 1, 1, 1)], "version int, num_vecs bigint, num_centroids int, dims int, default_probes int").write.mode("overwrite").parquet(f"{path}/index_meta")
    with pytest.raises(IndexFormatError):
        IvfIndex.load(spark, path)


def test_fewer_candidates_than_k_still_divide_by_k(spark):
    rows = spark.createDataFrame([(1, True), (1, True)], "query_id long, is_fraud boolean")
    got = decide(spark.createDataFrame([(1,), (2,)], "query_id long"), rows, 5).orderBy("query_id").collect()
    assert [(r.fraud_count, r.fraud_score, r.approved) for r in got] == [(2, 0.4, True), (0, 0.0, True)]


def test_classes_partition_the_cases(index, queries, corpus):
    cases = queries.join(corpus.select(F.col("vec_id").alias("query_id"), (~F.col("is_fraud")).alias("expected_approved")), "query_id")
    got = classify.classify(index, cases, probes=1).cache()
    counts = {r.classification: r.n for r in classify.class_histogram(got).collect()}
    assert set(counts) == set(classify.CLASSES) and sum(counts.values()) == queries.count()
    assert got.where("classification = 'probe_miss' and probe_miss_rank <= 1").count() == 0
    assert classify.verdict(got).first().advice in ("more probes", "rerank by exact distance")


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, status int, expected_approved boolean, approved boolean, duration_ms double")
    r = evaluate.evaluate(none).first()
    assert (r.n, r.error_rate, r.failure_rate, r.p99_score) == (0, 0.0, 0.0, 0.0)


def test_calibration_agrees_with_searches(index, queries, corpus):
    want = corpus.select(F.col("vec_id").alias("query_id"), (~F.col("is_fraud")).alias("expected_approved")).join(queries.select("query_id"), "query_id")
    for r in evaluate.calibrate(index, queries, want, [1, 4]).collect():
        wrong = evaluate.mismatches(decide(queries, index.search(queries, probes=r.probes), 5), want).count()
        assert r.errors == wrong


def test_bucket_percentile_of_one_row(spark):
    one = spark.createDataFrame([("p", 60)], "phase string, us long")
    got = telemetry.bucket_percentile(telemetry.phase_buckets(one), 0.99).first()
    assert (got.bucket, got.bound) == (2, 100)


def test_log_fields_and_aborts(spark):
    lines = ["lb t=1 status=200 Tq=0 Tw=-1 Tc=0 Tr=3 Tt=9 bytes=1", "lb status=200 Tw=0 Tt=x", "no fields"]
    rows = telemetry.log_fields(spark.createDataFrame([(s,) for s in lines], "value string"))
    got = {(r.field, r.bucket): r.n for r in telemetry.log_buckets(rows).collect()}
    assert got == {("Tw", "aborted"): 1, ("Tw", "0"): 1, ("Tr", "2-4"): 1, ("Tr", "missing"): 1}


def test_repeated_ids_and_null_vectors(spark, index, corpus, queries):
    rows = queries.unionByName(queries.where("query_id = 0")).unionByName(queries.where("query_id = 29").selectExpr("-1L as query_id", "cast(null as array<float>) as qvector"))
    for search in (lambda q: knn.exact_knn(q, corpus, 5, DIMS), lambda q: index.search(q), lambda q: index.search(q, rerank=7)):
        assert rows_of(search(rows), "query_id", "rank", "vec_id") == rows_of(search(queries), "query_id", "rank", "vec_id")
        with pytest.raises(ValueError):
            search(queries.unionByName(queries.where("query_id = 29").withColumn("query_id", F.lit(0).cast("long")))).collect()
    assert decide(rows, index.search(rows), 5).count() == rows.count()


def test_index_search_against_brute_force(index, queries):
    cents = {r.cluster_id: r.centroid for r in index.centroids.collect()}
    data = index.vectors.collect()
    quant = lambda v: [max(-127, min(127, int(abs(x) * 127 + 0.5) * (1 if x >= 0 else -1))) for x in v]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    got = {(r.query_id, r.rank): (r.vec_id, r.dist, r.probe_rank) for r in index.search(queries, probes=4).collect()}
    for q in queries.collect():
        order = sorted(cents, key=lambda c: (sq(q.qvector, cents[c]), c))[:4]
        near = sorted((sq(quant(q.qvector), r.qvec), r.vec_id, order.index(r.cluster_id) + 1) for r in data if r.cluster_id in order)[:5]
        assert [got.get((q.query_id, i + 1)) for i in range(len(near))] == [(v, d, p) for d, v, p in near]


def test_percentile_by_histograms(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)] + [5.0] * 500 + [None]
    rows = spark.createDataFrame([(v,) for v in values], "d double").repartition(5)
    want = rows.agg(*(F.percentile("d", F.lit(p)) for p in (0.0, 0.5, 0.99, 1.0))).first()
    assert [evaluate.percentile(rows, "d", p) for p in (0.0, 0.5, 0.99, 1.0)] == pytest.approx(list(want))
    kept = rows.where("d is not null")
    order = sorted(v for v in values if v is not None)
    assert [evaluate.value_at(kept, "d", i, at_once=20, ways=8) for i in (0, 1234, 3400, 3499)] == [order[i] for i in (0, 1234, 3400, 3499)]


def test_calibration_is_timed_and_recall_grows(index, queries, corpus):
    want = corpus.select(F.col("vec_id").alias("query_id"), (~F.col("is_fraud")).alias("expected_approved")).join(queries.select("query_id"), "query_id")
    assert all(r.seconds > 0 and r.us_per_query > 0 for r in evaluate.calibrate(index, queries, want, [2]).collect())
    exact = knn.exact_knn(queries, corpus, 5, DIMS)
    few, all_ = (evaluate.recall(index.search(queries, probes=p, rerank=20), exact).first().recall for p in (1, 12))
    assert few <= all_ and all_ == 1.0
    near = classify.true_neighbours(index, queries, 5)
    found = index.search(queries, probes=1)
    assert classify.found_by(near, found).count() + classify.lost_by(near, found).count() == near.count()
