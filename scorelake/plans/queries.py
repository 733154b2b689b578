"""The registered queries of the engine: each applies one operator to the test tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.config import IndexParams, Normalization
from scorelake.functions.features import DIMS as FEATURES
from scorelake.functions.features import featurize, mcc_risk, risk_map, unknown_merchant
from scorelake.functions.scores import detection_score, p99_score
from scorelake.functions.vectors import quantize_vector
from scorelake.operators import classify as why
from scorelake.operators import evaluate, ivf, kmeans, knn, telemetry
from scorelake.operators.decide import decide
from scorelake.plans import tables as t
from scorelake.shared import discard, scratch
from scorelake.sources import readers, sinks
from scorelake.sources.readers import corpus_rows, parse_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long_form(df: DataFrame, key: str, vector: str, value: str, digits: int | None = None) -> DataFrame:
    """A vector column as rows (key, dim, value), rounded if asked, without negative zeros."""
    rows = df.select(key, F.posexplode(vector).alias("dim", value))
    return rows if digits is None else rows.withColumn(value, F.round(F.col(value).cast("double"), digits) + F.lit(0.0))


@query
def scan_valid_vectors(spark, sf):
    return corpus_rows(t.raw_corpus(spark, sf), t.DIMS).select("vec_id", F.size("vector").cast("long").alias("n"), "is_fraud")


@query
def quantize_vectors(spark, sf):
    return long_form(t.corpus(spark, sf).select("vec_id", quantize_vector(F.col("vector")).alias("q")), "vec_id", "q", "value").withColumn("value", F.col("value").cast("int"))


@query
def sq_l2_f32(spark, sf):
    return knn.distances(t.queries(spark, sf), t.corpus(spark, sf), t.DIMS).select("query_id", "vec_id", "dist")


@query
def sq_l2_int8(spark, sf):
    q = t.queries(spark, sf).select("query_id", quantize_vector(F.col("qvector")).alias("qq"))
    return knn.distances(q, t.index(spark, sf).vectors.select("vec_id", "qvec"), t.DIMS, "qq", "qvec", True).select("query_id", "vec_id", "dist")


@query
def knn_exact_f32(spark, sf):
    return knn.exact_knn(t.queries(spark, sf), t.corpus(spark, sf), 5, t.DIMS).select("query_id", "rank", "vec_id", "dist", "is_fraud")


@query
def knn_exact_int8(spark, sf):
    rows = t.corpus(spark, sf).select("vec_id", quantize_vector(F.col("vector")).alias("qvec"), "is_fraud")
    q = t.queries(spark, sf).select("query_id", quantize_vector(F.col("qvector")).alias("qq"))
    return knn.exact_knn(q, rows, 5, t.DIMS, "qq", "qvec", True).select("query_id", "rank", "vec_id", "dist", "is_fraud")


@query
def nearest_centroid_assign(spark, sf):
    return kmeans.assign(t.corpus(spark, sf), t.start(spark, sf), t.DIMS).select("vec_id", "cluster_id")


@query
def lloyd_one_round(spark, sf):
    return long_form(kmeans.lloyd_round(t.corpus(spark, sf), t.start(spark, sf), t.DIMS), "cluster_id", "centroid", "value", 5)


@query
def lloyd_two_rounds(spark, sf):
    params = IndexParams(dims=t.DIMS, n_centroids=t.CENTROIDS, iters=2)
    return long_form(kmeans.kmeans(t.corpus(spark, sf), params, t.start(spark, sf)), "cluster_id", "centroid", "value", 5)


@query
def kmeans_full(spark, sf):
    params = IndexParams(dims=t.DIMS, n_centroids=t.CENTROIDS, iters=20)
    return long_form(kmeans.kmeans(t.corpus(spark, sf), params), "cluster_id", "centroid", "value", 4)


@query
def forgy_init(spark, sf):
    return long_form(kmeans.forgy(t.corpus(spark, sf), t.CENTROIDS, 42), "cluster_id", "centroid", "value")


@query
def sample_hash(spark, sf):
    return kmeans.sample(t.corpus(spark, sf), 0.3, 42).select("vec_id", "is_fraud")


@query
def cluster_offsets(spark, sf):
    rows = t.index(spark, sf)
    empty = rows.centroids.select((F.col("cluster_id") + t.CENTROIDS).alias("cluster_id"), "centroid")
    return ivf.cluster_offsets(rows.vectors, rows.centroids.unionByName(empty)).select("cluster_id", *(F.col(c).cast("long") for c in ("size", "lo", "hi")))


@query
def offset_range_join(spark, sf):
    rows = t.index(spark, sf)
    places = ivf.positions(rows.vectors, rows.centroids)
    return ivf.find_cluster(places, ivf.cluster_offsets(rows.vectors, rows.centroids)).select("vec_id", F.col("pos").cast("long"), "cluster_id")


@query
def probe_select(spark, sf):
    rows = ivf.probe_select(t.queries(spark, sf), t.index(spark, sf).centroids, t.DIMS, 4)
    return rows.withColumn("cent_dist", F.round(F.col("cent_dist").cast("double"), 4))


@query
def cluster_rank(spark, sf):
    return ivf.probe_select(t.queries(spark, sf), t.index(spark, sf).centroids, t.DIMS, None).select("query_id", "cluster_id", "probe_rank")


@query
def ivf_search_int8(spark, sf):
    return t.index(spark, sf).search(t.queries(spark, sf)).select("query_id", "rank", "vec_id", "dist", "is_fraud")


@query
def ivf_search_rerank(spark, sf):
    return t.index(spark, sf).search(t.queries(spark, sf), rerank=12).select("query_id", "rank", "vec_id", "dist", "is_fraud")


@query
def fraud_decision(spark, sf):
    q = t.queries(spark, sf)
    return decide(q, t.index(spark, sf).search(q), 5)


@query
def featurize_events(spark, sf):
    rows = featurize(t.requests(spark, sf), Normalization(), t.RISK)
    return rows.select(F.col("id").alias("event_id"), *(F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(f"f{i:02d}") for i in range(FEATURES)))


@query
def mcc_risk_lookup(spark, sf):
    return t.requests(spark, sf).select(F.col("id").alias("event_id"), mcc_risk(risk_map(t.RISK), F.col("merchant.mcc")).cast("double").alias("risk"))


@query
def unknown_merchant_flag(spark, sf):
    return t.requests(spark, sf).select(F.col("id").alias("event_id"), unknown_merchant(F.col("customer.known_merchants"), F.col("merchant.id")).cast("int").alias("unknown"))


@query
def request_validation(spark, sf):
    """Every tenth request loses a field, every eleventh gets one of a wrong type, every thirteenth is cut off."""
    i = F.col("id").cast("long")
    text = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"))
    text = F.when(i % 10 == 0, F.replace(text, F.lit('"mcc":'), F.lit('"mmc":'))).when(i % 11 == 0, F.replace(text, F.lit('"installments":'), F.lit('"installments":1.'))).when(i % 13 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return parse_requests(t.requests(spark, sf).select(F.col("id").alias("event_id"), text.alias("value"))).select("event_id", "valid", F.col("request.merchant.mcc").alias("mcc"))


def _outcomes(spark, sf):
    q = t.queries(spark, sf, 1)
    rows = decide(q, t.index(spark, sf).search(q, probes=1), 5).join(t.expected(spark, sf), "query_id")
    i = F.col("query_id")
    return rows.select("query_id", "expected_approved", "approved", F.when(i % 25 == 24, 400).otherwise(200).alias("status"), ((i % 40) / 8.0).alias("duration_ms"))


@query
def confusion_matrix(spark, sf):
    return evaluate.rates(evaluate.confusion(_outcomes(spark, sf))).select("n", "tp", "tn", "fp", "fn", "err", "weighted_error", *(F.round(c, 6).alias(c) for c in ("error_rate", "failure_rate")))


@query
def evaluation_scores(spark, sf):
    return evaluate.evaluate(_outcomes(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("p99", "p99_score", "detection_score", "final_score")))


@query
def detection_score_grid(spark, sf):
    grid = spark.range(40).select("id", (F.col("id") * 3).alias("e"), (F.col("id") / 400.0).alias("rate"), (F.col("id") / 200.0).alias("failures"))
    return grid.select("id", F.round(detection_score(F.col("e"), F.col("rate"), F.col("failures")), 6).alias("score"))


@query
def p99_score_grid(spark, sf):
    return spark.range(60).select("id", F.round(p99_score(F.col("id") * F.col("id") * 0.75 - 1), 6).alias("score"))


@query
def dataset_stats(spark, sf):
    return evaluate.dataset_stats(t.expected(spark, sf)).select("total", "fraud_count", "legit_count", *(F.round(c, 6).alias(c) for c in ("fraud_rate", "legit_rate")))


@query
def probe_calibration(spark, sf):
    return evaluate.calibrate(t.index(spark, sf), t.queries(spark, sf, 1), t.expected(spark, sf), [1, 2, 4, 8, 16]).select("probes", "n", "fp", "fn", "errors", F.round("error_pct", 6).alias("error_pct"))


@query
def mismatch_filter(spark, sf):
    q = t.queries(spark, sf, 1)
    rows = decide(q, t.index(spark, sf).search(q, probes=1), 5)
    return evaluate.mismatches(rows, t.expected(spark, sf)).select("query_id", "approved", "expected_approved", "fraud_count")


def _cases(spark, sf):
    """All queries as cases, expected as the exact search decides but for every fourth: so that each class occurs."""
    q = t.queries(spark, sf, 1)
    exact = decide(q, knn.exact_knn(q, t.corpus(spark, sf), 5, t.DIMS), 5)
    want = exact.select("query_id", F.when(F.col("query_id") % 4 == 0, ~F.col("approved")).otherwise(F.col("approved")).alias("expected_approved"))
    return q.join(want, "query_id")


def _classified(spark, sf):
    return why.classify(t.index(spark, sf), _cases(spark, sf), probes=2)


@query
def classify_mismatches(spark, sf):
    return _classified(spark, sf).select("query_id", "classification", "expected_approved", "actual_approved_ivf", "fraud_count_true", "fraud_count_ivf", "probe_miss_rank", "tie_flip_gap")


@query
def class_histogram(spark, sf):
    return why.class_histogram(_classified(spark, sf)).withColumn("pct", F.round("pct", 6))


@query
def probe_miss_rank_hist(spark, sf):
    return why.histogram(_classified(spark, sf), "probe_miss_rank")


@query
def tie_flip_gap_hist(spark, sf):
    return why.histogram(_classified(spark, sf), "tie_flip_gap")


@query
def error_verdict(spark, sf):
    return why.verdict(_classified(spark, sf))


@query
def semi_scanned(spark, sf):
    return why.scanned(why.true_neighbours(t.index(spark, sf), t.queries(spark, sf), 5), 2).select("query_id", "vec_id", "cluster_rank")


@query
def anti_unscanned(spark, sf):
    return why.unscanned(why.true_neighbours(t.index(spark, sf), t.queries(spark, sf), 5), 2).select("query_id", "vec_id", "cluster_rank")


@query
def semi_found(spark, sf):
    near = why.true_neighbours(t.index(spark, sf), t.queries(spark, sf), 5)
    return why.found_by(near, t.index(spark, sf).search(t.queries(spark, sf), probes=2)).select("query_id", "vec_id")


@query
def anti_lost(spark, sf):
    near = why.true_neighbours(t.index(spark, sf), t.queries(spark, sf), 5)
    return why.lost_by(near, t.index(spark, sf).search(t.queries(spark, sf), probes=2)).select("query_id", "vec_id")


@query
def ivf_recall(spark, sf):
    q = t.queries(spark, sf)
    found = evaluate.recall(t.index(spark, sf).search(q, rerank=12), knn.exact_knn(q, t.corpus(spark, sf), 5, t.DIMS))
    return found.withColumn("recall", F.round("recall", 6))


@query
def phase_histogram(spark, sf):
    return telemetry.phase_buckets(t.timings(spark, sf))


@query
def phase_summary(spark, sf):
    return telemetry.phase_summary(t.timings(spark, sf))


@query
def bucket_percentile(spark, sf):
    return telemetry.bucket_percentile(telemetry.phase_buckets(t.timings(spark, sf)), 0.99)


@query
def log_field_buckets(spark, sf):
    return telemetry.log_buckets(telemetry.log_fields(t.log_lines(spark, sf)))


@query
def log_summary(spark, sf):
    return telemetry.log_summary(telemetry.log_fields(t.log_lines(spark, sf)))


@query
def index_roundtrip(spark, sf):
    path = scratch(spark)
    t.index(spark, sf).write(path)
    return ivf.IvfIndex.load(spark, path, k=5).search(t.queries(spark, sf)).select("query_id", "rank", "vec_id", "dist", "is_fraud")


@query
def stream_score(spark, sf):
    from scorelake.streaming.scorer import score_stream

    path = scratch(spark)
    q = t.queries(spark, sf)
    q.repartition(3, "query_id").write.parquet(f"{path}/in")
    rows = t.index(spark, sf)
    rows.write(f"{path}/ivf")
    source = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    score_stream(ivf.IvfIndex.load(spark, f"{path}/ivf"), source, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("epoch")


def _one_text(rows: DataFrame, order: str, before: str = "[", after: str = "]") -> DataFrame:
    """All ``rows`` as one JSON array, as the sources have it."""
    held = F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*[c for c in rows.columns if c != order])).alias("j"))))
    return rows.agg(F.concat(F.lit(before), F.array_join(F.transform(held, lambda x: x["j"]), ","), F.lit(after)).alias("value"))


@query
def corpus_array(spark, sf):
    path = scratch(spark)
    _one_text(t.raw_corpus(spark, sf), "vec_id").write.option("compression", "gzip").text(f"{path}/in")
    return readers.read_corpus(spark, f"{path}/in", t.DIMS, f"{path}/rows").select("vec_id", F.size("vector").cast("long").alias("n"), "is_fraud")


@query
def configuration_files(spark, sf):
    path = scratch(spark)
    own = asdict(Normalization(max_km=250.0))
    spark.createDataFrame([(json.dumps(own),)], "value string").write.text(f"{path}/norm")
    spark.createDataFrame([(json.dumps(t.RISK),)], "value string").write.text(f"{path}/risk")
    rows = list(asdict(readers.read_normalization(spark, f"{path}/norm")).items()) + list(readers.read_mcc_risk(spark, f"{path}/risk").items())
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "name string, value double").withColumn("value", F.round("value", 6))


def _entries(spark, sf) -> DataFrame:
    i = F.col("id").cast("long")
    return t.requests(spark, sf).select(i.alias("i"), (i % 3 != 0).alias("expected_approved"), F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"))


@query
def labelled_set(spark, sf):
    path = scratch(spark)
    sinks.write_labelled(_entries(spark, sf), "i", path)
    rows = readers.read_labelled(spark, path)
    discard(spark, path)
    return rows.select("idx", "expected_approved", F.col("request.id").alias("event_id"))


@query
def mismatch_lines(spark, sf):
    path = scratch(spark)
    rows = _entries(spark, sf).select(F.col("i").alias("idx"), "request.id", "expected_approved", (~F.col("expected_approved")).alias("actual_approved"), F.lit(0.6).cast("float").alias("actual_fraud_score"), F.col("request").alias("transaction"))
    lines = sinks.mismatch_lines(rows).select(F.substring(F.col("value"), F.lit(len("MISMATCH ") + 1), F.length("value")).alias("value"))
    lines.unionByName(spark.createDataFrame([("",), ("{broken",), ("  ",)], "value string")).write.text(path)
    good, bad = readers.read_mismatches(spark, path)
    return good.select("idx", "id", "expected_approved", "transaction.merchant.mcc").unionByName(bad.selectExpr("-1L as idx", "value as id", "false as expected_approved", "cast(null as string) as mcc"))


@query
def access_log(spark, sf):
    path = scratch(spark)
    t.log_lines(spark, sf).write.text(path)
    return telemetry.log_summary(telemetry.log_fields(readers.read_log(spark, path)))


@query
def cpu_counters(spark, sf):
    path = scratch(spark)
    spark.createDataFrame([(x,) for x in ("usage_usec 12", "nr_periods 5", "nr_throttled 2", "throttled_usec 70", "nr_bursts 1", "burst_usec 3", "user_usec")], "value string").write.text(path)
    return readers.read_cpu_stat(spark, path)


@query
def classified_lines(spark, sf):
    path = scratch(spark)
    rows = _classified(spark, sf)
    sinks.write_classified(rows, path)
    return spark.read.schema(rows.schema).json(path).select("query_id", "classification", "fraud_count_true", "fraud_count_ivf")


@query
def summary_file(spark, sf):
    path = scratch(spark)
    rows = why.verdict(_classified(spark, sf))
    sinks.write_summary(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query
def phase_stream(spark, sf):
    from scorelake.streaming.scorer import metrics_stream

    path = scratch(spark)
    rows = t.timings(spark, sf)
    rows.repartition(3).write.parquet(f"{path}/in")
    metrics_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("phase", "bucket").agg(F.sum("n").alias("n"))


@query
def request_lines(spark, sf):
    """Requests as JSON lines, read, checked and featurized; a broken line is left out."""
    from scorelake.streaming.scorer import request_stream

    path = scratch(spark)
    lines = _entries(spark, sf).select(F.to_json("request").alias("value")).unionByName(spark.createDataFrame([('{"id": 1',)], "value string"))
    lines.write.text(path)
    rows = request_stream(readers.read_requests(spark, path).select("value"), Normalization(), t.RISK)
    return rows.select(F.col("query_id").alias("event_id"), *(F.round(F.get("qvector", F.lit(i)).cast("double"), 5).alias(f"f{i:02d}") for i in range(FEATURES)))
