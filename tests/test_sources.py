import gzip
import json

import pytest

from scorelake.config import IndexParams
from scorelake.operators.ivf import IvfIndex
from scorelake.operators.kmeans import centroid_frame
from scorelake.sources import readers, sinks
from scorelake.streaming.scorer import score_batch, score_stream
from tests.test_functions import request


def test_corpus_array(spark, tmp_path):
    rows = [{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [0.2] * 13, "label": "fraud"}, {"vector": [0.3] * 15, "label": "[legit]"}]
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        json.dump(rows, f)
    got = readers.read_corpus(spark, f"file://{tmp_path}/c.json.gz", 14, f"file://{tmp_path}/c.parquet").orderBy("vec_id").collect()
    assert [(r.vec_id, len(r.vector), r.is_fraud) for r in got] == [(0, 14, True), (2, 14, False)]


def test_configs(spark, tmp_path):
    norm = {"max_amount": 1, "max_installments": 2, "amount_vs_avg_ratio": 3, "max_minutes": 4, "max_km": 5, "max_tx_count_24h": 6, "max_merchant_avg_amount": 7}
    (tmp_path / "n.json").write_text(json.dumps(norm, indent=1))
    (tmp_path / "m.json").write_text('{\n "5411": 0.25, "x": 1\n}')
    assert readers.read_normalization(spark, f"file://{tmp_path}/n.json").max_km == 5
    assert readers.read_mcc_risk(spark, f"file://{tmp_path}/m.json") == {"5411": 0.25, "x": 1.0}
    (tmp_path / "bad.json").write_text(json.dumps({**norm, "max_km": 0}))
    with pytest.raises(readers.ConfigError):
        readers.read_normalization(spark, f"file://{tmp_path}/bad.json")


def test_labelled_set(spark, tmp_path):
    doc = {"entries": [{"expected_approved": i % 2 == 0, "request": request(id=str(i))} for i in range(3)], "stats": {"total": 3, "fraud_rate": 0.3}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    got = readers.read_labelled(spark, f"file://{tmp_path}/t.json").orderBy("idx").collect()
    assert [(r.idx, r.expected_approved, r.request.id) for r in got] == [(0, True, "0"), (1, False, "1"), (2, True, "2")]
    assert readers.read_labelled_stats(spark, f"file://{tmp_path}/t.json").first().total == 3


def test_mismatch_lines(spark, tmp_path):
    good = {"idx": 1, "id": "a", "expected_approved": True, "actual_approved": False, "actual_fraud_score": 0.6, "transaction": request()}
    (tmp_path / "m.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    rows, bad = readers.read_mismatches(spark, f"file://{tmp_path}/m.jsonl")
    assert [(r.idx, r.transaction.merchant.id) for r in rows.collect()] == [(1, "m1")] and bad.count() == 1
    line = sinks.mismatch_lines(rows).first().value
    assert line.startswith("MISMATCH ") and json.loads(line.removeprefix("MISMATCH "))["idx"] == 1


def test_cpu_stat(spark, tmp_path):
    (tmp_path / "cpu.stat").write_text("usage_usec 5\nnr_bursts 0\nthrottled_usec 7\nnr_periods x\n")
    got = {r.name: (r.value, r.noted) for r in readers.read_cpu_stat(spark, f"file://{tmp_path}/cpu.stat").collect()}
    assert got == {"usage_usec": (5, False), "nr_bursts": (0, True), "throttled_usec": (7, True), "nr_periods": (None, True)}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i / 20.0, 1 - i / 20.0], i % 3 == 0) for i in range(20)], "vec_id long, vector array<float>, is_fraud boolean")
    index = IvfIndex.of(rows, centroid_frame(spark, [[0.0, 1.0], [1.0, 0.0]]), IndexParams(dims=2, n_centroids=2, default_probes=1))
    q = rows.selectExpr("cast(vec_id as string) as query_id", "vector as qvector")
    q.repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    score_stream(index, source, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("epoch")
    assert sorted(map(tuple, got.select("query_id", "response").collect())) == sorted(map(tuple, score_batch(index, q).select("query_id", "response").collect()))


def test_every_request_of_a_stream_is_answered(spark, tmp_path):
    """Ids that repeat, with one vector and with two, null ids and null vectors."""
    rows = spark.createDataFrame([(i, [i / 20.0, 1 - i / 20.0], i < 10) for i in range(20)], "vec_id long, vector array<float>, is_fraud boolean")
    index = IvfIndex.of(rows, centroid_frame(spark, [[0.0, 1.0], [1.0, 0.0]]), IndexParams(dims=2, n_centroids=2, default_probes=1))
    asked = [("a", [0.0, 1.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", None), (None, [1.0, 0.0]), ("c", [0.5])]
    q = spark.createDataFrame(asked, "query_id string, qvector array<float>")
    got = sorted((r.query_id or "", r.fraud_count) for r in score_batch(index, q).collect())
    assert got == [("", 0), ("a", 0), ("a", 5), ("a", 5), ("b", 0), ("c", 0)]
    q.write.parquet(f"file://{tmp_path}/in")
    score_stream(index, spark.readStream.schema(q.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert sorted((r.query_id or "", r.fraud_count) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == got
