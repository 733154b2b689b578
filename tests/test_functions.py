import json
import math

import pytest
from pyspark.sql import functions as F

from scorelake.config import IndexParams, Normalization
from scorelake.functions import features, scores, vectors
from scorelake.sources.readers import parse_requests


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_quantize(spark):
    given = [0.0, 1.0, -1.0, 2.0, -2.0, 0.5, -0.5, float("nan"), None]
    assert column(spark, given, "float", vectors.quantize) == [0, 127, -127, 127, -127, 64, -64, 0, None]


def test_quantization_error_is_half_a_step(spark):
    v = [math.sin(i) for i in range(200)]
    back = column(spark, [v], "array<float>", lambda x: vectors.dequantize_vector(vectors.quantize_vector(x)))[0]
    assert max(abs(a - b) for a, b in zip(v, back, strict=True)) <= 0.5 / 127 + 1e-6


@pytest.mark.parametrize("dims", [14, 200])
def test_squared_distance(spark, dims):
    one = [1.0] + [0.0] * (dims - 1)
    rows = spark.createDataFrame([([0.0] * dims, one), (one, one)], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.sq_l2(F.col("a"), F.col("b"), dims)).collect()] == [1.0, 0.0]
    byte = rows.select(vectors.sq_l2(vectors.quantize_vector("a"), vectors.quantize_vector("b"), dims, True)).collect()
    assert [r[0] for r in byte] == [127 * 127, 0]


def request(**parts):
    base = {
        "id": "t1",
        "transaction": {"amount": 100.0, "installments": 3, "requested_at": "2026-03-23T12:00:00Z"},
        "customer": {"avg_amount": 50.0, "tx_count_24h": 2, "known_merchants": ["m1"]},
        "merchant": {"id": "m1", "mcc": "5411", "avg_amount": 60.0},
        "terminal": {"is_online": True, "card_present": False, "km_from_home": 10.0},
        "last_transaction": {"timestamp": "2026-03-23T11:00:00Z", "km_from_current": 5.0},
    }
    for k, v in parts.items():
        base[k] = {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base


def vector_of(spark, *requests, risk=None):
    rows = parse_requests(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "i int, value string"))
    out = features.featurize(rows.where("valid"), Normalization(), risk or {}, root="request").orderBy("i").collect()
    return [r.vector for r in out]


def test_weekday_and_hour(spark):
    days = ["2026-03-23", "2026-03-24", "2026-03-25", "2026-03-26", "2026-03-27", "2026-03-28", "2026-03-15"]
    got = vector_of(spark, *(request(transaction={"requested_at": f"{d}T12:00:00Z"}) for d in days))
    assert [v[4] for v in got] == pytest.approx([0, 1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6, 1])
    hours = vector_of(spark, request(transaction={"requested_at": "2026-03-23T00:00:00Z"}), request(transaction={"requested_at": "2026-03-23T23:00:00Z"}), request(transaction={"requested_at": "2026-03-23T23:30:00-03:00"}))
    assert [v[3] for v in hours] == pytest.approx([0, 1, 2 / 23])


def test_features_of_edges(spark):
    plain, no_last, bad_time, no_offset, bad_last, negative, fraction, no_average, stranger = vector_of(
        spark,
        request(),
        request(last_transaction=None),
        request(transaction={"requested_at": "yesterday"}),
        request(transaction={"requested_at": "2026-03-23T12:00:00"}),
        request(last_transaction={"timestamp": "?"}),
        request(last_transaction={"timestamp": "2026-03-23T13:00:00Z"}),
        request(last_transaction={"timestamp": "2026-03-23T11:59:59.400Z"}),
        request(customer={"avg_amount": 0.0}),
        request(merchant={"id": "m2", "mcc": "0"}),
        risk={"5411": 1.5},
    )
    assert plain == pytest.approx([0.01, 0.25, 0.2, 12 / 23, 0, 60 / 1440, 0.005, 0.01, 0.1, 1, 0, 0, 1.5, 0.006], abs=1e-6)
    assert no_last[5:7] == [-1, -1]
    assert bad_time[3:5] == pytest.approx([0, 0.5]) and no_offset[3:5] == pytest.approx([0, 0.5])
    assert bad_last[5] == negative[5] == fraction[5] == no_average[2] == 0
    assert stranger[11:13] == [1, 0.5]


def test_request_validation(spark):
    bad = [
        request(transaction={"installments": 1.5}),
        request(transaction={"installments": 2**31}),
        request(transaction={"installments": "1"}),
        request(merchant={"mcc": None}),
        {k: v for k, v in request().items() if k != "terminal"},
        request(last_transaction={"timestamp": None}),
    ]
    texts = [json.dumps(r) for r in bad] + ["{", "", "[]", None]
    rows = spark.createDataFrame([(t,) for t in texts] + [(json.dumps({**request(), "other": 1}),)], "value string")
    got = parse_requests(rows).collect()
    assert [r.valid for r in got] == [False] * len(texts) + [True]
    assert got[0].request is None and got[-1].request.id == "t1"


def test_decision_table(spark):
    rows = spark.range(6).select(F.col("id"), scores.fraud_score(F.col("id"), 5).alias("s"), scores.approved(F.col("id"), 5).alias("a"))
    got = rows.withColumn("r", scores.response(F.col("a"), F.col("s"))).orderBy("id").collect()
    assert [r.s for r in got] == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1]) and [r.a for r in got] == [True] * 3 + [False] * 3
    assert json.loads(got[3].r) == {"approved": False, "fraud_score": 0.6}


def test_parameters_are_checked():
    for bad in ({"k": 0}, {"default_probes": 0}, {"dims": 0}, {"sample_rate": 0.0}):
        with pytest.raises(ValueError):
            IndexParams(**bad)
    with pytest.raises(ValueError):
        Normalization(max_km=0.0)
