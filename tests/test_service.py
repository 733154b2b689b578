import json
import random
import threading
from urllib.request import urlopen

from scorelake.config import IndexParams
from scorelake.functions.features import DIMS
from scorelake.operators.ivf import IvfIndex
from scorelake.operators.kmeans import centroid_frame
from scorelake.service import ScoreService, evaluate_remote, serve
from tests.test_functions import request


def test_http_surface(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(DIMS)], True) for i in range(30)], "vec_id long, vector array<float>, is_fraud boolean")
    index = IvfIndex.of(rows, centroid_frame(spark, [[0.2] * DIMS, [0.8] * DIMS]), IndexParams(dims=DIMS, n_centroids=2, default_probes=2))
    server = serve(ScoreService(index))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert urlopen(f"{base}/ready").status == 200
        got = evaluate_remote(f"{base}/fraud-score", [request(), {"id": "x"}])
        assert got == [(200, {"approved": False, "fraud_score": 1.0}), (400, None)]
        lines = [json.loads(x) for x in urlopen(f"{base}/metrics").read().decode().splitlines()]
        assert {x["phase"]: x["n"] for x in lines} == {"parse": 2, "vectorize": 1, "search": 1, "total": 1}
    finally:
        server.shutdown()
    assert ScoreService(index, metrics=False).report() == "disabled"
