"""The decision API over HTTP: ``GET /ready``, ``POST /fraud-score``, ``GET /metrics``.

Meant for trying single requests; large volumes go through the batch and streaming paths, of which this is a
batch of one.  The phases' times are kept as rows and summed up by the telemetry operators.
"""

from __future__ import annotations

import json
import time
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from scorelake.config import Normalization
from scorelake.functions.features import featurize
from scorelake.operators.ivf import IvfIndex
from scorelake.operators.telemetry import bucket_percentile, phase_buckets, phase_summary
from scorelake.schemas import REQUEST_STRUCT
from scorelake.sources.readers import parse_requests
from scorelake.streaming.scorer import score_batch


class ScoreService:
    """Answers requests against one loaded index; at most ``keep`` timings are held."""

    def __init__(self, index: IvfIndex, norm: Normalization | None = None, risk: dict[str, float] | None = None, metrics: bool = True, keep: int = 100_000):
        self.spark = index.vectors.sparkSession
        self.index = IvfIndex(index.centroids.cache(), index.vectors.cache(), index.params)
        self.norm, self.risk, self.metrics = norm or Normalization(), risk or {}, metrics
        self.timings: deque[tuple[str, int]] = deque(maxlen=keep)

    def _timed(self, phase: str, began: float) -> float:
        now = time.perf_counter()
        if self.metrics:
            self.timings.append((phase, int((now - began) * 1e6)))
        return now

    def score(self, body: bytes) -> tuple[int, str]:
        """(status, JSON body) of one request; 400 if it isn't valid."""
        start = at = time.perf_counter()
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            return 400, ""
        rows = parse_requests(self.spark.createDataFrame([(text,)], "value string")).where("valid").select("request").collect()
        at = self._timed("parse", at)
        if not rows:
            return 400, ""
        one = self.spark.createDataFrame([(0, rows[0].request)], f"query_id long, request {REQUEST_STRUCT}")
        vector = featurize(one, self.norm, self.risk, root="request").first().vector
        at = self._timed("vectorize", at)
        query = self.spark.createDataFrame([(0, vector)], "query_id long, qvector array<float>")
        answer = score_batch(self.index, query).first().response
        self._timed("search", at)
        self._timed("total", start)
        return 200, answer

    def report(self) -> str:
        """The phases' counts, means and 99th-percentile bounds as JSON lines, or ``disabled``."""
        if not self.metrics:
            return "disabled"
        rows = self.spark.createDataFrame(list(self.timings), "phase string, us long")
        both = phase_summary(rows).join(bucket_percentile(phase_buckets(rows), 0.99).withColumnRenamed("bound", "p99_below_us"), "phase").drop("bucket")
        return "\n".join(r.j for r in both.orderBy("phase").select(F.to_json(F.struct(*both.columns)).alias("j")).collect())


def serve(service: ScoreService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/ready":
                self._send(200, "", "text/plain")
            elif self.path == "/metrics":
                self._send(200, service.report(), "text/plain")
            else:
                self._send(404, "", "text/plain")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/fraud-score":
                self._send(404, "", "text/plain")
                return
            self._send(*service.score(body))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def evaluate_remote(url: str, bodies: list[dict]) -> list[tuple[int, dict | None]]:
    """Status and answer of each request to a running service, in order; for small labelled sets."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    out: list[tuple[int, dict | None]] = []
    for body in bodies:
        try:
            with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})) as r:
                out.append((r.status, json.loads(r.read())))
        except HTTPError as e:
            out.append((e.code, None))
    return out
