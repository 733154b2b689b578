"""Requests as a stream: featurizing is a stateless projection, scoring runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelake.config import Normalization
from scorelake.functions.features import featurize
from scorelake.operators.decide import decide
from scorelake.operators.ivf import IvfIndex
from scorelake.operators.telemetry import phase_buckets
from scorelake.sources.readers import parse_requests


def score_batch(index: IvfIndex, queries: DataFrame, k: int | None = None, probes: int | None = None) -> DataFrame:
    """One decision for every row of a batch of ``queries`` (query_id, qvector), ids that repeat included.

    The search sees rows by a number of their own, which stays the same as the numbered rows are kept.
    """
    k = k or index.params.k
    rows = queries.select("query_id", "qvector").withColumn("_row", F.monotonically_increasing_id()).persist()
    own = rows.select(F.col("_row").alias("query_id"), "qvector")
    answers = decide(own, index.search(own, k, probes), k).withColumnRenamed("query_id", "_row")
    return rows.select("query_id", "_row").join(answers, "_row").drop("_row")


def request_stream(lines: DataFrame, norm: Normalization | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """Valid requests of a stream (or batch) of JSON lines as (query_id, qvector)."""
    ok = parse_requests(lines).where("valid")
    return featurize(ok, norm, risk, root="request", out="qvector").select(F.col("request.id").alias("query_id"), "qvector")


def score_stream(index: IvfIndex, queries: DataFrame, sink: str, checkpoint: str, k: int | None = None, probes: int | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Scores a stream of (query_id, qvector) and writes each batch's decisions under ``sink``, one for every request.

    It ends with what is available, or goes on, a batch every so often (``every``, such as "10 seconds").  A ranking isn't allowed on a stream, so it runs inside ``foreachBatch``.  Each batch overwrites its own
    folder, so one that is repeated after a failure leaves its rows once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            out = score_batch(index, batch, k, probes)
            out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
            if on_batch:
                on_batch(batch, epoch)
        finally:
            batch.unpersist()

    when = {"processingTime": every} if every else {"availableNow": True}
    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**when).start()


def metrics_stream(timings: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Phase histograms of a stream of (phase, us), one folder for each micro-batch."""
    write = lambda batch, epoch: phase_buckets(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
    return timings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
