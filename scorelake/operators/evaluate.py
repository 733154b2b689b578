"""Decisions against what was expected: confusion counts, weighted error, scores, probe calibration."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.scores import detection_score, p99_score
from scorelake.operators.decide import decide


def confusion(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and err of ``outcomes`` (status, expected_approved, approved); fraud is the positive class.

    A row whose status isn't 200 is an error and counts nowhere else.
    """
    ok, deny, bad = F.col("status") == 200, ~F.col("approved"), ~F.col("expected_approved")
    counts = {"tp": ok & deny & bad, "tn": ok & ~deny & ~bad, "fp": ok & deny & ~bad, "fn": ok & ~deny & bad, "err": ~ok}
    return outcomes.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in counts.items()))


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` with the weighted error, its rate and the failure rate; all 0 where there are no rows."""
    share = lambda c: F.when(F.col("n") > 0, c / F.greatest(F.col("n"), F.lit(1))).otherwise(F.lit(0.0))
    rows = counts.withColumn("weighted_error", F.col("fp") + 3 * F.col("fn") + 5 * F.col("err"))
    return rows.withColumn("error_rate", share(F.col("weighted_error"))).withColumn("failure_rate", share(F.col("fp") + F.col("fn") + F.col("err")))


def value_at(rows: DataFrame, column: str, rank: int, at_once: int = 10_000, ways: int = 1024) -> float:
    """The value with so many before it in ascending order, by histograms of ever narrower ranges.

    Counts add up map-side, so no task gathers the values; only the last range's (``at_once`` at most) are sorted.
    """
    rows = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    while n > at_once and lo < hi:
        part = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit((hi - lo) / ways)), F.lit(ways - 1))
        rows = rows.where(F.col("v").between(lo, hi))
        for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("part").collect():
            if rank < r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            rank -= r.n
    return lo if lo == hi else sorted(r.v for r in rows.where(F.col("v").between(lo, hi)).collect())[rank]


def percentile(rows: DataFrame, column: str, p: float) -> float:
    """The exact percentile, between two values in proportion; 0 without values."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return 0.0
    place = p * (n - 1)
    low = value_at(rows, column, int(place))
    return low if place == int(place) else low + (place - int(place)) * (value_at(rows, column, int(place) + 1) - low)


def evaluate(outcomes: DataFrame) -> DataFrame:
    """One row: counts, rates, the exact 99th percentile of ``duration_ms`` and the three scores."""
    both = rates(confusion(outcomes)).withColumn("p99", F.lit(percentile(outcomes, "duration_ms", 0.99)))
    both = both.withColumn("p99_score", p99_score(F.col("p99"))).withColumn("detection_score", detection_score(F.col("weighted_error"), F.col("error_rate"), F.col("failure_rate")))
    return both.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def mismatches(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """Decisions that differ from ``expected`` (query_id, expected_approved)."""
    return decisions.join(expected, "query_id").where("approved <> expected_approved")


def calibrate(index, queries: DataFrame, expected: DataFrame, probes: list[int], k: int = 5) -> DataFrame:
    """(probes, n, fp, fn, errors, error_pct, seconds, us_per_query) for each number of probes, each searched and timed."""
    rows = []
    for p in probes:
        began = time.perf_counter()
        found = decide(queries, index.search(queries, k, p), k).join(expected, "query_id").withColumn("status", F.lit(200))
        c = confusion(found).first()
        spent = time.perf_counter() - began
        rows.append((p, c.n, c.fp, c.fn, c.fp + c.fn, 100.0 * (c.fp + c.fn) / max(1, c.n), spent, 1e6 * spent / max(1, c.n)))
    return queries.sparkSession.createDataFrame(rows, "probes int, n long, fp long, fn long, errors long, error_pct double, seconds double, us_per_query double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours (query_id, vec_id) were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.greatest(F.col("n"), F.lit(1)))


def dataset_stats(labelled: DataFrame) -> DataFrame:
    """total, fraud and legit counts and rates (as fractions) of ``labelled`` (expected_approved)."""
    rows = labelled.agg(F.count("*").alias("total"), F.count_if(~F.col("expected_approved")).alias("fraud_count"))
    rows = rows.withColumn("legit_count", F.col("total") - F.col("fraud_count"))
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    return rows.withColumn("fraud_rate", share("fraud_count")).withColumn("legit_rate", share("legit_count"))
