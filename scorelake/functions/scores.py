"""Decisions, responses and score formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.config import DENY_FROM

#: Upper bounds of the latency buckets in microseconds; the last bucket is open.
BOUNDS = (10, 50, 100, 250, 500, 1000, 5000)


def fraud_score(count: Column, k: int) -> Column:
    """The share of fraudulent neighbours; k divides even where fewer were found."""
    return F.coalesce(count, F.lit(0)).cast("double") / F.lit(float(k))


def approved(count: Column, k: int) -> Column:
    """In whole neighbours, which avoids comparing fractions: 3 of 5 deny."""
    return F.coalesce(count, F.lit(0)) < math.ceil(DENY_FROM * k - 1e-9)


def response(is_approved: Column, score: Column) -> Column:
    return F.to_json(F.struct(is_approved.alias("approved"), score.alias("fraud_score")))


def p99_score(p99: Column) -> Column:
    """1000 a decade below a second of latency; -3000 beyond two seconds, 0 without requests."""
    return F.when(p99 <= 0, F.lit(0.0)).when(p99 > 2000, F.lit(-3000.0)).otherwise(1000 * F.log10(1000 / F.greatest(p99, F.lit(1.0))))


def detection_score(weighted: Column, rate: Column, failures: Column) -> Column:
    """From the weighted errors, their rate and the failure rate; -3000 when too much fails."""
    return F.when(failures > 0.15, F.lit(-3000.0)).otherwise(1000 * F.log10(1 / F.greatest(rate, F.lit(0.001))) - 300 * F.log10(1 + weighted))


def bucket_of(us: Column) -> Column:
    """The number of the first bucket whose bound lies above the value."""
    out = F.lit(len(BOUNDS))
    for i, bound in reversed(list(enumerate(BOUNDS))):
        out = F.when(us < bound, F.lit(i)).otherwise(out)
    return out


def bound_of(bucket: Column) -> Column:
    """A bucket's upper bound; the open one has none."""
    return F.try_element_at(F.array(*map(F.lit, BOUNDS)), bucket + 1)
