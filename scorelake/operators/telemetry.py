"""Phase timings and access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.scores import BOUNDS, bound_of, bucket_of


def phase_buckets(timings: DataFrame) -> DataFrame:
    """(phase, bucket, n): the histogram of ``timings`` (phase, us), empty buckets included."""
    counts = timings.groupBy("phase", bucket_of(F.col("us")).alias("bucket")).agg(F.count("*").alias("n"))
    every = timings.select("phase").distinct().select("phase", F.explode(F.sequence(F.lit(0), F.lit(len(BOUNDS)))).alias("bucket"))
    return every.join(counts, ["phase", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def phase_summary(timings: DataFrame) -> DataFrame:
    """(phase, n, total_us, mean_us) with the whole-number mean."""
    return timings.groupBy("phase").agg(F.count("*").alias("n"), F.sum("us").alias("total_us")).withColumn("mean_us", F.expr("total_us div n"))


def bucket_percentile(buckets: DataFrame, p: float) -> DataFrame:
    """(phase, bucket, bound): the first bucket at which the running count reaches floor(n * p), at least 1."""
    run = F.sum("n").over(Window.partitionBy("phase").orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy("phase"))
    rows = buckets.select("phase", "bucket", run.alias("upto"), F.greatest(F.floor(total * F.lit(p)), F.lit(1)).alias("target"))
    first = rows.where("upto >= target").groupBy("phase").agg(F.min("bucket").alias("bucket"))
    return first.withColumn("bound", bound_of(F.col("bucket")))


def log_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tw, Tr, Tt and status of the log lines that have a status; a field that is missing or odd is null."""
    one = lambda k: F.expr(f"try_cast(regexp_extract({column}, '(?:^| ){k}=(-?[0-9]+)(?: |$)', 1) as int)").alias(k)
    return lines.where(F.col(column).contains("status=")).select(one("status"), one("Tw"), one("Tr"), one("Tt"))


def log_buckets(fields: DataFrame) -> DataFrame:
    """(field, bucket, n) of the waiting and response times: aborted (-1), 0, 1, 2-4, 5+ or missing."""
    rows = fields.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("Tw", "Tr")))).alias("x")).select("x.*")
    bucket = F.when(F.col("v").isNull(), "missing").when(F.col("v") < 0, "aborted").when(F.col("v") <= 1, F.col("v").cast("string")).when(F.col("v") < 5, "2-4").otherwise("5+")
    return rows.groupBy("field", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def log_summary(fields: DataFrame) -> DataFrame:
    return fields.agg(F.count("*").alias("total"), F.max("Tt").alias("max_total_ms"))
