"""The engine's inputs from the test tables: corpus, queries, requests, timings and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.config import IndexParams
from scorelake.operators.ivf import IvfIndex
from scorelake.shared import scratch
from scorelake.sources.readers import corpus_rows

DIMS = 64
PARAMS = IndexParams(dims=DIMS, n_centroids=16, sample_rate=1.0, iters=8, default_probes=13, k=5)
CENTROIDS = PARAMS.n_centroids
#: Searches take every row whose id is divisible by this as a query; evaluations take every row.
EVERY = 100
RISK = {"purchase": 0.8, "error": 0.9, "view": 0.1, "click": 0.25}
_built: dict[tuple[str, str], str] = {}


def raw_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings, of which some have a value too few and some one too many."""
    label = F.when(F.col("label") < 3, "fraud").otherwise("legit")
    v, i = F.col("embedding"), F.col("vec_id") % 50
    vector = F.when(i == 37, F.slice(v, 1, DIMS - 1)).when(i == 41, F.concat(v, F.array(F.lit(0.5).cast("float")))).otherwise(v)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", vector.alias("vector"), label.alias("label"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_rows(raw_corpus(spark, sf), DIMS)


def queries(spark: SparkSession, sf: str, every: int = EVERY) -> DataFrame:
    return corpus(spark, sf).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvector"))


def start(spark: SparkSession, sf: str) -> DataFrame:
    """First centroids for single rounds: the first rows."""
    return corpus(spark, sf).where(F.col("vec_id") < CENTROIDS).select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("vector").alias("centroid"))


def index(spark: SparkSession, sf: str) -> IvfIndex:
    """The trained index over all rows, built and stored once for each application and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        path = scratch(spark)
        IvfIndex.build(corpus(spark, sf), PARAMS).write(path)
        _built[key] = path
    return IvfIndex.load(spark, _built[key], k=PARAMS.k)


def expected(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    """A query is expected to be approved iff its own vector is legitimate."""
    return corpus(spark, sf).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), (~F.col("is_fraud")).alias("expected_approved"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Nested requests from the events: each user's earlier events are the customer's history."""
    rows = events(spark, sf).withColumn("at", F.concat(F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")))
    seconds = F.unix_seconds(F.to_timestamp("at"))
    rows = rows.withColumn("s", seconds)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, -1)
    kind = F.avg("value").over(Window.partitionBy("event_type"))
    rows = rows.select(
        "event_id", "event_type", "value", "k", "at",
        F.coalesce(F.avg("value").over(before), F.lit(0.0)).cast("float").alias("average"), F.count("*").over(day).cast("int").alias("n_day"),
        F.coalesce(F.array_sort(F.collect_set("event_type").over(before)), F.array().cast("array<string>")).alias("known"), F.lag("at").over(order).alias("last_at"), F.lag("k").over(order).alias("last_k"), kind.cast("float").alias("kind_average"),
    )
    struct = lambda **cols: F.struct(*(c.alias(n) for n, c in cols.items()))
    last = F.when(F.col("last_at").isNotNull(), struct(timestamp=F.col("last_at"), km_from_current=F.col("last_k").cast("float")))
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        struct(amount=F.col("value").cast("float"), installments=F.col("k") % 12 + 1, requested_at=F.col("at")).alias("transaction"),
        struct(avg_amount=F.col("average"), tx_count_24h=F.col("n_day"), known_merchants=F.col("known")).alias("customer"),
        struct(id=F.col("event_type"), mcc=F.col("event_type"), avg_amount=F.col("kind_average")).alias("merchant"),
        struct(is_online=F.col("k") % 2 == 0, card_present=F.col("k") % 3 == 0, km_from_home=F.col("k").cast("float")).alias("terminal"),
        last.alias("last_transaction"),
    )


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("phase"), F.floor(F.col("value") * 10).alias("us"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Synthesized access-log lines: every 50th aborts, every 7th has no status."""
    e = F.col("event_id")
    tw = F.when(e % 50 == 0, F.lit(-1)).otherwise(e % 7)
    text = F.concat(F.lit("lb t=0 "), F.when(e % 7 == 6, F.lit("")).otherwise(F.lit("status=200 ")), F.lit("Tq=0 Tw="), tw.cast("string"), F.lit(" Tc=0 Tr="), (e % 11).cast("string"), F.lit(" Tt="), (e % 97).cast("string"), F.lit(" bytes=120 server=a"))
    return spark.read.parquet(f"{sf}/events.parquet").select(text.alias("value"))
