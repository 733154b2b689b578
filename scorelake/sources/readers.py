"""Sources; every one has an explicit schema."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.config import Normalization
from scorelake.functions.vectors import first_dims, valid_vector
from scorelake.sources.arrays import read_elements


class ConfigError(ValueError):
    """A configuration file is missing something or has a value that can't be used."""


def is_fraud(label: Column) -> Column:
    """Exactly ``fraud`` is fraud; anything else, and null, is legitimate."""
    return F.coalesce(label == "fraud", F.lit(False))


def corpus_rows(raw: DataFrame, dims: int) -> DataFrame:
    """``raw`` (vec_id, vector, label) with short vectors left out, long ones cut, and the label decoded."""
    rows = raw.where(valid_vector(F.col("vector"), dims))
    return rows.select("vec_id", first_dims(F.col("vector"), dims).alias("vector"), is_fraud(F.col("label")).alias("is_fraud"))


def read_corpus(spark: SparkSession, path: str, dims: int, parquet: str, partitions: int | None = None) -> DataFrame:
    """A corpus given as one (gzipped) JSON array, stored once as Parquet under ``parquet`` and read from there.

    A JSON array can't be split, so it is read by one task; the file is the only place where that happens.
    Ids are positions in the array.
    """
    raw = spark.read.schema(schemas.CORPUS).option("multiLine", True).json(path)
    # The one task that reads the array meets its records in order, so its running id is their position.
    out = corpus_rows(raw.coalesce(1).select(F.monotonically_increasing_id().alias("vec_id"), "vector", "label"), dims)
    (out.repartition(partitions, "vec_id") if partitions else out.repartition("vec_id")).write.mode("overwrite").parquet(parquet)
    return spark.read.schema("vec_id bigint, vector array<float>, is_fraud boolean").parquet(parquet)


def read_normalization(spark: SparkSession, path: str) -> Normalization:
    rows = spark.read.schema(schemas.NORMALIZATION).option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1 or any(v is None for v in rows[0]):
        raise ConfigError(f"{path} must hold one object with every normalization constant")
    try:
        return Normalization(**rows[0].asDict())
    except ValueError as e:
        raise ConfigError(str(e)) from e


def read_mcc_risk(spark: SparkSession, path: str) -> dict[str, float]:
    """One JSON object of category to risk; any keys."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,float>").alias("m")).limit(2).collect()
    if len(rows) != 1 or rows[0].m is None:
        raise ConfigError(f"{path} must hold one object of numbers")
    return {k: v for k, v in rows[0].m.items() if v is not None}


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``request`` and ``valid``: one JSON request a row, checked field by field.

    Wrong types, broken JSON, missing or null fields, and a last transaction that lacks one are invalid and
    have a null request.  Two leniencies remain: a number is taken for a text, and of repeated keys one counts.
    """
    schema = f"{schemas.REQUEST}, _corrupt string"
    rows = lines.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    there = functools.reduce(lambda a, b: a & b, (F.col(f"_r.{c}").isNotNull() for c in schemas.REQUIRED))
    last = functools.reduce(lambda a, b: a & b, (F.col(f"_r.{c}").isNotNull() for c in schemas.REQUIRED_LAST))
    valid = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & there & (F.col("_r.last_transaction").isNull() | last) & ~F.exists(F.coalesce("_r.customer.known_merchants", F.array().cast("array<string>")), lambda m: m.isNull())
    fields = [F.col(f"_r.{c}").alias(c) for c in schemas._REQUEST_FIELDS]
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("request", F.when(F.col("valid"), F.struct(*fields))).drop("_r")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(idx, expected_approved, request) of a labelled test set, numbered by its own order.

    A set can lie in several files, each a document; it is numbered on through them by name.  A broken one is an error.
    No task holds more than some blocks of a document; their text is stored in the shared folder when this is called.
    """
    value = F.col("value")
    entry = F.from_json(value, f"{schemas.LABELLED_ENTRY}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = read_elements(spark, path, "entries").select("idx", "value", entry.alias("e"))
    # A field of a wrong type is null, as everywhere; text that is no JSON at all has no length as an array.
    broken = F.col("e._corrupt").isNotNull() & F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))).isNull()
    e = F.when(broken, F.raise_error(F.concat(F.lit("broken entry: "), F.substring(value, 1, 200)))).otherwise(F.col("e"))
    return rows.select("idx", e.alias("e")).select("idx", "e.expected_approved", "e.request")


def read_labelled_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED).option("multiLine", True).json(path).select("stats.*")


def read_mismatches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): blank lines are skipped, lines that can't be parsed are kept apart."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schemas.MISMATCH}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    ok = F.col("r._corrupt").isNull() & F.col("r.idx").isNotNull()
    return rows.where(ok).select("r.*").drop("_corrupt"), rows.where(~ok).select("value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an access log that tell a status."""
    return spark.read.text(path).where(F.col("value").contains("status="))


#: What the kernel's scheduling counters that a report points out begin with.
NOTED = ("nr_periods", "nr_throttled", "throttled_usec", "nr_burst", "burst_usec")


def read_cpu_stat(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, noted) of a cgroup's cpu.stat file."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("name"), F.expr("try_cast(get(split(value, '\\\\s+'), 1) as bigint)").alias("value")).withColumn("noted", functools.reduce(lambda a, b: a | b, (F.col("name").startswith(n) for n in NOTED)))
