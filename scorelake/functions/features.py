"""A nested transaction to its 14 features, all as columns.  Time is read in UTC whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.config import DEFAULT_RISK, Normalization
from scorelake.functions.vectors import fdiv

DIMS = 14
#: RFC 3339: the offset is mandatory.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _float(x: float | int) -> Column:
    return F.lit(float(x)).cast("float")


def clamp(x: Column) -> Column:
    """Into 0..1; NaN stays NaN and null stays null."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.least(_float(1), F.greatest(_float(0), x)))


def instant(text: Column) -> Column:
    """Microseconds since 1970 of an RFC 3339 text, null if it isn't one."""
    return F.when(text.rlike(INSTANT), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def hour_of(micros: Column) -> Column:
    return F.pmod(F.floor(micros / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def weekday_of(micros: Column) -> Column:
    """Monday is 0; 1970 began on a Thursday."""
    return F.pmod(F.floor(micros / F.lit(86_400_000_000)) + 3, F.lit(7)).cast("int")


def unknown_merchant(known: Column, merchant: Column) -> Column:
    return (~F.array_contains(known, merchant)).cast("float")


def mcc_risk(risk: Column, mcc: Column) -> Column:
    """A category's risk, not clamped; categories that the map lacks have the default."""
    return F.coalesce(F.try_element_at(risk, mcc), _float(DEFAULT_RISK))


def risk_map(risk: dict[str, float]) -> Column:
    pairs = [c for k, v in sorted(risk.items()) for c in (F.lit(k), _float(v))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,float>")


def feature_columns(norm: Normalization, risk: dict[str, float], root: str = "") -> list[Column]:
    """The features in order; ``root`` is the column that holds the request, if it isn't the row itself."""
    c = lambda path: F.col(f"{root}.{path}" if root else path)
    tx = F.coalesce(instant(c("transaction.requested_at")), F.lit(0).cast("long"))
    last = c("last_transaction")
    gap = tx - F.coalesce(instant(c("last_transaction.timestamp")), tx)
    # Whole seconds, cut towards 0; below 0 counts as 0 in the clamp either way.
    seconds = F.floor(F.greatest(gap, F.lit(0).cast("long")) / F.lit(1_000_000))
    minutes = fdiv(seconds.cast("float"), _float(60))
    amount, average = c("transaction.amount"), c("customer.avg_amount")
    return [
        clamp(fdiv(amount, _float(norm.max_amount))),
        clamp(fdiv(c("transaction.installments").cast("float"), _float(norm.max_installments))),
        F.when(average > 0, clamp(fdiv(fdiv(amount, F.nullif(average, _float(0))), _float(norm.amount_vs_avg_ratio)))).otherwise(_float(0)),
        fdiv(hour_of(tx).cast("float"), _float(23)),
        fdiv(weekday_of(tx).cast("float"), _float(6)),
        F.when(last.isNull(), _float(-1)).otherwise(clamp(fdiv(minutes, _float(norm.max_minutes)))),
        F.when(last.isNull(), _float(-1)).otherwise(clamp(fdiv(c("last_transaction.km_from_current"), _float(norm.max_km)))),
        clamp(fdiv(c("terminal.km_from_home"), _float(norm.max_km))),
        clamp(fdiv(c("customer.tx_count_24h").cast("float"), _float(norm.max_tx_count_24h))),
        c("terminal.is_online").cast("float"),
        c("terminal.card_present").cast("float"),
        unknown_merchant(c("customer.known_merchants"), c("merchant.id")),
        mcc_risk(risk_map(risk), c("merchant.mcc")),
        clamp(fdiv(c("merchant.avg_amount"), _float(norm.max_merchant_avg_amount))),
    ]


def featurize(requests: DataFrame, norm: Normalization | None = None, risk: dict[str, float] | None = None, root: str = "", out: str = "vector") -> DataFrame:
    """``requests`` with the feature vector; a projection, so it works on batches and streams alike."""
    return requests.withColumn(out, F.array(*feature_columns(norm or Normalization(), risk or {}, root)))
