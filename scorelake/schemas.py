"""Explicit schemas of everything that is read, as DDL; nothing is inferred."""

from __future__ import annotations

CORPUS = "vector array<float>, label string"

_REQUEST_FIELDS = {
    "id": "string",
    "transaction": "struct<amount: float, installments: int, requested_at: string>",
    "customer": "struct<avg_amount: float, tx_count_24h: int, known_merchants: array<string>>",
    "merchant": "struct<id: string, mcc: string, avg_amount: float>",
    "terminal": "struct<is_online: boolean, card_present: boolean, km_from_home: float>",
    "last_transaction": "struct<timestamp: string, km_from_current: float>",
}
REQUEST = ", ".join(f"{k} {v}" for k, v in _REQUEST_FIELDS.items())
REQUEST_STRUCT = f"struct<{', '.join(f'{k}: {v}' for k, v in _REQUEST_FIELDS.items())}>"
#: Every field of a request that must be there; those of last_transaction only if it is.
REQUIRED = (
    "id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants",
    "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
)
REQUIRED_LAST = ("last_transaction.timestamp", "last_transaction.km_from_current")

LABELLED_ENTRY = f"expected_approved boolean, request {REQUEST_STRUCT}"
LABELLED = f"entries array<struct<{LABELLED_ENTRY}>>, stats struct<total: bigint, fraud_count: bigint, fraud_rate: double, legit_count: bigint, legit_rate: double, edge_case_rate: double>"
MISMATCH = f"idx bigint, id string, expected_approved boolean, actual_approved boolean, actual_fraud_score float, transaction {REQUEST_STRUCT}"
NORMALIZATION = "max_amount float, max_installments float, amount_vs_avg_ratio float, max_minutes float, max_km float, max_tx_count_24h float, max_merchant_avg_amount float"
INDEX_META = "version int, num_vecs bigint, num_centroids int, dims int, default_probes int"
