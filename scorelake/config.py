"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class IndexParams:
    """How an index is built and searched; every one of these varies between deployments."""

    dims: int = 14
    n_centroids: int = 1000
    sample_rate: float = 0.1
    iters: int = 20
    seed: int = 42
    default_probes: int = 50
    k: int = 5

    def __post_init__(self) -> None:
        for name in ("dims", "n_centroids", "default_probes", "k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if not 0 < self.sample_rate <= 1 or self.iters < 0:
            raise ValueError("sample_rate must lie in (0, 1] and iters be 0 or more")


@dataclass(frozen=True)
class Normalization:
    """The seven constants that scale a transaction's fields; each divides, so each must be above 0."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name) > 0:
                raise ValueError(f"{f.name} must be above 0")


#: Share of fraudulent neighbours from which a transaction is denied, and the risk of an unknown category.
DENY_FROM = 0.6
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Limits:
    """What may be sent to every task; beyond it the operators work in blocks or shuffle."""

    query_block: int = 4096
    broadcast_rows: int = field(default=200_000)
