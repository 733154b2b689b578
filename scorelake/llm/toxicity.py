"""Toxicity by a factorization machine over hashed terms.

The distinct terms of a whole text (runs of letters and digits, lower case) are hashed.  Next to a weight for
each term the machine has a short vector for each, and the products of two terms' vectors weigh their meeting
in one text, such as an insult with the mention of a group, which additive weights can't.  A term takes part
if its own texts are toxic more or less often than chance allows, or, whatever it tells alone, if its meetings with
another term are, beyond what the two tell alone (`paired`, among the ``MOST_PAIRED`` most frequent terms).
Hashed vocabularies are mostly terms that would only be learnt by heart; letting all in loses a fifth of
the toxic texts.

Training uses a sample of labelled rows, at most ``toxic_rows`` and ``clean_rows`` of them whatever the ids are,
chosen by a hash of the id, with the intercept put back to the true shares.  An id that repeats is one row of the
sample: its label is the greater one, its text the first by hash.  Empty and null texts get the score of no term.
Rows without a label, or with a null one, aren't learnt from.  With no labelled row, or labels of one kind
only, the score is that share.  An empty table gives an empty table.  Extra columns aren't read; repeated rows are
kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship
from scorelake.llm.shingles import hashed_terms

BITS = 18
#: Terms among which meetings are counted: a bound on the work of training.
MOST_PAIRED = 2500


def _values(n: np.ndarray) -> np.ndarray:
    """The value of each term in a text of n distinct ones: long texts count a term a little less."""
    return (np.maximum(n, 1) ** -0.1).astype(np.float32)


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def calibrate(z: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept that make log odds of texts the machine hasn't seen fit their labels (Platt's way)."""
    ones = label.sum()
    aim = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack((z, np.ones_like(z)), axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c -= 0.5 * np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([1e-3, 1e-6]), x.T @ (p - aim))
    return (float(c[0]), float(c[1])) if c[0] > 0 else (1.0, 0.0)


class Machine:
    """Intercept, weights and vectors over hashed terms; terms that training didn't see have none."""

    def __init__(self, bits: int = BITS, rank: int = 8):
        self.bias = 0.0
        self.w = np.zeros(1 << bits, np.float32)
        self.v = np.zeros((1 << bits, rank), np.float32)

    def score(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of texts whose distinct terms stand one after the other in ``at``."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        told = self.w[at] != 0
        at, owner = at[told], owner[told]
        x = _values(sizes)[owner]
        if not len(at):
            return np.full(len(sizes), self.bias)
        out = np.bincount(owner, self.w[at] * x, len(sizes))
        for f in range(self.v.shape[1]):
            vx = self.v[at, f] * x
            out += 0.5 * (np.bincount(owner, vx, len(sizes)) ** 2 - np.bincount(owner, vx * vx, len(sizes)))
        return out + self.bias

    def fit(self, at: np.ndarray, sizes: np.ndarray, label: np.ndarray, share: float) -> None:
        """Learns from four texts in five and calibrates on the fifth; ``share`` is the share of label 1 among all labelled rows."""
        got = float(np.mean(label)) if len(sizes) else 0.0
        if got in (0.0, 1.0):
            self.bias = _odds(share)
            return
        held = np.arange(len(sizes)) % 5 == 4
        flat = np.repeat(held, sizes)
        self._learn(at[~flat], sizes[~held], label[~held])
        if 0 < label[held].sum() < held.sum():
            slope, shift = calibrate(self.score(at[flat], sizes[held]), label[held])
            self.bias, self.w, self.v = self.bias * slope + shift, self.w * np.float32(slope), self.v * np.float32(slope**0.5)
        self.bias += _odds(share) - _odds(got)

    def _learn(self, at, sizes, label, epochs: int = 40, rate: float = 0.15, reg: float = 2e-6, batch: int = 400, seed: int = 11, least: int = 3, screen: float = 4.0) -> None:
        """Adaptive gradient steps on the logistic loss over the terms that tell something, alone or in a meeting."""
        n, got = len(sizes), float(np.mean(label)) if len(sizes) else 0.0
        self.bias = _odds(got)
        if got in (0.0, 1.0):
            return
        rng = np.random.default_rng(seed)
        owner = np.repeat(np.arange(n), sizes)
        seen = np.bincount(at, minlength=len(self.w))
        toxic = np.bincount(at, label[owner], len(self.w))
        telling = (seen >= least) & (np.abs(toxic - seen * got) / np.sqrt(np.maximum(seen, 1) * got * (1 - got)) >= screen)
        telling[paired(at, owner, label, seen, toxic)] = True
        told = telling[at]
        owner = owner[told]
        terms, at = np.unique(at[told], return_inverse=True)
        value = _values(sizes)
        size = np.bincount(owner, minlength=n)
        start = np.concatenate(([0], np.cumsum(size)))
        rank = self.v.shape[1]
        w, v = np.full(len(terms), 1e-6, np.float32), rng.normal(0, 0.02, (len(terms), rank)).astype(np.float32)
        bias, sw, sv, sb = self.bias, np.full(len(w), 1e-4, np.float32), np.full(v.shape, 1e-4, np.float32), 1e-4
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo : lo + batch]
                own = size[rows]
                flat = at[np.repeat(start[rows] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())]
                mine, flat = np.unique(flat, return_inverse=True)
                owner = np.repeat(np.arange(len(rows)), own)
                x = value[rows][owner]
                vx = v[mine][flat] * x[:, None]
                total = np.stack([np.bincount(owner, vx[:, f], len(rows)) for f in range(rank)], axis=1)
                z = bias + np.bincount(owner, w[mine][flat] * x, len(rows)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(owner, (vx * vx).sum(axis=1), len(rows)))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
                e = err[owner] * x
                gw = np.bincount(flat, e, len(mine)) + reg * w[mine]
                gv = np.stack([np.bincount(flat, e * (total[owner, f] - vx[:, f]), len(mine)) for f in range(rank)], axis=1) + reg * v[mine]
                sw[mine] += gw**2
                sv[mine] += gv**2
                sb += err.sum() ** 2
                w[mine] -= rate * gw / np.sqrt(sw[mine])
                v[mine] -= 0.2 * rate * gv / np.sqrt(sv[mine])
                bias -= rate * err.sum() / np.sqrt(sb)
        self.w[terms], self.v[terms], self.bias = w, v, float(bias)


def paired(at: np.ndarray, owner: np.ndarray, label: np.ndarray, seen: np.ndarray, toxic: np.ndarray, least: int = 20, screen: float = 6.0) -> np.ndarray:
    """The terms whose meetings with another are toxic more or less often than the two terms' own shares explain.

    Counts all pairs of the ``MOST_PAIRED`` most frequent terms that are in ``least`` texts; the share expected
    of a meeting is the one whose log odds are the sum of the two terms' shifts.
    """
    terms = np.argsort(-seen, kind="stable")[:MOST_PAIRED]
    terms = np.sort(terms[seen[terms] >= least])
    place = np.full(len(seen), -1)
    place[terms] = np.arange(len(terms))
    here = place[at] >= 0
    x = np.zeros((len(label), len(terms)), np.float32)
    x[owner[here], place[at[here]]] = 1
    odds = lambda p: np.log(p / (1 - p))
    base = odds(label.mean())
    shift = odds((toxic[terms] + label.mean()) / (seen[terms] + 1)) - base
    bad, telling = x[label == 1], np.zeros(len(terms), bool)
    for lo in range(0, len(terms), 500):
        part = slice(lo, lo + 500)
        n, k = x[:, part].T @ x, bad[:, part].T @ bad
        p = 1 / (1 + np.exp(-(base + shift[part, None] + shift[None, :])))
        far = np.abs(k - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9) + 1)
        far[n < least] = 0
        far[np.arange(far.shape[0]), np.arange(lo, lo + far.shape[0])] = 0
        telling |= (far >= screen).any(axis=0)
        telling[part] |= (far >= screen).any(axis=1)
    return terms[telling]


def _batches(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for t in hashed_terms(texts, BITS):
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int, clean_rows: int):
    """Terms, sizes and labels of the training sample, in the order of ids, and the share of label 1 among all labelled rows."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.xxhash64("doc_id", F.lit(11))
    picked = None
    for label, most in ((1, toxic_rows), (0, clean_rows)):
        # About a quarter more than wanted by the hash alone, then exactly so many in the order of the hash.
        near = known.where((F.col("toxic") == label) & (F.pmod(chance, F.lit(1 << 20)) < F.lit(int((1 << 20) * (1.25 * most + 20) / max(1, counts.get(label, 0))))))
        some = near.orderBy(chance).limit(most)
        picked = some if picked is None else picked.unionByName(some)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = list(hashed_terms((s.as_py() for s in batch.column("text")), BITS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32()))], names=["doc_id", "toxic", "at"])

    # The sample's size is bounded by its parameters, so it is the side to broadcast; an id gives one text.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(run, "doc_id long, toxic int, at array<int>")
    got = sorted(rows.toPandas().itertuples(index=False), key=lambda r: r.doc_id)
    sizes = np.array([len(r.at) for r in got], np.int64)
    at = np.concatenate([np.asarray(r.at, np.int64) for r in got]) if got else np.empty(0, np.int64)
    return at, sizes, np.array([r.toxic for r in got], np.float64), counts.get(1, 0) / max(1, sum(counts.values()))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = 5000, clean_rows: int = 7000) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic) where ``learn`` holds."""
    spark = docs.sparkSession
    ship(spark)
    machine = Machine()
    machine.fit(*_sample(docs, labels, learn, toxic_rows, clean_rows))
    shared = spark.sparkContext.broadcast(machine)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            scores = []
            for group in _batches(s.as_py() for s in batch.column("text")):
                z = m.score(np.concatenate(group), np.array([len(t) for t in group]))
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
