"""Language identification: the family first, then one-versus-one linear SVMs between its languages.

Texts become counts of hashed three-byte grams around a letter, over the whole text in lower case.  A linear
SVM for each family (against the rest) picks the family; within it, a linear SVM for each pair of languages
votes.  Training uses a bounded sample of labelled rows, at most ``rows`` in all and as many of each language as of
any other, of the ``MOST_LANGUAGES`` languages with the most rows.  The sample is chosen by a hash of id and text, equal
rows counting once, so it is the same on every run and keeps its bound whatever ids repeat.

Null texts, and texts without a letter, are ``und`` with score 0.  Without any labelled row every text is.
Rows whose label is null aren't learnt from.  An empty table gives an empty table.  Extra columns aren't read;
repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import ship

DIM = 1 << 13
#: Beyond so many languages the rarer ones aren't learnt; their pairs would be too many machines.
MOST_LANGUAGES = 300
BLOCK = 1 << 20
#: Families of ISO 639-1 codes; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed grams of a whole text, block by block."""
    out = np.zeros(DIM, np.float32)
    data = text.lower().encode()
    for at in range(0, max(1, len(data)), BLOCK):
        a = _FOLD[np.frombuffer(data[max(0, at - 2) : at + BLOCK], np.uint8)]
        if not at:
            a = np.concatenate(([np.uint8(32)], a))
        if at + BLOCK >= len(data):
            a = np.concatenate((a, [np.uint8(32)]))
        mid = a[1:-1] != 32
        g = [x[mid].astype(np.uint32) for x in (a[:-2], a[1:-1], a[2:])]
        h = g[0] * np.uint32(0x9E3779B1) + g[1] * np.uint32(0x85EBCA77) + g[2] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(19), minlength=DIM)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies: rows of length one."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def train_svm(x: np.ndarray, sign: np.ndarray, reg: float = 1e-3, steps: int = 150) -> np.ndarray:
    """A linear SVM with squared hinge loss, both sides weighted alike, by accelerated gradient steps; the bias is last."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    sign = sign.astype(np.float32)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), np.float32(1 / (4 + reg))
    for k in range(steps):
        gap = np.maximum(0, 1 - sign * (x @ ahead)) * sign * weight
        new = ahead + rate * (2 * (x.T @ gap) - reg * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Model:
    """Weights of the family machines and of the pair machines, one column each."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        langs, lang = sorted(set(lang)), np.array(lang)
        fam = np.array([family(a) for a in lang]) if len(lang) else np.array([], str)
        self.families = sorted({family(a) for a in langs})
        self.members = {f: [a for a in langs if family(a) == f] for f in self.families}
        columns = [train_svm(x, np.where(fam == f, 1, -1)) for f in self.families]
        self.pairs: dict[tuple[str, str], int] = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                m = (lang == a) | (lang == b)
                self.pairs[a, b] = len(columns)
                columns.append(train_svm(x[m], np.where(lang[m] == a, 1, -1)))
        self.w = np.stack(columns, axis=1) if columns else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.w[:-1] + self.w[-1]
        sure = lambda m: 1 / (1 + np.exp(-3 * float(m)))
        out = []
        for m in margins:
            f = int(np.argmax(m[: len(self.families)]))
            members = self.members[self.families[f]]
            votes, force = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
            for a, b in combinations(members, 2):
                d = float(m[self.pairs[a, b]])
                votes[a if d >= 0 else b] += 1
                force[a] += d
                force[b] -= d
            best = max(members, key=lambda a: (votes[a], force[a]))
            pairs = [sure(d if best == a else -d) for (a, b), j in self.pairs.items() if best in (a, b) for d in [m[j]]]
            out.append((best, sure(m[f]) * min(pairs, default=1.0)))
        return out


def _stacked(texts: Iterable[str | None], at_once: int = 256) -> Iterator[tuple[np.ndarray, list[bool]]]:
    rows, letters = [], []
    for s in texts:
        rows.append(gram_counts(s or ""))
        letters.append(bool(s) and _LETTER.search(s) is not None)
        if len(rows) == at_once:
            yield features(np.stack(rows)), letters
            rows, letters = [], []
    if rows:
        yield features(np.stack(rows)), letters


def _sample(docs: DataFrame, learn: Column, rows: int) -> tuple[np.ndarray, list[str]]:
    """Features and labels of the training sample, in the order of ids."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(rows, MOST_LANGUAGES)).collect()
    if not counts:
        return np.zeros((0, DIM), np.float32), []
    each = rows // len(counts)
    limits = docs.sparkSession.createDataFrame([(r.lang, int((1 << 40) * min(1.0, (1.25 * each + 20) / r.n))) for r in counts], "lang string, _limit long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [gram_counts(s.as_py()) for s in batch.column("text")]
            at = [np.flatnonzero(c) for c in found]
            cols = [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(found, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "at", "n"])

    # Somewhat more than wanted by the hash alone, equal rows once, then exactly so many in the order of the hash.
    keyed = labelled.withColumn("_key", F.xxhash64("doc_id", "text", F.lit(7))).join(F.broadcast(limits), "lang").where(F.pmod("_key", F.lit(1 << 40)) < F.col("_limit"))
    once = keyed.groupBy("lang", "_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    picked = once.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_key"))).where(F.col("_place") <= each)
    got = sorted(picked.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, n array<float>").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.lang, len(r["at"])))
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["n"]
    return features(x), [r.lang for r in got]


def identify(docs: DataFrame, learn: Column, rows: int = 2000) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text, lang), learnt where ``learn`` holds.

    ``rows`` bounds the training sample.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(*_sample(docs.select(F.col("doc_id").cast("long"), "text", "lang"), learn, rows)))

    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            langs, scores = [], []
            for x, letters in _stacked(s.as_py() for s in batch.column("text")):
                found = m.predict(x) if m.families else [("und", 0.0)] * len(letters)
                for (lang, score), ok in zip(found, letters, strict=True):
                    langs.append(lang if ok else "und")
                    scores.append(score if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
