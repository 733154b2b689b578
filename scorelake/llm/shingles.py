"""Sets of hashed word shingles, many texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Bytes hashed together; a longer word is hashed alone.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEPS = [U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of terms: every ASCII character but letters and digits.
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, BLOCK + 1), U(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block; ``gaps`` says which bytes separate words."""
    buf = np.frombuffer(data, np.uint8)
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = gaps[buf]
    edge = np.flatnonzero(np.diff(gap))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    terms = buf.astype(U)
    terms += U(1)
    terms *= up[: len(buf)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _long_text(data: bytes, gaps: np.ndarray = _SPACE) -> np.ndarray:
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not gaps[data[end - 1]]:
            end += 1
        found.append(word_hashes(data[at:end], gaps)[0])
        at = end
    return np.concatenate(found)


def _set_of(w: np.ndarray, k: int) -> np.ndarray:
    n = len(w)
    if not n:
        return np.empty(0, U)
    if n < k:
        return mix((w * np.array(_STEPS[:n], U)).sum(keepdims=True) + U(n))
    h = w[: n - k + 1] * _STEPS[0]
    for j in range(1, k):
        h += w[j : n - k + 1 + j] * _STEPS[j]
    h = mix(h)
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _by_text(texts: Iterable[str | None], lower, gaps: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""

    def flush(group):
        starts = np.cumsum([0] + [len(b) + 1 for b in group])
        w, at = word_hashes(b"\n".join(group), gaps)
        cut = np.searchsorted(at, starts)
        return (w[cut[i] : cut[i + 1]] for i in range(len(group)))

    group: list[bytes] = []
    size = 0
    for s in texts:
        b = lower(s or "")
        if group and size + len(b) > BLOCK:
            yield from flush(group)
            group, size = [], 0
        if len(b) > BLOCK:
            yield _long_text(b, gaps)
        else:
            group.append(b)
            size += len(b) + 1
    if group:
        yield from flush(group)


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes.

    A-Z count as lower case.  A text of fewer than k words has its whole sequence as one shingle; a text
    without words, or none, has the empty set.
    """
    if k > len(_STEPS):
        raise ValueError(f"at most {len(_STEPS)} words")
    return (_set_of(w, k) for w in _by_text(texts, lambda s: s.encode().lower(), _SPACE))


def hashed_terms(texts: Iterable[str | None], bits: int) -> Iterator[np.ndarray]:
    """For each text the distinct hashes, of so many bits, of its terms in lower case, ascending."""
    return (np.unique((w >> U(64 - bits)).astype(np.int64)) for w in _by_text(texts, lambda s: s.lower().encode(), _MARKS))
