"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list fixes, for every prefix of a byte string, one last token: the prefix's encoding is the
encoding of a shorter prefix followed by that token.  The transducer keeps the last tokens of the
positions that a later byte can still reach, and emits a token as soon as every one of them agrees on
it.  ``Merges.lookahead`` is the sufficient lookahead of the merge list, computed from the rules alone.  It says how
much is read between two looks for stable tokens, and with the longest token bounds what is kept: memory doesn't
grow with the text.  That all reachable positions agree is what makes a token stable, mostly sooner than the
lookahead.

Two neighbouring tokens can stand side by side in an encoding iff no rule crosses their border at any
time while the two were being built (`Merges.side_by_side`); that local test is all the transducer needs.

Decoding maps ids to bytes and feeds them to an incremental byte-to-text state machine that replaces
malformed sequences.

Null and empty texts give no tokens and the empty text, an empty table an empty table; equal rows give equal
results.  Extra columns are carried along; one named like a result, in any case, gives way to it.  Vocabularies with settings
beyond byte-level BPE (a normalizer, another pre-tokenizer, unknown tokens, word ends) are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import quoted, ship

#: The pre-tokenizer's pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
#: Texts up to this many code points are cut into pieces at once, longer ones piece by piece.
AT_ONCE = 1 << 20
#: Pieces up to this many bytes are remembered, in tables of at most so many entries.
SHORT, REMEMBERED = 48, 600_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list with what the transducer needs of it."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int] | None = None):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = special or {}
        self.id_of = {raw(s): i for s, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(merges):
            left, right = (self.id_of[raw(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.rank.setdefault((left, right), r)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (left, right), r
        self.longest = max(map(len, self.id_of))
        self._reachable()
        self.lookahead = self._sufficient_lookahead()
        self._pairs: dict[int, bool] = {}

    def _reachable(self) -> None:
        """Keeps the tokens that are the encoding of their own bytes; no other can appear."""
        sound = {i for i in self.bytes_of if i not in self.parts and i not in self.special.values()}
        for t in sorted(self.parts, key=self.made.__getitem__):
            left, right = self.parts[t]
            if left in sound and right in sound and not self._crossed(left, right, self.made[t]):
                sound.add(t)
        self.usable = {self.bytes_of[t]: t for t in sound}

    def _crossed(self, x: int, y: int, limit: int = NEVER) -> bool:
        """Whether a rule before ``limit`` crosses the border while ``x`` and ``y`` are being built.

        Goes back in time: the part next to the border that was made last is replaced by its own part there.
        Of two equal rules the left one applies first, hence the two bounds.
        """
        rank, made, parts = self.rank, self.made, self.parts
        until_left, until_right = limit, limit - 1
        while True:
            r = rank.get((x, y), NEVER)
            if r < until_left and r <= until_right:
                return True
            mx, my = made.get(x, -1), made.get(y, -1)
            if mx < 0 and my < 0:
                return False
            if mx > my:
                until_left, x = min(until_left, mx), parts[x][1]
            else:
                until_right, y = min(until_right, my), parts[y][0]

    def side_by_side(self, x: int, y: int) -> bool:
        key = x << 32 | y
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = not self._crossed(x, y)
        return known

    def _sufficient_lookahead(self) -> int:
        """Bytes behind a border after which nothing can change it.

        A rule that crosses a border needs its right part, and that part can only be spoilt by an earlier
        rule which crosses its own right end with one of its suffixes.  Such chains run down the merge list,
        so one pass over the rules in order finds the longest.
        """
        reach: dict[bytes, int] = {}
        longest = 0
        for (left, right), _ in sorted(self.rank.items(), key=lambda kv: kv[1]):
            b = self.bytes_of[right]
            chain = len(b) + max((reach.get(b[i:], 0) for i in range(len(b))), default=0)
            key = self.bytes_of[left]
            if chain > reach.get(key, 0):
                reach[key] = chain
            longest = max(longest, chain)
        return longest

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
        return cls(vocab, spec["model"]["merges"], special)


def _check(spec: dict) -> None:
    """Refuses what the transducer doesn't follow."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or odd:
        raise ValueError(f"only plain byte-level BPE is supported: {odd or [model.get('type'), spec.get('normalizer'), before]}")


@lru_cache(maxsize=2)
def merges_at(path: str) -> Merges:
    """One table for each Python worker, read from the file given by path on the worker's own machine."""
    return Merges.from_file(path)


class Transducer:
    """Bytes in, stable tokens out; at most ``longest + lookahead`` positions are kept between emissions."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.most_kept = 0
        self.resumed: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])

    def run(self, source: Iterable[bytes]) -> Iterator[int]:
        m, longest = self.m, self.m.longest
        usable, side_by_side = m.usable, m.side_by_side
        tail = b""  # bytes since position `base`
        base = 0
        last: list[tuple[int, int]] = [(-1, -1)]  # for each kept position: its last token, and where that token starts
        every = longest + max(64, m.lookahead)
        since = 0
        for chunk in source:
            for at in range(0, len(chunk), every):
                tail += chunk[at : at + every]
                for e in range(base + len(last), base + len(tail) + 1):
                    for s in range(max(base, e - longest), e):
                        t = usable.get(tail[s - base : e - base])
                        if t is not None and ((before := last[s - base][0]) < 0 and last[s - base][1] < 0 and s == 0 or before >= 0 and side_by_side(before, t)):
                            last.append((t, s))
                            break
                    else:
                        raise ValueError("no token ends here")
                since = len(last)
                self.most_kept = max(self.most_kept, since)
                if since > 2 * longest:
                    stable, out = self._stable(last, base, longest)
                    if stable > base:
                        yield from out
                        drop = stable - base
                        tail, last, base = tail[drop:], last[drop:], stable
        yield from self._path(last, base, base + len(last) - 1)

    def short(self, b: bytes) -> list[int]:
        """The same for a piece that is shorter than what is kept anyway: no emission before its end.

        The states after the bytes that the piece before had in common with this one are used again.
        """
        m = self.m
        usable, pairs, longest = m.usable, m._pairs, m.longest
        before, last, start = self.resumed
        same = 0
        for x, y in zip(before, b, strict=False):
            if x != y:
                break
            same += 1
        del last[same + 1 :], start[same + 1 :]
        self.resumed = (b, last, start)
        for e in range(same + 1, len(b) + 1):
            for s in range(max(0, e - longest), e):
                t = usable.get(b[s:e])
                if t is not None:
                    if not s:
                        break
                    ok = pairs.get(last[s] << 32 | t)
                    if m.side_by_side(last[s], t) if ok is None else ok:
                        break
            else:
                raise ValueError("no token ends here")
            last.append(t)
            start.append(s)
        out, e = [], len(b)
        while e:
            out.append(last[e])
            e = start[e]
        return out[::-1]

    @staticmethod
    def _path(last: list[tuple[int, int]], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            t, s = last[end - base]
            out.append(t)
            end = s
        return out[::-1]

    def _stable(self, last: list[tuple[int, int]], base: int, longest: int) -> tuple[int, list[int]]:
        """The rightmost position that lies on the path of every position which a later token can start at."""
        end = base + len(last) - 1
        heads = set(range(max(base, end - longest + 1), end + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(last[top - base][1] if top > base else base)
        stable = heads.pop()
        return stable, self._path(last, base, stable)


class Encoder:
    """Texts to ids: special tokens are cut out, the rest is cut into pieces, each piece goes through the transducer."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.transducer = Transducer(merges)
        self.cut = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.starts = {t[0] for t in merges.special if t}
        self.known: dict[str, bytes] = {}

    def _piece(self, b: bytes) -> bytes:
        m = self.m
        whole = m.usable.get(b)
        if whole is not None:
            return whole.to_bytes(4, "little")
        ids = self.transducer.short(b) if len(b) <= m.longest else self.transducer.run((b,))
        return b"".join([t.to_bytes(4, "little") for t in ids])

    def _learn(self, pieces: set[str]) -> None:
        """Encodes the short pieces that aren't known; in sorted order most of the work is shared prefixes."""
        new = sorted(p.encode() for p in pieces.difference(self.known) if len(p) <= SHORT)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = sorted(p.encode() for p in pieces if len(p) <= SHORT)
        self.known.update((b.decode(), self._piece(b)) for b in new)

    def _join(self, pieces: list[str]) -> bytes:
        known = self.known
        return b"".join([known[p] if p in known else self._piece(p.encode()) for p in pieces])

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian 32-bit integers, block by block; None counts as empty."""
        for group in _groups(texts):
            cut = [self._cut(s) for s in group]
            self._learn({p for parts in cut for part in parts if isinstance(part, list) for p in part})
            for parts in cut:
                yield self._blocks(parts)

    def encode(self, text: str) -> Iterator[bytes]:
        return next(self.encode_all([text]))

    def _cut(self, text: str) -> list:
        """A special token's id, a list of pieces, or a long part as it is."""
        parts = self.special.split(text) if any(c in text for c in self.starts) and self.special.search(text) else (text,)
        return [self.m.special[p] if p in self.m.special else self.cut.findall(p) if len(p) <= AT_ONCE else p for p in parts]

    def _blocks(self, parts: list) -> Iterator[bytes]:
        for part in parts:
            if isinstance(part, int):
                yield part.to_bytes(4, "little")
            elif isinstance(part, list):
                yield self._join(part)
            else:
                found = (x.group() for x in self.cut.finditer(part))
                while block := list(islice(found, 1 << 14)):
                    self._learn(set(block))
                    yield self._join(block)


def _groups(texts: Iterable) -> Iterator[list[str]]:
    """Runs of texts of about AT_ONCE code points together; a longer one stands alone."""
    group, size = [], 0
    for s in texts:
        s = s or ""
        if group and size + len(s) > AT_ONCE:
            yield group
            group, size = [], 0
        group.append(s)
        size += len(s)
    if group:
        yield group


class Decoder:
    """Ids to text: an incremental state machine over the tokens' bytes; ids outside the vocabulary are skipped."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        of = self.bytes_of
        return self.machine.decode(b"".join([of.get(i, b"") for i in ids]), final)


def _ids(block: bytes) -> list[int]:
    return memoryview(block).cast("I").tolist()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids."""
    from pyspark.sql import types as T

    ship(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder(merges_at(path))
        for batch in batches:
            yield pd.Series([[i for block in blocks for i in _ids(block)] for blocks in enc.encode_all(batch)], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give the empty text."""

    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = merges_at(path)
        for batch in batches:
            yield batch.map(lambda x: Decoder(merges).feed([] if x is None else x, True))

    return df.withColumn(text, run(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each row's token count and digests of its ids and of the text decoded from them, block by block.

    Returns the columns of ``df`` but the text, then ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    df = df.select(*map(quoted, kept), text)
    out = df.select(*map(quoted, kept), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        merges = merges_at(path)
        enc = Encoder(merges)
        for batch in batches:
            n, a, b = [], [], []
            for blocks in enc.encode_all(s.as_py() for s in batch.column(text)):
                ids, txt, dec, count = hashlib.sha256(), hashlib.sha256(), Decoder(merges), 0
                for block in blocks:
                    count += len(block) // 4
                    ids.update(block)
                    txt.update(dec.feed(_ids(block)).encode())
                txt.update(dec.feed((), True).encode())
                n.append(count)
                a.append(ids.hexdigest())
                b.append(txt.hexdigest())
            cols = [batch.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, out)
