"""N-gram Jaccard join with multiple-global-order filtering.

Texts become sets of word shingles; equal sets are one class, and only classes go on.

1. A first pass over the texts counts shingles and finds those that more than one set in ``RARE`` has; there are at
   most the mean size of a set times ``RARE`` of them.  They count as shared without being counted together, so
   that no task gets all the sets with a common line.
2. A second pass hashes the shingles and deals them out, packed, by shingle, in as many parts as their number asks
   for.  Each part counts in how many classes a shingle occurs.  Shingles of a single class cannot be shared: they
   come first in every token order, so a class with too many of them has no partner and leaves (this is the prefix
   filter).
3. The others get their prefixes under three global token orders: rarest first, coarse frequency first, and a
   plain random order behind the single ones.  Two sets that reach the threshold share a prefix token under
   each of the three.
4. Star links first: under six more random orders, the members of every group with the same first token are compared
   with one central member only, which is linear however large a group of near copies is.
5. What these links leave apart is joined on the tokens of the first order, but only between different
   components and where enough shared tokens follow the common one in both sets.

All candidates must share prefix tokens under all three orders; only pairs that do meet their whole sets, and
verification counts the shared shingles exactly.  Nothing is capped; results aren't sampled.  Shingles and sets are
compared by 64-bit hashes: of 1e9 different texts two are taken for equal with a chance of 3 %.  Nulls: a null
text is empty; an empty set links with nothing and its component is its own id; a null doc_id gives a null
component unless its class is linked to another.  Repeated rows are kept.  An empty table gives an empty table.
Extra columns aren't read.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut, partitions, ship
from scorelake.llm.components import components
from scorelake.llm.shingles import U, mix, shingle_sets

DOC, CLASS, TOKENS, HEAVY = 0, 1, 2, 3
NO_ID = np.iinfo(np.int64).max
#: Shingles that a map task gathers before it deals them out.
FLUSH = 1 << 21
#: A shingle is heavy if more than one set in so many has it, and if enough have it at all.
RARE, ENOUGH = 500, 64
#: Shingles counted in one part.
IN_PART = 1 << 22
SEEDS = [U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0)]
STARS = [U(0x082EFA98EC4E6C89), U(0x452821E638D01377), U(0xBE5466CF34E90C6C), U(0xC0AC29B7C97C50DD), U(0x3F84D5B5B5470917), U(0x9216D5D98979FB1B)]
PACKED = "kind int, part int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}q", blob)
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _class_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s ^ SEEDS[0]).sum() ^ U(len(s))], U))[0])


def _packed_lists(part: np.ndarray, parts: int, owner: np.ndarray, values: tuple[np.ndarray, ...]):
    """(part, owners, their counts, values...) for each part; ``owner`` ascends."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, owner, values = part[order], owner[order], [v[order] for v in values]
    cut_at = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        a, b = cut_at[p], cut_at[p + 1]
        if a < b:
            own = owner[a:b]
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            yield p, own[head], np.diff(np.append(head, b - a)).astype(np.uint32), [v[a:b] for v in values]


def _weigh(k: int):
    """(token, n, sets): shingles that are frequent in a run of different sets, and one row with its totals."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        sets, gathered = [], 0

        def flush():
            nonlocal sets, gathered
            tok, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= max(4, len(sets) // RARE)
            tok, n = tok[often].view(np.int64), n[often]
            out = [pa.array([None, *tok.tolist()], pa.int64()), pa.array([gathered, *n.tolist()], pa.int64()), pa.array([len(sets), *[0] * len(tok)], pa.int64())]
            sets, gathered = [], 0
            return pa.RecordBatch.from_arrays(out, names=["token", "n", "sets"])

        for batch in batches:
            for s in shingle_sets((x.as_py() for x in batch.column("text")), k):
                if len(s) and (c := _class_of(s)) not in seen:
                    seen.add(c)
                    sets.append(s)
                    gathered += len(s)
                if gathered >= FLUSH:
                    yield flush()
        if sets:
            yield flush()

    return run


def heavy_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The heavy shingles, ascending, a code of their frequency, and the number of all shingles."""
    seen = cut(docs.mapInArrow(_weigh(k), "token long, n long, sets long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("sets").alias("sets")))
    total = seen.where("token is null").first()
    if total is None:
        return np.empty(0, U), np.empty(0, np.uint8), 0
    found = seen.where((F.col("token").isNotNull()) & (F.col("n") >= ENOUGH) & (F.col("n") * RARE > F.lit(total.sets))).select("token", "n").toPandas()
    tok, n = found["token"].to_numpy(np.int64).view(U), found["n"].to_numpy(np.int64)
    order = np.argsort(tok)
    return tok[order], _code(n[order]), total.n


def _code(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, 4 * np.log2(n)).astype(np.uint8)


def _deal(parts: int, k: int, heavy):
    def run(batches):
        import pyarrow as pa

        heavies, codes = heavy.value
        seen: set[int] = set()
        rows: list[tuple[int, int, bytes]] = []
        ids, sizes, classes, sets, gathered = [], [], [], [], 0

        def flush():
            nonlocal ids, sizes, classes, sets, gathered
            i, n, c = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(classes, U)
            rows.append((DOC, int(c[0] % U(parts)), _pack(i, n, c)))
            one, first = np.unique(c, return_index=True)
            low = np.full(len(one), NO_ID)
            np.minimum.at(low, np.searchsorted(one, c), i)
            p = (one % U(parts)).astype(np.int64)
            for q in np.unique(p):
                m = p == q
                rows.append((CLASS, int(q), _pack(one[m], n[first][m], low[m])))
            if sets:
                tok = np.concatenate([s for _, s in sets])
                owner = np.repeat(np.array([c for c, _ in sets], U), [len(s) for _, s in sets])
                if len(heavies):
                    at = np.minimum(np.searchsorted(heavies, tok), len(heavies) - 1)
                    own = heavies[at] == tok
                    for q, o, count, (t, d) in _packed_lists((owner[own] % U(parts)).astype(np.int64), parts, owner[own], (tok[own], codes[at[own]])):
                        rows.append((HEAVY, q, _pack(o, count, t, d)))
                    tok, owner = tok[~own], owner[~own]
                for q, own, count, (t,) in _packed_lists(((tok >> U(40)) % U(parts)).astype(np.int64), parts, owner, (tok,)):
                    rows.append((TOKENS, q, _pack(own, count, t)))
            ids, sizes, classes, sets, gathered = [], [], [], [], 0
            out = pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["kind", "part", "blob"])
            rows.clear()
            return out

        for batch in batches:
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets((x.as_py() for x in batch.column("text")), k), strict=True):
                c = _class_of(s)
                ids.append(NO_ID if i is None else i)
                sizes.append(len(s))
                classes.append(c)
                if len(s) and c not in seen:
                    seen.add(c)
                    sets.append((c, s))
                    gathered += len(s)
                if gathered >= FLUSH or len(ids) >= FLUSH // 16:
                    yield flush()
        if ids:
            yield flush()

    return run


def _frame(rows: list, docs: tuple | None) -> pd.DataFrame:
    """The packed rows and, one row each, the documents; nullable integers, as floats would lose bits."""
    none = lambda n: pd.array([None] * n, "Int64")
    kind, part, blob = ([r[j] for r in rows] for j in range(3))
    ids = [none(len(rows))] * 3
    if docs:
        i, n, c = docs
        kind, part, blob = kind + [DOC] * len(i), part + [0] * len(i), blob + [None] * len(i)
        own = (pd.arrays.IntegerArray(i, i == NO_ID), pd.array(n, "Int64"), pd.array(c.view(np.int64), "Int64"))
        ids = [pd.concat([pd.Series(a), pd.Series(b)], ignore_index=True) for a, b in zip(ids, own, strict=True)]
    frame = pd.DataFrame({"kind": np.array(kind, np.int32), "part": np.array(part, np.int32), "blob": pd.Series(blob, dtype=object)})
    return frame.assign(doc_id=ids[0], n=ids[1], cls=ids[2])


def _gather_classes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, n, i = (np.concatenate(x) for x in zip(*(_unpack(b, U, np.int64, np.int64) for b in blobs), strict=True))
    one, first, at = np.unique(c, return_index=True, return_inverse=True)
    low = np.full(len(one), NO_ID)
    np.minimum.at(low, at, i)
    return one, n[first], low


def _count(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = int(pdf["part"].iloc[0])
        blobs = {k: [b for x, b in zip(pdf["kind"], pdf["blob"], strict=True) if x == k] for k in (DOC, CLASS, TOKENS, HEAVY)}
        del pdf
        docs = tuple(np.concatenate(x) for x in zip(*(_unpack(b, np.int64, np.int64, U) for b in blobs[DOC]), strict=True)) if blobs[DOC] else None
        rows = [(HEAVY, own, b) for b in blobs[HEAVY]]
        if blobs[CLASS]:
            rows.append((CLASS, own, _pack(*_gather_classes(blobs[CLASS]))))
        if blobs[TOKENS]:
            got = [_unpack(b, U, np.uint32, U) for b in blobs[TOKENS]]
            owner = np.concatenate([np.repeat(o, n) for o, n, _ in got])
            tok = np.concatenate([t for _, _, t in got])
            order = np.argsort(tok)
            tok, owner = tok[order], owner[order]
            same = tok[1:] == tok[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            tok, owner = tok[twice], owner[twice]
            order = np.lexsort((owner, tok))
            tok, owner = tok[order], owner[order]
            new = np.ones(len(tok), bool)  # a class comes once from each map task that saw it
            new[1:] = (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])
            tok, owner = tok[new], owner[new]
            if len(tok):
                head = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
                df = np.diff(np.append(head, len(tok)))
                code = np.repeat(_code(df), df)
                shared = np.repeat(df >= 2, df)
                tok, owner, code = tok[shared], owner[shared], code[shared]
                order = np.argsort(owner, kind="stable")
                tok, owner, code = tok[order], owner[order], code[order]
                for q, o, n, (t, d) in _packed_lists((owner % U(parts)).astype(np.int64), parts, owner, (tok, code)):
                    rows.append((TOKENS, q, _pack(o, n, t, d)))
        return _frame(rows, docs)

    return run


def _prefixes(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, size, low = _gather_classes([b for x, b in zip(pdf["kind"], pdf["blob"], strict=True) if x == CLASS])
        got = [_unpack(b, U, np.uint32, U, np.uint8) for x, b in zip(pdf["kind"], pdf["blob"], strict=True) if x in (TOKENS, HEAVY)]
        del pdf
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if got:
            owner = np.concatenate([np.repeat(o, n) for o, n, _, _ in got])
            tok, code = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
            order = np.lexsort((tok, owner))
            owner, tok, code = owner[order], tok[order], code[order]
            new = np.ones(len(tok), bool)  # a heavy shingle comes from each map task that saw the class
            new[1:] = (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])
            owner, tok, code = owner[new], tok[new], code[new]
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for a, b in zip(head, np.append(head[1:], len(owner)), strict=True):
                lists[int(owner[a])] = (tok[a:b], code[a:b])
        rows = []
        for c, n, i in zip(one, size, low, strict=True):
            tok, code = lists.get(int(c), (np.empty(0, U), None))
            own, n = len(tok), int(n)
            keep = [None] * 5
            if own and 100 * own >= percent * n:
                prefix = n - -(-percent * n // 100) + 1 - (n - own)  # what single shingles leave of it
                ranks = (code, code // 8, np.zeros_like(code))
                orders = [tok[np.lexsort((mix(tok ^ s), r))[:prefix]].view(np.int64) for s, r in zip(SEEDS, ranks, strict=True)]
                stars = np.array([tok[np.argmin(mix(tok ^ s))] ^ s for s in STARS], U).view(np.int64)
                keep = [tok.view(np.int64), *orders, stars]
            middle = float(code.sum(dtype=np.int64)) / n if keep[0] is not None else 0.0
            rows.append((np.int64(c.view(np.int64)), n, None if i == NO_ID else int(i), middle, *keep))
        return pd.DataFrame(rows, columns=["cls", "n", "low", "middle", "tokens", "first", "second", "third", "stars"]).astype({"low": "Int64"})

    return run


ORDERS = ("first", "second", "third")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that share prefix tokens under every order and reach the threshold."""
    side = lambda s, *columns: sets.select(*(F.col(c).alias(f"{c}_{s}") for c in columns), F.col("cls").alias(s))
    both = pairs.join(side("x", "n", *ORDERS), "x").join(side("y", "n", *ORDERS), "y")
    both = both.where(f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    for order in ORDERS:
        both = both.where(F.arrays_overlap(f"{order}_x", f"{order}_y"))
    left = cut(both.select("x", "y"))
    both = left.join(side("x", "n", "tokens"), "x").join(side("y", "n", "tokens"), "y")
    shared = F.size(F.array_intersect("tokens_x", "tokens_y"))
    return both.where(100 * shared >= percent * (F.col("n_x") + F.col("n_y") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets of different components under one key, of ``rows`` (cls, n, comp, key, rest)."""
    rows = cut(rows)
    groups = cut(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    left = cut(rows.join(groups, "key"))
    x, y = (left.select("key", F.col("cls").alias(s), F.col("n").alias(f"size_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("rest").alias(f"rest_{s}")) for s in ("x", "y"))
    # The first token that two sets share in the first order has all the others behind it, in either set.
    reach = f"{100 + percent} * least(rest_x, rest_y) >= {percent} * (size_x + size_y)"
    return x.join(y, "key").where(f"comp_x < comp_y and 100 * least(size_x, size_y) >= {percent} * greatest(size_x, size_y) and {reach}").select("x", "y").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Rows link when ``100 * |intersection| >= percent * |union|``; the component is the least doc_id reachable.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    tokens, codes, total = heavy_shingles(docs.select("text"), words)
    parts = max(partitions(spark), -(-total // IN_PART))
    dealt = docs.mapInArrow(_deal(parts, words, spark.sparkContext.broadcast((tokens, codes))), PACKED)
    counted = cut(dealt.groupBy("part").applyInPandas(_count(parts), PACKED + ", doc_id long, n long, cls long"))
    array = "array<bigint>"
    classes = cut(
        counted.where(F.col("kind") != DOC).groupBy("part").applyInPandas(_prefixes(percent), f"cls long, n long, low long, middle double, tokens {array}, first {array}, second {array}, third {array}, stars {array}")
    )
    sets = classes.where("tokens is not null")

    keyed = sets.select("cls", "middle", F.explode("stars").alias("key"))
    # Aggregates are written before they are joined to their own rows, as only then a hot key's rows can be split.
    star = cut(keyed.groupBy("key").agg(F.max_by("cls", F.struct("middle", "cls")).alias("y"), F.count("*").alias("members")).where("members > 1").drop("members"))
    pairs = keyed.withColumnRenamed("cls", "x").join(star, "key").where("x <> y").select("x", "y").distinct()
    near = cut(components(_verified(pairs, sets, percent)))

    at = sets.join(near, sets.cls == near.node, "left").select("cls", "n", F.coalesce("root", "cls").alias("comp"), F.size("tokens").alias("own"), "first")
    keyed = at.select("cls", "n", "comp", "own", F.posexplode("first").alias("place", "key")).select("cls", "n", "comp", "key", (F.col("own") - F.col("place")).alias("rest"))
    rest = _verified(_apart(keyed, percent), sets, percent)
    hop = near.select("node", "root")
    rest = rest.join(hop.toDF("a", "ra"), "a", "left").join(hop.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    far = cut(components(rest))

    root = classes.join(near, classes.cls == near.node, "left").select("cls", "low", F.coalesce("root", "cls").alias("r1"))
    root = root.join(far, root.r1 == far.node, "left").select("cls", "low", F.coalesce("root", "r1").alias("r"))
    linked = cut(root.groupBy("r").agg(F.min("low").alias("least")))
    label = root.join(linked, "r").select("cls", "least")
    own = counted.where(F.col("kind") == DOC).select("doc_id", "n", "cls")
    return own.join(label, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
