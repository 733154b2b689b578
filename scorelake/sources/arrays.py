"""The elements of a long array in JSON documents, read by many tasks, none of which holds a document.

A file is read in records that end in ``}``, so splits of any document do, however its lines break.  The records are
stored in blocks, each with what it does to quoting and depth; from that the driver knows every block's start, then
which elements the blocks hold.  An element that crosses blocks is given by the block where it begins.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.shared import scratch
from scorelake.workers import ship

#: Bytes of text from which a block is complete.
SIZE = 1 << 20
KEY = "file bigint, start bigint, n bigint"
BLOCKS = f"{KEY}, size bigint, body binary, flips boolean, rise bigint, rise_quoted bigint"
OUTLINE = f"{KEY}, commas bigint, head binary, closed boolean, within bigint, since bigint, opens bigint"
QUOTE, COMMA, ESCAPE, LAST, LIST = b'",\\}['
MARK = np.isin(np.arange(256), list(b'"{}[],'))
STEP = np.isin(np.arange(256), list(b"{[")).astype(np.int64) - np.isin(np.arange(256), list(b"}]"))


class BrokenDocument(ValueError):
    """A file isn't whole JSON, or no object."""


def marks(text: np.ndarray, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and characters of brackets and commas outside strings, and whether ``text`` ends inside one."""
    at = np.flatnonzero(MARK[text])
    quote = text[at] == QUOTE
    doubtful = at[quote]
    doubtful = doubtful[(doubtful > 0) & (text[doubtful - 1] == ESCAPE)]
    if len(doubtful):
        other = np.maximum.accumulate(np.where(text == ESCAPE, -1, np.arange(len(text))))
        keep = ~np.isin(at, doubtful[(doubtful - 1 - other[doubtful - 1]) % 2 == 1])
        at, quote = at[keep], quote[keep]
    inside = (np.cumsum(quote) + quoted) % 2 == 1
    at_end = bool(inside[-1]) if len(at) else quoted
    at = at[~quote & ~inside]
    return at, text[at], at_end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("body", pa.binary()), ("flips", pa.bool_()), ("rise", pa.int64()), ("rise_quoted", pa.int64())])
    key, n, held, size = None, 0, [], 0

    def block() -> pa.RecordBatch:
        text = np.concatenate(held)
        _, kinds, flips = marks(text, False)
        _, others, _ = marks(text, True)
        values = (*key, n, len(text), pa.compress(text.tobytes(), "lz4", asbytes=True), flips, int(STEP[kinds].sum()), int(STEP[others].sum()))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        file, start = (batch.column(i).to_numpy() for i in (0, 1))
        values = batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        body = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        changes = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for lo, hi in pairwise([0, *changes.tolist(), len(values)]):
            if lo == hi:
                continue
            if key != (now := (int(file[lo]), int(start[lo]))):
                if held:
                    yield block()
                key, n, held, size = now, 0, [], 0
            held.append(np.insert(body[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo], LAST))
            size += len(held[-1])
            if size >= SIZE:
                yield block()
                n, held, size = n + 1, [], 0
    if held:
        yield block()


def _starts(blocks: list, lengths: dict[str, int]) -> dict[tuple, tuple[bool, int, bool]]:
    """(quoted, depth, cut) at the start of each block; cut: its last ``}`` isn't in the file, which ends without one."""
    starts = {}
    for k, (name, b) in enumerate(blocks):
        if k == 0 or blocks[k - 1][0] != name:
            quoted, depth, total = False, 0, 0
        key, before = (b.file, b.start, b.n), (quoted, depth)
        total += b.size
        depth += b.rise_quoted if quoted else b.rise
        quoted ^= b.flips
        last = k + 1 == len(blocks) or blocks[k + 1][0] != name
        if quoted and last or depth < (-1 if last else 0) or last and depth > (-1 if total == lengths[name] + 1 else 0):
            raise BrokenDocument(f"{name} isn't whole JSON")
        starts[key] = (*before, last and depth < 0)
    return starts


def _named(text: np.ndarray, field: str) -> bool:
    name, colon, rest = text.tobytes().rpartition(b":")
    try:
        return bool(colon) and not rest.strip() and json.loads(name) == field
    except ValueError:
        return False


def segments(text: np.ndarray, quoted: bool, depth: int, field: str) -> list[tuple[bool, int, list[int], int, bool]]:
    """(opened, from, commas, to, closed) of what lies in something at depth 2 that began before, and in arrays ``field``."""
    at, kinds, _ = marks(text, quoted)
    steps = STEP[kinds]
    after = depth + np.cumsum(steps)
    if (after < 0).any() or ((after == 1) & (kinds == LIST)).any():
        raise BrokenDocument("a document isn't one object")
    comma = at[(kinds == COMMA) & (after == 2)]
    out, now = [], (False, 0) if depth >= 2 else None

    def end(to: int, closed: bool) -> None:
        lo, hi = np.searchsorted(comma, (now[1], to))
        out.append((*now, comma[lo:hi].tolist(), to, closed))

    for e in np.flatnonzero(((after == 2) & (steps > 0)) | ((after == 1) & (steps < 0))).tolist():
        if steps[e] < 0:
            if now:
                end(int(at[e]), True)
            if now and now[0] and kinds[e] == LAST:
                raise BrokenDocument(f"an array {field} ends in a brace")
            now = None
        else:
            named = kinds[e] == LIST and _named(text[at[e - 1] + 1 if e else 0 : at[e]], field)
            now = (True, int(at[e]) + 1) if named else None
    if now:
        end(len(text), False)
    return out


def _bodies(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[tuple]:
    for batch in batches:
        for file, start, n, size, body in zip(*(c.to_pylist() for c in batch.columns)):
            quoted, depth, cut = starts[file, start, n][:3]
            text = np.frombuffer(pa.decompress(body, size, "lz4"), np.uint8)
            yield (file, start, n), text[:-1] if cut else text, quoted, depth


def _outline(starts: dict, field: str) -> Callable:
    """For each block: commas up to the first end at depth 2 and the text up to the first of these, elements of arrays that lie in the block, and commas in an array left open (or null), and arrays that open."""
    def run(batches):
        for key, text, quoted, depth in _bodies(batches, starts):
            commas, head, closed, within, since, opens = 0, b"", False, 0, None, 0
            for opened, lo, cuts, hi, ended in segments(text, quoted, depth, field):
                opens += opened
                if not opened:
                    commas, head, closed = len(cuts), text[: cuts[0] if cuts else hi].tobytes(), ended
                elif ended:
                    within += len(cuts) + 1 if cuts or text[lo:hi].tobytes().strip() else 0
                else:
                    since = len(cuts)
            values = (*key, commas, head, closed, within, since, opens)
            kinds = (*[pa.int64()] * 4, pa.binary(), pa.bool_(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["file", "start", "n", "commas", "head", "closed", "within", "since", "opens"])

    return run


def _elements(starts: dict, field: str) -> Callable:
    def run(batches):
        for key, text, quoted, depth in _bodies(batches, starts):
            inside, number, rest = starts[key][3:]
            ids, values, body = [], [], text.tobytes()
            for opened, lo, cuts, hi, ended in segments(text, quoted, depth, field):
                if not opened and not inside:
                    continue
                parts = [body[a + 1 : b] for a, b in pairwise([lo - 1, *cuts, hi])]
                if not ended and (opened or cuts):
                    parts[-1] += rest
                if not opened:
                    parts, number = parts[1:], number + 1
                if opened and ended and not cuts and not parts[0].strip():
                    continue
                if not all(p.strip() for p in parts):
                    raise BrokenDocument(f"an array {field} lacks an element between commas")
                ids.extend(range(number, number + len(parts)))
                values.extend(parts)
                number += len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["idx", "value"])

    return run


def read_elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(idx, value): the JSON text of each element of the top level's array ``field``.

    ``path`` is a file or a folder of files, each a document; the elements are numbered on through the files by name.
    The text is stored once, in the shared folder, before anything is returned.
    """
    ship(spark)
    text = spark.read.option("lineSep", chr(LAST)).text(path)
    stored = scratch(spark)
    text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")).mapInArrow(_blocks, BLOCKS).write.option("compression", "none").parquet(stored)
    blocks = spark.read.schema(BLOCKS).parquet(stored)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"), "length").collect()
    names = {f.file: f.name for f in files}
    held = sorted(((names[b.file], b) for b in blocks.drop("body").collect()), key=lambda x: (x[0], x[1].start, x[1].n))
    starts = _starts(held, {f.name: f.length for f in files})
    bodies = blocks.select("file", "start", "n", "size", "body")
    outline = {(o.file, o.start, o.n): o for o in bodies.mapInArrow(_outline(starts, field), OUTLINE).collect()}

    inside, number, home, rests, places, arrays = False, 0, None, {}, {}, Counter()
    for name, b in held:
        key = (b.file, b.start, b.n)
        o = outline[key]
        arrays[name] += o.opens
        if arrays[name] > 1:
            raise BrokenDocument(f"{name} has more than one array {field}")
        places[key] = (inside, number)
        if inside:
            rests.setdefault(home, []).append(bytes(o.head))
            number += o.commas + o.closed
            home = key if o.commas else home
            inside = not o.closed
        number += o.within
        if o.since is not None:
            inside, number, home = True, number + o.since, key
    known = {key: (*starts[key], *place, b"".join(rests.get(key, []))) for key, place in places.items()}
    return bodies.mapInArrow(_elements(known, field), "idx bigint, value binary").select("idx", F.col("value").cast("string").alias("value"))
