"""Document fingerprints from prefix polynomial hashes.

An array of prefix hashes over code points (polynomials modulo the prime 2**61 - 1)
gives the hash of any span as a difference of two entries.  Spans of ``SPAN`` code
points fill the bins of a sketch; likeness is the share of equal bins.  The same arrays
answer whether two spans are equal, and, by binary search, how far two texts agree from
given places.  Unequal spans have equal hashes with a chance of their length in 2**61;
``equal`` and ``common_extension`` compare the code points themselves at last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Code points of a sketched span, and bins of a sketch (a byte each).
SPAN, BINS = 8, 128
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


_P = np.uint64((1 << 61) - 1)
#: The base of the polynomials, and its inverse modulo the prime.
_BASE = 0x1D3F5A7C9B2E4861 % ((1 << 61) - 1)
_BASE_INV = pow(_BASE, -1, (1 << 61) - 1)
_LOW30, _LOW31, _LOW32 = (np.uint64((1 << k) - 1) for k in (30, 31, 32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for a and b below it."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + al * bl)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, length: int) -> np.ndarray:
    """base**0 .. base**(length - 1) modulo 2**61 - 1, from one table for each base that doubles as needed."""
    table = _POWERS.get(base)
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < length:
        table = np.concatenate([table, product(table, np.full(1, pow(base, len(table), int(_P)), np.uint64))])
    _POWERS[base] = table
    return table[:length]


class Prefixes:
    """Prefix hashes of texts laid one after another; ``begin`` are their places (one more: the end)."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.begin[1:])
        n = len(self.points)
        terms = product(self.points.astype(np.uint64) + np.uint64(1), powers(_BASE, n))
        # a running sum modulo the prime, from those of the terms' halves
        high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & _LOW32)
        high = _reduced(high)
        self.prefix = np.zeros(n + 1, np.uint64)
        self.prefix[1:] = _reduced(((high << np.uint64(32)) & _P) + (high >> np.uint64(29)) + low)
        self.back = powers(_BASE_INV, n + 1)

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of spans; equal spans (of one length) have equal hashes."""
        between = self.prefix[start + length] + _P - self.prefix[start]
        return C.mix(product(_reduced(between), self.back[start]))

    def _agree(self, a: int, b: int, n: int) -> int:
        differs = np.flatnonzero(self.points[a : a + n] != self.points[b : b + n])
        return int(differs[0]) if len(differs) else n

    def equal(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether spans at a and b of a length are equal."""
        a, b, length = np.broadcast_arrays(a, b, length)
        out = self.spans(a, length) == self.spans(b, length)
        for k in np.flatnonzero(out & (a != b)).tolist():
            out[k] = self._agree(int(a[k]), int(b[k]), int(length[k])) == length[k]
        return out

    def common_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many code points from a and from b agree, at most ``most`` each, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while np.any(low < high):
            middle = (low + high + 1) >> 1
            same = self.spans(a, middle) == self.spans(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return np.array([self._agree(i, j, n) for i, j, n in zip(a.tolist(), b.tolist(), low.tolist(), strict=True)], np.int64)

    def sketches(self) -> np.ndarray:
        """A row of BINS bytes for each text, and a last column that is 0 for an empty text."""
        n, size = len(self.begin) - 1, np.diff(self.begin)
        count = np.where(size >= SPAN, size - SPAN + 1, 0)
        row = np.repeat(np.arange(n), count)
        hashes = self.spans(C.ranges(self.begin[:-1], count), SPAN)
        short = np.flatnonzero((size > 0) & (size < SPAN))
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, self.spans(self.begin[:-1][short], size[short])])
        least = np.full(n * BINS, _NONE, np.uint64)
        np.minimum.at(least, row * BINS + (hashes >> np.uint64(57)).astype(np.int64), hashes)
        least = least.reshape(n, BINS)
        empty = least == _NONE
        for shift in (1, 3, 9, 27, 17, 40, 61, 5):  # empty bins borrow, in a fixed order
            least = np.where(empty, np.roll(least, shift, 1) ^ np.uint64(shift), least)
            now = np.roll(empty, shift, 1) & empty
            least[now] = _NONE
            empty = now
        for step in range(1, BINS):
            if not empty[size > 0].any():
                break
            least = np.where(empty, np.roll(least, 1, 1), least)
            empty = empty & np.roll(empty, 1, 1)
        out = np.zeros((n, BINS + 1), np.uint8)
        out[:, :BINS] = (C.mix(least) & np.uint64(0xFF)).astype(np.uint8)
        out[:, BINS] = size > 0
        return out


def likeness(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Twice the shared spans over all spans of both, estimated from sketches; 1 for equal texts."""
    share = np.clip(((a[:, :BINS] == b[:, :BINS]).mean(1) - 1 / 256) * 256 / 255, 0, 1)
    share = np.where((a[:, BINS] > 0) & (b[:, BINS] > 0), 2 * share / (1 + share), 0.0)
    return np.where(equal, 1.0, share)


def _texts(rows: list[str], after: list[str]) -> list[str]:
    """Each text with its last quarter replaced by the beginning of the one after."""
    out = []
    for t, u in zip(rows, after, strict=True):
        q = len(t) // 4
        out.append(t[: len(t) - q] + u[:q])
    return out


def _prints(p: Prefixes, sketch: np.ndarray) -> list[str]:
    whole = p.spans(p.begin[:-1], np.diff(p.begin))
    return [f"{n:x}.{h:016x}.{s.tobytes().hex()}" for n, h, s in zip(np.diff(p.begin).tolist(), whole.tolist(), sketch[:, :BINS], strict=True)]


def _compare(ids, rows, after):
    edited = _texts(rows, after)
    own = Prefixes(rows + edited)
    n = len(rows)
    sketch = own.sketches()
    nxt = Prefixes(after)
    prints = _prints(own, sketch)
    same = np.array([a == b for a, b in zip(rows, edited, strict=True)])
    same_next = np.array([a == b for a, b in zip(rows, after, strict=True)])
    size = np.diff(own.begin)
    agree = own.common_extension(own.begin[:n], own.begin[n : 2 * n], np.minimum(size[:n], size[n:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(size[:n], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(prints[:n]),
            pa.array(prints[n:]),
            pa.array(likeness(sketch[:n], sketch[n:], same)),
            pa.array(likeness(sketch[:n], nxt.sketches(), same_next)),
            pa.array(agree, pa.int64()),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"],
    )


def _parts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, ids.astype(np.float64), "right").astype(np.int32)


def _least(bounds: np.ndarray):
    """Ids to the least of each part in a batch: (part, id)."""

    def run(batches):
        for batch in batches:
            ids = np.unique(batch.column(0).to_numpy())
            part, at = np.unique(_parts(ids, bounds), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ids[at])], names=["part", "id"])

    return run


def _deal(bounds: np.ndarray, guests: dict[int, int]):
    """(id, tkey, text) to (part, guest, id, tkey, text); the first row of a part is also the last, as a guest, of the part before."""
    first = np.array(sorted(guests), np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            also = np.flatnonzero(np.isin(ids, first))
            yield pa.RecordBatch.from_arrays([pa.array(_parts(ids, bounds)), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], names=["part", "guest", "id", "tkey", "text"])
            if len(also):
                again = batch.take(pa.array(also))
                to = np.array([guests[i] for i in ids[also].tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), np.int32)), *again.columns], names=["part", "guest", "id", "tkey", "text"])

    return run


def _stream(batches):
    """Rows sorted by (part, guest, id, tkey): part, guest, id, text.  A part's last row is the first of the next part."""
    held = None
    ids, rows, after, size = [], [], [], 0
    for batch in batches:
        for part, guest, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held is not None and held[0] == part:
                ids.append(held[1])
                rows.append(held[2])
                after.append(text)
                size += len(held[2])
            held = None if guest else (part, i, text)
            if size > C.CHUNK_BYTES // 2:
                yield _compare(ids, rows, after)
                ids, rows, after, size = [], [], [], 0
    if ids:
        yield _compare(ids, rows, after)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_start.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by
    as many (or all) of the first ones of the next document by id; after the last comes
    the first, and a single document is its own next.  common_start is how many code
    points the text and the edited text share from their start.  Null texts are empty;
    an empty text is like an equal one (1) and unlike any other (0).  Rows with a null
    id are left out; rows of one id follow one another by a hash of their text.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    parts = 4 * C.slots(spark)
    # ranges of ids and what each of them begins with: a few numbers for each partition
    bounds = np.unique(np.array(whole.approxQuantile("id", [k / parts for k in range(1, parts)], 0.25 / parts) or [], np.float64))
    own = whole.select("id").mapInArrow(_least(bounds), "part int, id long").groupBy("part").agg(F.min("id").alias("id")).collect()
    firsts = sorted((r["part"], r["id"]) for r in own)
    guests = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}
    dealt = whole.select("id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(_deal(bounds, guests), "part int, guest int, id long, tkey long, text string")
    ordered = dealt.repartition(C.slots(spark), "part").sortWithinPartitions("part", "guest", "id", "tkey").select("part", "guest", "id", "text")
    kind = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"
    return ordered.mapInArrow(_stream, kind).withColumnRenamed("id", id_col)
