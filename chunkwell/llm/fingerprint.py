"""Operator 5: document fingerprints by prefix polynomial hashes.

For code points ``c_0 .. c_{n-1}`` and each of two 31-bit primes ``p`` with base ``b``, the prefix
array holds ``P[k] = sum_{i<k} (c_i + 1) b^i mod p``.  Spans ``a[i:i+L]`` and ``c[j:j+L]`` are equal
(but for a collision, about 2^-62 a comparison) iff
``(Pa[i+L] - Pa[i]) b^j = (Pc[j+L] - Pc[j]) b^i``, for any spans, in constant time; so the longest
common extension of two places is found by binary search.  A text made of parts needs no array
of its own: its prefix values follow from those of the parts.

The fingerprint of a text is its pair of prefix arrays; the result names it by the length and both hashes
of the whole text.  The likeness of two fingerprints is the share of the longer text that lies in common
spans in the same order, found by longest common extensions alone: one from the start, one
from the end, and between them from every anchor that both have.  An anchor is a place whose span of
``SPAN`` code points has a hash divisible by ``EVERY``, also read off the prefix arrays; those that
stand once in either text are put into their longest common order.  So an edit costs its own length,
and besides at most the text up to the next edit if no anchor stands between them.  Equal texts
have likeness 1, texts without a common span 0, and two empty texts 1.

To meet its successor, every text is dealt once into ranges of ``doc_id`` and sorted there; a
range's last document gets its successor from a small table of the ranges' first documents.

Cases: a null text counts as empty.  Null ids come last.  Rows with the same ``doc_id`` follow one
another by a hash of their text; rows equal in both are interchangeable.  A lone document is its
own successor.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm.common import slices, store

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_093, 1_500_450_271)
#: Length of an anchor's span, and how many places there are to an anchor on average.
SPAN = 20
EVERY = 8
INVERSES = tuple(pow(b, -1, p) for p, b in zip(PRIMES, BASES, strict=True))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64) for _ in PRIMES]
_INVERSE_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def _grown(tables: list[np.ndarray], bases: tuple, n: int) -> list[np.ndarray]:
    for m, (p, b) in enumerate(zip(PRIMES, bases, strict=True)):
        t = tables[m]
        while len(t) <= n:
            step = np.uint64(pow(b, len(t), p))
            t = np.concatenate([t, t * step % np.uint64(p)])
        tables[m] = t
    return tables


def powers(n: int) -> list[np.ndarray]:
    """``b^0 .. b^n`` at least, for each prime; the tables grow by doubling and are kept."""
    return _grown(_POWERS, BASES, n)


class Prefix:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = n = len(codes)
        self.arrays = []
        for p, t in zip(PRIMES, powers(n), strict=True):
            a = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(codes * t[:n] % np.uint64(p), out=a[1:])  # sums stay under 2^64 up to 2^33 code points
            a %= np.uint64(p)
            self.arrays.append(a)

    def at(self, k: int) -> tuple[int, int]:
        return int(self.arrays[0][k]), int(self.arrays[1][k])

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and 62-bit hashes of the anchors."""
        if self.n < SPAN:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at, out = np.arange(self.n - SPAN + 1), None
        for a, p, back in zip(self.arrays, PRIMES, _grown(_INVERSE_POWERS, INVERSES, self.n), strict=True):
            h = (a[at + SPAN] + np.uint64(p) - a[at]) % np.uint64(p) * back[at] % np.uint64(p)
            if out is None:
                chosen = h % np.uint64(EVERY) == 0
                at, out = at[chosen], h[chosen]
            else:
                out = out << np.uint64(31) | h
        return at, out

    @property
    def digest(self) -> str:
        return digest(self)


class Joined:
    """Prefix values of the first ``head`` code points of one text and the first ``tail`` of another."""

    def __init__(self, first: Prefix, head: int, second: Prefix, tail: int):
        self.first, self.head, self.second, self.n = first, head, second, head + tail
        t = powers(self.n)
        self._base = first.at(head)
        self._shift = [int(x[head]) for x in t]

    def at(self, k: int) -> tuple[int, int]:
        if k <= self.head:
            return self.first.at(k)
        s = self.second.at(k - self.head)
        return tuple((self._base[m] + self._shift[m] * s[m]) % PRIMES[m] for m in (0, 1))

    @property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Those of the parts; the few that lie across the joint are left out."""
        (at, h), (more, g) = self.first.anchors, self.second.anchors
        k, m = np.searchsorted(at, self.head - SPAN, side="right"), np.searchsorted(more, self.n - self.head - SPAN, side="right")
        return np.concatenate([at[:k], more[:m] + self.head]), np.concatenate([h[:k], g[:m]])

    @property
    def digest(self) -> str:
        return digest(self)


def digest(a) -> str:
    """The fingerprint as a string: length and both hashes of the whole text, in hex."""
    h = a.at(a.n)
    return f"{a.n:x}-{h[0]:08x}{h[1]:08x}"


def equal_spans(a, i: int, c, j: int, size: int) -> bool:
    """Whether ``size`` code points from ``i`` in ``a`` equal those from ``j`` in ``c``."""
    t = powers(max(i, j))
    a0, a1, c0, c1 = a.at(i), a.at(i + size), c.at(j), c.at(j + size)
    return all((a1[m] - a0[m]) * int(t[m][j]) % PRIMES[m] == (c1[m] - c0[m]) * int(t[m][i]) % PRIMES[m] for m in (0, 1))


def extension(a, i: int, c, j: int, most: int | None = None) -> int:
    """The longest common extension to the right of ``i`` in ``a`` and ``j`` in ``c``, ``most`` at most."""
    lo, hi = 0, min(a.n - i, c.n - j) if most is None else most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal_spans(a, i, c, j, mid) else (lo, mid - 1)
    return lo


def extension_left(a, i: int, c, j: int, most: int) -> int:
    """The longest common extension to the left of ``i`` in ``a`` and ``j`` in ``c``, ``most`` at most."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal_spans(a, i - mid, c, j - mid, mid) else (lo, mid - 1)
    return lo


def _once(anchors, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and places of the anchors within ``start .. end`` that stand there once."""
    at, h = anchors
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end - SPAN, side="right")
    found, first, n = np.unique(h[lo:hi], return_index=True, return_counts=True)
    return found[n == 1], at[lo:hi][first[n == 1]]


def _in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    ends: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for k, x in enumerate(places):
        n = bisect_left(tops, x)
        before.append(ends[n - 1] if n else -1)
        ends[n : n + 1], tops[n : n + 1] = [k], [x]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def common_spans(a, c) -> list[tuple[int, int, int]]:
    """(place in ``a``, place in ``c``, length) of common spans, in order and apart in both."""
    prefix = extension(a, 0, c, 0)
    spans = [(0, 0, prefix)] if prefix else []
    if prefix == min(a.n, c.n):
        return spans
    suffix = extension_left(a, a.n, c, c.n, min(a.n, c.n) - prefix)
    a_end, c_end = a.n - suffix, c.n - suffix
    (h, at), (g, other) = _once(a.anchors, prefix, a_end), _once(c.anchors, prefix, c_end)
    _, k, m = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    order = np.argsort(at[k])
    left, right = at[k][order].tolist(), other[m][order].tolist()
    i = j = prefix
    for n in _in_order(right):
        x, y = left[n], right[n]
        if x < i or y < j:
            continue
        size = extension(a, x, c, y, min(a_end - x, c_end - y))
        back = extension_left(a, x, c, y, min(x - i, y - j))
        if size:
            spans.append((x - back, y - back, back + size))
            i, j = x + size, y + size
    return [*spans, (a_end, c_end, suffix)] if suffix else spans


def likeness(a, c) -> float:
    if a.n == c.n and a.at(a.n) == c.at(c.n):
        return 1.0
    return sum(n for _, _, n in common_spans(a, c)) / max(a.n, c.n)


def compare(text: str, own: Prefix, following: str, other: Prefix) -> tuple:
    """``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of one document."""
    half = own.n // 2
    tail = min(half, other.n)
    edited = Joined(own, own.n - half, other, tail)
    sha = hashlib.sha256((text[: own.n - half] + following[:tail]).encode("utf-8", "surrogatepass")).hexdigest()
    return own.n, sha, own.digest, edited.digest, likeness(own, edited), likeness(own, other)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT, _HEAD, _LAST = 0, 1, 2


def _batch(rows):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["kind", "part", "text", *(f.split()[0] for f in _FIELDS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _walk(batches):
    """Results for all but the last document of a sorted range; its first and last as they are."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            ids, texts, rows = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), []
            for i, t in zip(ids, texts, strict=True):
                t = t or ""
                p = Prefix(t)
                if last is None:
                    rows.append((_HEAD, part, t, i, *[None] * 6))
                else:
                    rows.append((_RESULT, part, None, last[0], *compare(last[1], last[2], t, p)))
                last = (i, t, p)
            yield _batch(rows)
    if last is not None:
        yield _batch([(_LAST, part, last[1], last[0], *[None] * 6)])


def _finish(batches):
    import pyarrow as pa

    for batch in batches:
        for i, t, following in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            row = (i, *compare(t, Prefix(t), following, Prefix(following)))
            yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _FIELDS.split(", ")], row, strict=True))], schema=_schema())


def _schema():
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _FIELDS.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fields of the contract for every row of ``docs``."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "m"]
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked, _ = store(ranges.mapInArrow(_walk, f"kind int, part int, text string, {_FIELDS}"), "fingerprint")
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    heads = walked.where(F.col("kind") == _HEAD).select("part", "text")
    # one small row for each range: the next range that is not empty, after the last one the first
    by = Window.orderBy("part")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = heads.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(by), F.first("part").over(every)).alias("after"))
    last = walked.where(F.col("kind") == _LAST).select("doc_id", "part", F.col("text").alias("own"))
    pairs = last.join(turn, last["part"] == turn["before"]).select("doc_id", "own", "after").join(heads.withColumnRenamed("text", "following"), F.col("after") == F.col("part"))
    done = pairs.select("doc_id", "own", "following").mapInArrow(_finish, _FIELDS)
    return walked.where(F.col("kind") == _RESULT).select(*names).unionByName(done)
