"""Field projection of messages: nested paths, existence-only fields.

A projection keeps, of each message, the fields that its paths name: a full path keeps the whole
subtree, an existence-only one the field's presence (its tag and the zero of its wire type), and
an inner element of a path keeps the frame of its submessage or group, with what is named inside.
Rows never vanish; what is no message passes as it is.  Of two entries for a path the more
inclusive wins, in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwell.functions import varint as V
from chunkwell.functions.messages import Field as Event
from chunkwell.functions.messages import fields_of, is_message, parse, spans_of

#: Of a path element, most inclusive first.
FULL, CHILD, EXISTENCE = 0, 1, 2
#: Open submessages and groups below which a value is not looked into.
MAX_DEPTH = 100


@dataclass(frozen=True)
class Field:
    """A path of field numbers; ``existence_only`` keeps only the presence of its end."""

    path: tuple[int, ...]
    existence_only: bool = False


class Projection:
    """A set of paths; ``Projection.all()`` keeps everything."""

    def __init__(self, *fields: Field):
        self.fields: list[Field] = []
        self._all = False
        for f in fields:
            self.add(f)

    @staticmethod
    def all() -> Projection:
        p = Projection()
        p._all = True
        return p

    @staticmethod
    def parse(text: str) -> Projection:
        """From ``1;2.3;4?`` (``?``: existence only); an empty text keeps nothing but the rows."""
        p = Projection()
        for part in filter(None, (x.strip() for x in text.split(";"))):
            p.add(Field(tuple(int(n) for n in part.rstrip("?").split(".") if n), part.endswith("?")))
        return p

    def add(self, f: Field) -> Projection:
        self.fields.append(f)
        return self

    @property
    def is_all(self) -> bool:
        return self._all or any(not f.path and not f.existence_only for f in self.fields)

    @property
    def has_full_include(self) -> bool:
        return any(not f.existence_only for f in self.fields)

    def mentions(self, number: int) -> bool:
        return any(number in f.path for f in self.fields)

    def tree(self) -> dict:
        """{number: (inclusion, subtree)}."""
        root: dict = {}
        for f in self.fields:
            at = root
            for depth, n in enumerate(f.path):
                last = depth == len(f.path) - 1
                kind = (EXISTENCE if f.existence_only else FULL) if last else CHILD
                old, below = at.get(n, (kind, {}))
                at[n] = (min(old, kind), below)
                at = below
        return root

    def apply(self, record: bytes) -> bytes:
        """The projected record; one that is no message is returned unchanged."""
        if self.is_all or not is_message(record):
            return record
        return _project(record, self.tree(), 0)

    def apply_array(self, records: pa.Array) -> pa.Array:
        """The projected records of a batch; top-level projections of scalar fields never leave NumPy."""
        if self.is_all:
            return records
        tree = self.tree()
        if all(len(f.path) == 1 for f in self.fields):
            return _top_level(records, tree)
        return pa.array([None if r is None else _project(r, tree, 0) if is_message(r) else r for r in records.to_pylist()], records.type)


def _top_level(records: pa.Array, tree: dict) -> pa.Array:
    """:func:`_project` of a batch by a tree without subtrees."""
    from chunkwell.sources.simple import binary_array

    e = parse(records)
    buf, begin, end = spans_of(records)
    # a field ends where the next one of its record begins; groups stay with the slow path
    grouped = np.zeros(len(begin), dtype=bool)
    grouped[e.record[(e.wire == V.START_GROUP) | (e.depth > 0)]] = True
    stop = np.where(e.wire == V.BYTES, e.start + e.size, e.start)
    fixed = np.where(e.wire == V.FIXED32, 4, np.where(e.wire == V.FIXED64, 8, 0))
    stop = stop + fixed
    plain = e.wire == V.VARINT
    stop[plain] += _varint_sizes(e.value[plain])
    first = np.concatenate([[True], e.record[1:] != e.record[:-1]]) if len(e.record) else np.empty(0, dtype=bool)
    start = np.where(first, begin[e.record], np.concatenate([[0], stop[:-1]])) if len(e.record) else stop
    keep = np.isin(e.number, list(tree)) & ~grouped[e.record]
    rows, a, z, number, wire = e.record[keep], start[keep], stop[keep], e.number[keep], e.wire[keep]
    key = a.copy()
    for n in (n for n, (kind, _) in tree.items() if kind == EXISTENCE):
        for w in (V.VARINT, V.FIXED32, V.FIXED64, V.BYTES):
            zero = np.frombuffer(_zero_of(n, w), dtype=np.uint8)
            hit = (number == n) & (wire == w)
            a[hit], z[hit], buf = len(buf), len(buf) + len(zero), np.concatenate([buf, zero])
    whole = np.flatnonzero(~e.ok)  # what is no message passes
    rows, a, z, key = np.concatenate([rows, whole]), np.concatenate([a, begin[whole]]), np.concatenate([z, end[whole]]), np.concatenate([key, begin[whole]])
    order = np.lexsort((key, rows))
    rows, a, size = rows[order], a[order], (z - a)[order]
    total = np.bincount(rows, weights=size, minlength=len(begin)).astype(np.int64) if len(rows) else np.zeros(len(begin), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(total)])
    at = np.concatenate([[0], np.cumsum(size)])
    out = binary_array(offsets, buf[np.repeat(a - at[:-1], size) + np.arange(at[-1])].tobytes())
    if grouped.any() or records.null_count:
        slow = {int(i): _project(records[int(i)].as_py(), tree, 0) for i in np.flatnonzero(grouped & e.ok)}
        out = pa.array([None if not r.is_valid else slow.get(i, v) for i, (v, r) in enumerate(zip(out.to_pylist(), records, strict=True))], pa.binary())
    return out


def _varint_sizes(v: np.ndarray) -> np.ndarray:
    """Bytes of each varint, read off ``start`` being the position of the value itself."""
    size = np.ones(len(v), dtype=np.int64)
    for i in range(1, 10):
        size += v >= np.uint64(1 << (7 * i))
    return size


def _zero_of(number: int, wire: int) -> bytes:
    """A present field without content."""
    head = V.encode_u64(V.make_tag(number, wire))
    if wire in (V.VARINT, V.BYTES):
        return head + b"\0"
    if wire == V.START_GROUP:
        return head + V.encode_u64(V.make_tag(number, V.END_GROUP))
    return head + bytes(4 if wire == V.FIXED32 else 8)


def _project(data: bytes, tree: dict, depth: int) -> bytes:
    events, out, i = list(fields_of(data)), [], 0
    while i < len(events):
        i = _one(data, events, i, tree, depth, out)
    return b"".join(out)


def _group_end(events: list[Event], i: int) -> int:
    """Index of the event that ends the group begun at ``i``."""
    level = 0
    for k in range(i, len(events)):
        level += (events[k].wire == V.START_GROUP) - (events[k].wire == V.END_GROUP)
        if level == 0:
            return k
    raise ValueError("unterminated group")


def _one(data: bytes, events: list[Event], i: int, tree: dict, depth: int, out: list[bytes]) -> int:
    """Project the field at ``i`` into ``out``; the index behind it."""
    e = events[i]
    last = _group_end(events, i) if e.wire == V.START_GROUP else i
    kind, below = tree.get(e.number, (None, {}))
    if kind is None:
        return last + 1
    if kind == FULL:
        out.append(data[e.begin : events[last].end])
        return last + 1
    if e.wire == V.START_GROUP:
        if kind == EXISTENCE and not below:
            out.append(_zero_of(e.number, e.wire))
        else:
            out.append(data[e.begin : e.end])
            k = i + 1
            while k < last:
                k = _one(data, events, k, below, depth + 1, out)
            out.append(data[events[last].begin : events[last].end])
        return last + 1
    submessage = e.wire == V.BYTES and len(e.value) and depth < MAX_DEPTH and is_message(e.value)
    if kind == EXISTENCE and not (submessage and below):
        out.append(_zero_of(e.number, e.wire))
    elif submessage:
        inner = _project(e.value, below, depth + 1)
        out.append(V.encode_u64(V.make_tag(e.number, V.BYTES)) + V.encode_u64(len(inner)) + inner)
    else:  # an inner path element that is a leaf in this record stays whole
        out.append(data[e.begin : e.end])
    return last + 1


def project(record: Column, projection: Projection) -> Column:
    """The projected ``record``, a binary column."""

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        return projection.apply_array(v)

    return run(record)
