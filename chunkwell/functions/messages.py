"""Protobuf-wire messages: parsing and building, whole batches at a time.

A batch of records is parsed in lock step: step *k* reads the *k*-th field of every record that
has one.  Records with groups, and those that turn out not to be messages, go through the scalar
parser, which keeps a stack of open groups.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from chunkwell.functions import varint as V
from chunkwell.functions.errors import MessageError

MAX_NUMBER = (1 << 29) - 1


@dataclass(frozen=True)
class Field:
    """One field event; ``value`` is a number, bytes, or None for the ends of a group."""

    number: int
    wire: int
    value: int | bytes | None
    begin: int
    end: int


def fields_of(data: bytes, canonical: bool = True) -> Iterator[Field]:
    """Field events in order, groups flat; MessageError where the message breaks off.

    ``canonical`` rejects overlong varints, as the strict reading of a message does.
    """
    at, n = 0, len(data)

    def number(bits: int) -> int:
        nonlocal at
        if canonical:
            got = V.decode_canonical(data, at, bits)
            if got is None:
                raise MessageError(f"no canonical varint at byte {at}")
            value, at = got
            return value
        try:
            value, at = V.decode_u64(data, at, bits)
        except Exception as e:
            raise MessageError(str(e)) from e
        return value

    while at < n:
        begin = at
        tag = number(32)
        num, wire = tag >> 3, tag & 7
        if num == 0 or wire > 5:
            raise MessageError(f"invalid tag at byte {begin}")
        value: int | bytes | None = None
        if wire == V.VARINT:
            value = number(64)
        elif wire in (V.FIXED32, V.FIXED64):
            size = 4 if wire == V.FIXED32 else 8
            if at + size > n:
                raise MessageError("truncated fixed field")
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif wire == V.BYTES:
            size = number(32)
            if at + size > n:
                raise MessageError("truncated length-delimited field")
            value, at = bytes(data[at : at + size]), at + size
        yield Field(num, wire, value, begin, at)


def is_message(data: bytes, canonical: bool = True) -> bool:
    """Whether ``data`` is a well-formed message with balanced groups; the empty record is one."""
    open_groups: list[int] = []
    try:
        for f in fields_of(data, canonical):
            if f.wire == V.START_GROUP:
                open_groups.append(f.number)
            elif f.wire == V.END_GROUP and (not open_groups or open_groups.pop() != f.number):
                return False
    except MessageError:
        return False
    return not open_groups


def serialize_field(f: Field) -> bytes:
    """Inverse of :func:`fields_of` for one event."""
    head = V.encode_u64(V.make_tag(f.number, f.wire))
    if f.wire == V.VARINT:
        return head + V.encode_u64(f.value)
    if f.wire in (V.FIXED32, V.FIXED64):
        return head + f.value.to_bytes(4 if f.wire == V.FIXED32 else 8, "little")
    if f.wire == V.BYTES:
        return head + V.encode_u64(len(f.value)) + f.value
    return head


def top_level(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of each top-level field; a group is one field."""
    open_groups: list[int] = []
    start = 0
    for f in fields_of(data):
        if f.wire == V.START_GROUP:
            if not open_groups:
                start = f.begin
            open_groups.append(f.number)
        elif f.wire == V.END_GROUP:
            if not open_groups or open_groups.pop() != f.number:
                raise MessageError(f"unexpected end of group {f.number}")
            if not open_groups:
                yield f.number, start, f.end
        elif not open_groups:
            yield f.number, f.begin, f.end
    if open_groups:
        raise MessageError("unterminated group")


def copy_fields(data: bytes, numbers) -> bytes:
    """The top-level fields with ``numbers``, as they stand and in order."""
    return b"".join(data[a:b] for n, a, b in top_level(data) if n in numbers)


@dataclass
class Events:
    """Fields of a batch, by record and then in order; ``start``/``size`` locate the bytes of length-delimited ones."""

    record: np.ndarray
    number: np.ndarray
    wire: np.ndarray
    value: np.ndarray
    start: np.ndarray
    size: np.ndarray
    depth: np.ndarray
    ok: np.ndarray
    data: np.ndarray

    def where(self, at: np.ndarray) -> Events:
        return Events(*(getattr(self, k)[at] for k in ("record", "number", "wire", "value", "start", "size", "depth")), self.ok, self.data)


def spans_of(records: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with room to spare, begin, end) of a binary array; a null counts as empty."""
    kind = np.int64 if pa.types.is_large_binary(records.type) else np.int32
    offsets = np.frombuffer(records.buffers()[1], dtype=kind)[records.offset : records.offset + len(records) + 1].astype(np.int64) if len(records) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(records.buffers()[2] or b"", dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])]
    buf = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
    return buf, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _gather(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(buf[at[:, None] + np.arange(size)]).view(f"<u{size}").ravel().astype(np.uint64)


def parse_spans(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Events:
    """Field events of the records at ``[begin, end)`` in ``buf`` (which has 10 bytes to spare)."""
    n = len(begin)
    ok, grouped = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    live, pos = np.flatnonzero(begin < end), begin[begin < end].copy()
    steps = []
    while len(live):
        stop = end[live]
        tag, pos, good = V.read_many(buf, pos, stop, 32)
        number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int8)
        good &= (number > 0) & (wire <= 5) & (pos <= stop)
        group = (wire == V.START_GROUP) | (wire == V.END_GROUP)
        grouped[live[good & group]] = True
        value = np.zeros(len(live), dtype=np.uint64)
        start, size = pos.copy(), np.zeros(len(live), dtype=np.int64)
        at = np.flatnonzero(good & (wire == V.VARINT))
        if len(at):
            value[at], pos[at], fine = V.read_many(buf, pos[at], stop[at])
            good[at] &= fine & (pos[at] <= stop[at])
        for w, width in ((V.FIXED32, 4), (V.FIXED64, 8)):
            at = np.flatnonzero(good & (wire == w))
            if len(at):
                fits = pos[at] + width <= stop[at]
                good[at] &= fits
                value[at[fits]] = _gather(buf, pos[at[fits]], width)
                pos[at] += width
        at = np.flatnonzero(good & (wire == V.BYTES))
        if len(at):
            length, after, fine = V.read_many(buf, pos[at], stop[at], 32)
            size[at], start[at], pos[at] = length.astype(np.int64), after, after + length.astype(np.int64)
            good[at] &= fine & (pos[at] <= stop[at])
        ok[live[~good]] = False
        keep = good & ~group
        steps.append((live[keep], number[keep], wire[keep], value[keep], start[keep], size[keep]))
        on = keep & (pos < stop)
        live, pos = live[on], pos[on]
    slow = np.flatnonzero(grouped)
    if steps:
        record, number, wire, value, start, size = (np.concatenate(c) for c in zip(*steps, strict=True))
        order = np.argsort(record, kind="stable")
        found = [x[order] for x in (record, number, wire, value, start, size)]
        keep = ok[found[0]] & ~grouped[found[0]]
        found = [x[keep] for x in found]
    else:
        found = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int8, np.uint64, np.int64, np.int64)]
    found.append(np.zeros(len(found[0]), dtype=np.int32))
    if len(slow):
        rows = []
        for r in slow.tolist():
            raw = buf[begin[r] : end[r]].tobytes()
            ok[r] = is_message(raw)
            depth = 0
            for f in fields_of(raw) if ok[r] else ():
                depth -= f.wire == V.END_GROUP
                rows.append((r, f.number, f.wire, f.value if isinstance(f.value, int) else 0, int(begin[r]) + f.end - len(f.value or b"") if f.wire == V.BYTES else 0, len(f.value) if f.wire == V.BYTES else 0, depth))
                depth += f.wire == V.START_GROUP
        if rows:
            extra = [np.array(c, dtype=x.dtype) for c, x in zip(zip(*rows, strict=True), found, strict=True)]
            found = [np.concatenate([a, b]) for a, b in zip(found, extra, strict=True)]
            order = np.argsort(found[0], kind="stable")
            found = [x[order] for x in found]
    return Events(*found, ok, buf)


def parse(records: pa.Array) -> Events:
    return parse_spans(*spans_of(records))


def slices_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of the given spans end to end."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return offsets, data[index].tobytes()


# Specifications of typed views.

#: Kinds of a field and the Spark type of each.
KINDS = {
    "uint64": "bigint", "uint32": "bigint", "int64": "bigint", "int32": "int", "sint64": "bigint", "sint32": "int", "bool": "boolean",
    "fixed32": "bigint", "fixed64": "bigint", "sfixed32": "int", "sfixed64": "bigint", "float": "float", "double": "double", "bytes": "binary", "string": "string",
}
_WIRES = dict.fromkeys(("uint64", "uint32", "int64", "int32", "sint64", "sint32", "bool"), V.VARINT) | dict.fromkeys(("fixed32", "sfixed32", "float"), V.FIXED32) | dict.fromkeys(("fixed64", "sfixed64", "double"), V.FIXED64) | dict.fromkeys(("bytes", "string"), V.BYTES)


@dataclass(frozen=True)
class Spec:
    """A field of a typed view: its name, number, and kind or the specs of a submessage.

    ``group`` makes a submessage a group; ``repeated`` makes the column an array.
    """

    name: str
    number: int
    kind: str | tuple = "bytes"
    repeated: bool = False
    group: bool = False

    @property
    def ddl(self) -> str:
        inner = KINDS[self.kind] if isinstance(self.kind, str) else "struct<" + ",".join(f"{s.name}:{s.ddl}" for s in self.kind) + ">"
        return f"array<{inner}>" if self.repeated else inner

    @property
    def arrow(self) -> pa.DataType:
        if isinstance(self.kind, str):
            inner = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}[KINDS[self.kind]]
        else:
            inner = pa.struct([(s.name, s.arrow) for s in self.kind])
        return pa.list_(inner) if self.repeated else inner


# Building.


def _lengths(n: int) -> np.ndarray:
    return np.zeros(n, dtype=np.int64)


class Pieces:
    """Byte strings for some of ``n`` records, as (records, offsets, bytes)."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, data: np.ndarray):
        self.rows, self.size, self.data = rows, size, data


def _scalar_pieces(spec: Spec, rows: np.ndarray, values: pa.Array) -> Pieces:
    tag = np.frombuffer(V.encode_u64(V.make_tag(spec.number, _WIRES[spec.kind])), dtype=np.uint8)
    wire, kind = _WIRES[spec.kind], spec.kind
    if wire == V.BYTES:
        raw = values.cast(pa.binary()) if kind == "string" else values
        buf, begin, end = spans_of(raw)
        size = end - begin
        head, width = V.encode_many(size)
        total = len(tag) + width + size
        out, at = np.zeros(int(total.sum()), dtype=np.uint8), (np.cumsum(total) - total).astype(np.int64)
        for j, b in enumerate(tag):
            out[at + j] = b
        at = at + len(tag)
        for j in range(int(width.max()) if len(width) else 0):
            has = width > j
            out[at[has] + j] = head[has, j]
        at = at + width
        offsets = np.concatenate([[0], np.cumsum(size)])
        out[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])] = buf[: offsets[-1]]
        return Pieces(rows, total, out)
    if wire == V.VARINT:
        v = values.cast(pa.int64()).to_numpy(zero_copy_only=False) if kind != "bool" else values.cast(pa.uint8()).to_numpy(zero_copy_only=False).astype(np.int64)
        if kind.startswith("sint"):
            v = (v << 1) ^ (v >> 63)
        if kind == "uint32":
            v = v & 0xFFFFFFFF
        body, width = V.encode_many(v.astype(np.int64).view(np.uint64))
        full = np.concatenate([np.broadcast_to(tag, (len(v), len(tag))), body], axis=1)
        total = width + len(tag)
        return Pieces(rows, total, full[np.arange(full.shape[1])[None, :] < total[:, None]])
    to = {"float": "<f4", "double": "<f8", "fixed32": "<u4", "sfixed32": "<u4", "fixed64": "<u8", "sfixed64": "<u8"}[kind]
    v = values.to_numpy(zero_copy_only=False)
    v = v.astype(to) if kind in ("float", "double") else v.astype(np.int64).view(np.uint64).astype(to)
    body = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1)
    full = np.concatenate([np.broadcast_to(tag, (len(v), len(tag))), body], axis=1)
    return Pieces(rows, np.full(len(v), full.shape[1], dtype=np.int64), full.ravel())


def _field_pieces(spec: Spec, values: pa.Array) -> list[Pieces]:
    rows = np.arange(len(values))
    if spec.repeated:
        values = values.cast(pa.list_(values.type.value_type))
        counts = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, values = np.repeat(rows, counts), values.flatten()
    if values.null_count:
        rows, values = rows[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
    if isinstance(spec.kind, str):
        return [_scalar_pieces(spec, rows, values)]
    inner = encode_columns([values.field(s.name) for s in spec.kind], spec.kind, len(values))
    if not spec.group:
        return [_scalar_pieces(Spec(spec.name, spec.number, "bytes"), rows, inner)]
    size, data = np.diff(spans_of(inner)[1], append=len(spans_of(inner)[0]) - 16), spans_of(inner)[0][:-16]
    a, b = (np.frombuffer(V.encode_u64(V.make_tag(spec.number, w)), dtype=np.uint8) for w in (V.START_GROUP, V.END_GROUP))
    return [Pieces(rows, *_wrapped(a, size, data, b))]


def _wrapped(head: np.ndarray, size: np.ndarray, data: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = size + len(head) + len(tail)
    out, at = np.zeros(int(total.sum()), dtype=np.uint8), (np.cumsum(total) - total).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    for j, x in enumerate(head):
        out[at + j] = x
    for j, x in enumerate(tail):
        out[at + len(head) + size + j] = x
    out[np.repeat(at + len(head) - offsets[:-1], size) + np.arange(offsets[-1])] = data
    return total, out


def encode_columns(columns: list[pa.Array], specs, n: int) -> pa.Array:
    """A message for each of ``n`` rows: the fields in the order of ``specs``, nulls left out."""
    pieces = [p for spec, c in zip(specs, columns, strict=True) for p in _field_pieces(spec, c)]
    total = _lengths(n)
    for p in pieces:
        np.add.at(total, p.rows, p.size)
    offsets = np.concatenate([[0], np.cumsum(total)])
    out, at = np.zeros(int(offsets[-1]), dtype=np.uint8), offsets[:-1].copy()
    for p in pieces:
        if not len(p.rows):
            continue
        # several pieces of one record stand one after another
        starts = np.concatenate([[0], np.cumsum(p.size)[:-1]]).astype(np.int64)
        first = np.concatenate([[True], p.rows[1:] != p.rows[:-1]])
        base = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        place = at[p.rows] + starts - starts[base]
        out[np.repeat(place - starts, p.size) + np.arange(int(p.size.sum()))] = p.data
        np.add.at(at, p.rows, p.size)
    from chunkwell.sources.simple import binary_array

    return binary_array(offsets, out.tobytes())


# Reading.


def decode_events(e: Events, specs, n: int) -> list[pa.Array]:
    """The columns of a typed view; of a field that occurs again the last one counts, absent ones are null."""
    out, every = [], e
    if len(e.depth) and e.depth.any():
        e = e.where(e.depth == 0)
    for spec in specs:
        wire = (V.START_GROUP if spec.group else V.BYTES) if not isinstance(spec.kind, str) else _WIRES[spec.kind]
        of = every if spec.group else e
        at = np.flatnonzero((of.number == spec.number) & (of.wire == wire) & (of.depth == 0))
        if not spec.repeated and len(at):
            at = at[np.append(of.record[at][1:] != of.record[at][:-1], True)]
        values = _decoded_groups(of, at, spec) if spec.group else _decoded(of, at, spec)
        if spec.repeated:
            counts = np.bincount(of.record[at], minlength=n)
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values))
        else:
            place = np.full(n, -1, dtype=np.int64)
            place[of.record[at]] = np.arange(len(at))
            out.append(values.take(pa.array(place, mask=place < 0)))
    return out


def _decoded_groups(e: Events, at: np.ndarray, spec: Spec) -> pa.Array:
    """The outermost groups that begin at ``at``, each up to its end, as structs."""
    ends = np.flatnonzero((e.wire == V.END_GROUP) & (e.depth == 0))
    stop = ends[np.searchsorted(ends, at)] if len(at) else at
    size = stop - at - 1
    before = np.cumsum(size) - size
    inside = np.repeat(at + 1 - before, size) + np.arange(int(size.sum()))
    inner = e.where(inside)
    inner.record, inner.depth, inner.ok = np.repeat(np.arange(len(at)), size), inner.depth - 1, np.ones(len(at), dtype=bool)
    return pa.StructArray.from_arrays(decode_events(inner, spec.kind, len(at)), fields=list(Spec("", 0, spec.kind).arrow))


def _decoded(e: Events, at: np.ndarray, spec: Spec) -> pa.Array:
    if not isinstance(spec.kind, str):
        inner = parse_spans(e.data, e.start[at], e.start[at] + e.size[at])
        return pa.StructArray.from_arrays(decode_events(inner, spec.kind, len(at)), fields=list(Spec("", 0, spec.kind).arrow))
    if _WIRES[spec.kind] == V.BYTES:
        from chunkwell.sources.simple import binary_array

        got = binary_array(*slices_of(e.data, e.start[at], e.size[at]))
        return got.cast(pa.string()) if spec.kind == "string" else got
    v, kind = e.value[at], spec.kind
    if kind in ("sint32", "sint64"):
        v = (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
    elif kind in ("float", "double"):
        v = v.view("<f8") if kind == "double" else v.astype("<u4").view("<f4")
    elif kind == "bool":
        return pa.array(v != 0)
    elif kind in ("int32", "sfixed32"):
        v = v.astype(np.uint32).view(np.int32)
    else:
        v = v.view(np.int64)
    return pa.array(v).cast(spec.arrow if not spec.repeated else spec.arrow.value_type)


def encode_one(values: dict, specs) -> bytes:
    """One message, for tests and small uses."""
    return encode_columns([pa.array([values.get(s.name)], s.arrow) for s in specs], specs, 1)[0].as_py()




class MessageWriter:
    """Builds one message field by field; submessages and groups are scopes that have to be closed."""

    def __init__(self):
        self._open: list[tuple[int, int, bytearray]] = []  # (number, wire, bytes before it)
        self._bytes = bytearray()

    def _tagged(self, number: int, wire: int, value: bytes = b"") -> MessageWriter:
        if not 1 <= number <= MAX_NUMBER:
            raise ValueError(f"field number {number}")
        self._bytes += V.encode_u64(V.make_tag(number, wire)) + value
        return self

    def varint(self, number: int, value: int) -> MessageWriter:
        """An unsigned, signed (two's complement in 64 bits) or boolean value."""
        return self._tagged(number, V.VARINT, V.encode_u64(int(value) & (1 << 64) - 1))

    def zigzag(self, number: int, value: int) -> MessageWriter:
        return self.varint(number, V.zigzag(value))

    def fixed32(self, number: int, value: int) -> MessageWriter:
        return self._tagged(number, V.FIXED32, (int(value) & 0xFFFFFFFF).to_bytes(4, "little"))

    def fixed64(self, number: int, value: int) -> MessageWriter:
        return self._tagged(number, V.FIXED64, (int(value) & (1 << 64) - 1).to_bytes(8, "little"))

    def float32(self, number: int, value: float) -> MessageWriter:
        return self._tagged(number, V.FIXED32, struct.pack("<f", value))

    def float64(self, number: int, value: float) -> MessageWriter:
        return self._tagged(number, V.FIXED64, struct.pack("<d", value))

    def data(self, number: int, value: bytes | str) -> MessageWriter:
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return self._tagged(number, V.BYTES, V.encode_u64(len(raw)) + raw)

    def field(self, f: Field) -> MessageWriter:
        """A field event as it is; the ends of groups are not balanced against the scopes."""
        self._bytes += serialize_field(f)
        return self

    def start_group(self, number: int) -> MessageWriter:
        """The tag alone, without a scope."""
        return self._tagged(number, V.START_GROUP)

    def end_group(self, number: int) -> MessageWriter:
        return self._tagged(number, V.END_GROUP)

    @contextmanager
    def _scope(self, number: int, wire: int):
        self._open.append((number, wire, self._bytes))
        self._bytes = bytearray()
        yield self
        inner, (_, _, self._bytes) = bytes(self._bytes), self._open.pop()
        if wire == V.BYTES:
            self.data(number, inner)
        else:
            self.start_group(number)._bytes += inner
            self.end_group(number)

    def submessage(self, number: int):
        """``with w.submessage(3): ...`` puts what is written inside into field 3."""
        return self._scope(number, V.BYTES)

    def group(self, number: int):
        return self._scope(number, V.START_GROUP)

    def __len__(self) -> int:
        return len(self._bytes)

    def as_bytes(self) -> bytes:
        """What the innermost open scope has so far."""
        return bytes(self._bytes)

    def finish(self) -> bytes:
        """The message; an error while a scope is open."""
        if self._open:
            raise MessageError(f"{len(self._open)} scopes are open")
        out, self._bytes = bytes(self._bytes), bytearray()
        return out
