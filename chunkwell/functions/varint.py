"""Varints, tags and zigzag: scalar functions, Spark expressions, and NumPy over whole batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwell.functions.errors import MalformedData

VARINT, FIXED64, BYTES, START_GROUP, END_GROUP, FIXED32 = range(6)
_M64 = (1 << 64) - 1


def encode_u64(value: int) -> bytes:
    """LEB128."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_u64(data, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, position behind it); overlong forms are accepted."""
    value = shift = 0
    most = (bits + 6) // 7
    for i in range(most):
        if at + i >= len(data):
            raise MalformedData("varint: end of data")
        b = data[at + i]
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            if value >> bits:
                raise MalformedData("varint: overflow")
            return value, at + i + 1
    raise MalformedData("varint: overflow")


def decode_canonical(data, at: int = 0, bits: int = 64) -> tuple[int, int] | None:
    """As :func:`decode_u64`, but None unless the form is complete and the shortest."""
    try:
        value, end = decode_u64(data, at, bits)
    except MalformedData:
        return None
    return None if end - at > 1 and data[end - 1] == 0 else (value, end)


def length_u64(value: int) -> int:
    return max(1, (value.bit_length() + 6) // 7)


def make_tag(number: int, wire: int) -> int:
    return number << 3 | wire


def zigzag(value: int, bits: int = 64) -> int:
    return ((value << 1) ^ (value >> (bits - 1))) & ((1 << bits) - 1)


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def wire_type_ok(raw: int) -> bool:
    return 0 <= raw <= 5


# Spark expressions; a LongType holds the bits of an unsigned number.


def varint_length(v: Column) -> Column:
    """Bytes of the varint of ``v``."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7)).cast("int")


def varint_hex(v: Column) -> Column:
    """The varint of ``v`` as upper-case hex."""
    group = lambda i: F.shiftrightunsigned(v, 0).bitwiseAND(127) if i == 0 else F.call_function("shiftrightunsigned", v, F.lit(7 * i)).bitwiseAND(127)
    parts = [F.lpad(F.hex(group(i) + F.when(varint_length(v) > i + 1, 128).otherwise(0)), 2, "0") for i in range(10)]
    return F.concat(*[F.when(varint_length(v) > i, p).otherwise("") for i, p in enumerate(parts)])


def tag(number: Column, wire: Column) -> Column:
    return F.shiftleft(number, 3).bitwiseOR(wire)


def tag_number(t: Column) -> Column:
    return F.shiftrightunsigned(t, 3)


def tag_wire_type(t: Column) -> Column:
    return t.bitwiseAND(7)


def zigzag_of(v: Column) -> Column:
    """Zigzag of a LongType."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


# Batches.


def encode_many(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each varint in a row of 10, lengths)."""
    v = values.astype(np.uint64, copy=False)
    out = np.zeros((len(v), 10), dtype=np.uint8)
    size = np.ones(len(v), dtype=np.int64)
    rest, rows = v, np.arange(len(v))
    for i in range(10):
        low = (rest & np.uint64(127)).astype(np.uint8)
        rest = rest >> np.uint64(7)
        more = rest > 0
        out[rows, i] = low | (more.astype(np.uint8) << 7)
        rows, rest = rows[more], rest[more]
        if not len(rows):
            break
        size[rows] += 1
    return out, size


def join_varints(values: np.ndarray) -> bytes:
    """The varints of ``values`` one after another."""
    if not len(values):
        return b""
    out, size = encode_many(values)
    return out[np.arange(out.shape[1])[None, :] < size[:, None]].tobytes()


def split_varints(data: bytes, count: int) -> np.ndarray:
    """``count`` varints that fill ``data`` exactly."""
    b = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(ends) != count or (count and ends[-1] != len(b) - 1) or (not count and len(b)):
        raise MalformedData("varints do not fill their section")
    if not count:
        return np.empty(0, dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    if size.max() > 10:
        raise MalformedData("varint: overflow")
    value = np.zeros(count, dtype=np.uint64)
    for i in range(int(size.max())):
        at = size > i
        value[at] |= (b[starts[at] + i] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
    if (b[ends[size == 10]] > 1).any():
        raise MalformedData("varint: overflow")
    return value


def read_many(buf: np.ndarray, pos: np.ndarray, end: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, positions behind, ok) of canonical varints at ``pos``; ``buf`` has 10 bytes to spare."""
    first = buf[pos]
    value = (first & np.uint8(127)).astype(np.uint64)
    after = pos + 1
    ok = pos < end
    rows = np.flatnonzero(first >= 128)
    for i in range(1, (bits + 6) // 7):
        if not len(rows):
            break
        at = pos[rows] + i
        b = buf[at]
        value[rows] |= (b & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
        after[rows] += 1
        last = b < 128
        bad = (at >= end[rows]) | (last & (b == 0))
        if i == (bits + 6) // 7 - 1:
            bad |= ~last | (b >= (1 << (bits - 7 * i)))
        ok[rows[bad]] = False
        rows = rows[~last & ~bad]
    return value, after, ok
