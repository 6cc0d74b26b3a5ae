"""Simple chunks: the records' sizes as varints, then the records, each section compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from chunkwell.functions.codecs import NONE, codec_of, compress, decompress
from chunkwell.functions.errors import MalformedData
from chunkwell.functions.varint import decode_u64, encode_u64, join_varints, split_varints


def encode(sizes: np.ndarray, values, codec: int = NONE, level: int | None = None, window_log: int | None = None) -> bytes:
    """The data of a chunk of records with ``sizes``, whose bytes are ``values`` end to end."""
    section = join_varints(sizes)
    if codec == NONE:
        return b"".join((b"\0", encode_u64(len(section)), section, values))
    packed = encode_u64(len(section)) + compress(section, codec, level, window_log)
    return b"".join((bytes([codec]), encode_u64(len(packed)), packed, encode_u64(len(values)), compress(values, codec, level, window_log)))


def decode(data: bytes, records: int, decoded_size: int) -> pa.Array:
    """The records as a binary array over the decompressed bytes (not copied)."""
    if not data:
        raise MalformedData("empty simple chunk")
    codec = codec_of(data[0])
    size, at = decode_u64(data, 1)
    if size > len(data) - at:
        raise MalformedData("sizes reach behind the chunk")
    section, values = data[at : at + size], data[at + size :]
    if codec != NONE:
        claim, start = decode_u64(section)
        if claim > 10 * records:
            raise MalformedData("more bytes of sizes than records can have")
        section = decompress(section[start:], codec, claim)
        claim, start = decode_u64(values)
        if claim != decoded_size:
            raise MalformedData("the values' size is not the chunk's")
        values = decompress(values[start:], codec, claim)
    lengths = split_varints(section, records)
    offsets = np.zeros(records + 1, dtype=np.int64)
    if records:
        if int(lengths.max()) > decoded_size:
            raise MalformedData("a record is larger than its chunk")
        np.cumsum(lengths.astype(np.int64), out=offsets[1:])
    if offsets[-1] != decoded_size or len(values) != decoded_size:
        raise MalformedData("records do not fill their chunk")
    return binary_array(offsets, values)


def binary_array(offsets: np.ndarray, values) -> pa.Array:
    if offsets[-1] >= 1 << 31:
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def buffers_of(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(sizes, bytes end to end) of a binary array without nulls."""
    if pa.types.is_large_binary(array.type):
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    else:
        array = array.cast(pa.binary()) if not pa.types.is_binary(array.type) else array
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, dtype=np.int64)
    values = memoryview(array.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    return np.diff(offsets), values
