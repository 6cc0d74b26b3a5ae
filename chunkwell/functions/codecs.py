"""Codecs of chunk data: none, brotli, zstd and snappy, with length-prefixed blobs."""

from __future__ import annotations

import pyarrow as pa

from chunkwell.functions.errors import MalformedData, UnknownCompression, UnsupportedCompression
from chunkwell.functions.varint import decode_u64, encode_u64

NONE, BROTLI, ZSTD, SNAPPY = 0, ord("b"), ord("z"), ord("s")
NAMES = {"none": NONE, "brotli": BROTLI, "zstd": ZSTD, "snappy": SNAPPY}
_LEVELS = {BROTLI: (0, 11, 6), ZSTD: (-131_072, 22, 3)}
_WINDOWS = {BROTLI: (10, 30), ZSTD: (10, 31)}


def codec_of(byte: int) -> int:
    if byte not in NAMES.values():
        raise UnknownCompression(f"compression byte {byte}")
    return byte


def check_options(codec: int, level: int | None, window_log: int | None) -> None:
    """Raise ValueError unless the codec takes this level and window."""
    if level is not None and codec in _LEVELS and not _LEVELS[codec][0] <= level <= _LEVELS[codec][1]:
        raise ValueError(f"compression level {level} is not within {_LEVELS[codec][:2]}")
    if window_log is not None:
        if codec not in _WINDOWS:
            raise ValueError("this codec takes no window size")
        if not _WINDOWS[codec][0] <= window_log <= _WINDOWS[codec][1]:
            raise ValueError(f"window log {window_log} is not within {_WINDOWS[codec]}")


def compress(data: bytes, codec: int, level: int | None = None, window_log: int | None = None) -> bytes:
    if codec == NONE:
        return bytes(data)
    if codec == ZSTD:
        import zstandard

        level = _LEVELS[ZSTD][2] if level is None else level
        if window_log is None:
            c = zstandard.ZstdCompressor(level=level).compressobj()
        else:
            params = zstandard.ZstdCompressionParameters.from_level(level, window_log=window_log)
            c = zstandard.ZstdCompressor(compression_params=params).compressobj()
        return c.compress(data) + c.flush()
    if codec == BROTLI:
        if window_log not in (None, 22):
            raise UnsupportedCompression("this installation's brotli has a fixed window of 22 bits")
        return pa.Codec("brotli", compression_level=_LEVELS[BROTLI][2] if level is None else level).compress(data, asbytes=True)
    if codec == SNAPPY:
        return pa.Codec("snappy").compress(data, asbytes=True)
    raise UnknownCompression(f"compression byte {codec}")


def decompress(data: bytes, codec: int, size: int) -> bytes:
    """``data`` decompressed; anything but exactly ``size`` bytes is an error, and no more is ever held."""
    if codec == NONE:
        out = bytes(data)
    elif codec == ZSTD:
        import zstandard

        try:
            with zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(data) as r:
                out = r.read(size + 1)
            if len(out) == size and not _one_frame(data):
                raise MalformedData("data behind a zstd frame")
        except zstandard.ZstdError as e:
            raise MalformedData(f"zstd: {e}") from e
    elif codec in (BROTLI, SNAPPY):
        if codec == SNAPPY:
            claim, _ = decode_u64(data)
            if claim != size:
                raise MalformedData("snappy: another size than claimed")
        if not size:
            return b""
        try:
            out = pa.Codec("brotli" if codec == BROTLI else "snappy").decompress(data, decompressed_size=size, asbytes=True)
        except (pa.ArrowInvalid, OSError) as e:
            raise MalformedData(f"decompression: {e}") from e
    else:
        raise UnknownCompression(f"compression byte {codec}")
    if len(out) != size:
        raise MalformedData(f"decompressed to {len(out)} bytes, {size} claimed")
    return out


def _one_frame(data: bytes) -> bool:
    """Whether a frame of a size just checked ends where the data ends."""
    import zstandard

    d = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    d.decompress(data)
    return d.eof and not d.unused_data


def with_size(data: bytes, codec: int, level=None, window_log=None) -> bytes:
    """A blob: the uncompressed size (but for codec none), then the data."""
    return bytes(data) if codec == NONE else encode_u64(len(data)) + compress(data, codec, level, window_log)


def without_size(blob: bytes, codec: int, limit: int | None = None) -> bytes:
    """The data of a blob; ``limit`` bounds the claim before anything is decompressed."""
    if codec == NONE:
        return bytes(blob)
    size, at = decode_u64(blob)
    if limit is not None and size > limit:
        raise MalformedData(f"{size} bytes claimed, {limit} at most can be right")
    return decompress(blob[at:], codec, size)
