"""Physical layout of a record file: 64 KiB blocks with headers, chunks with headers.

A file is cut into blocks of 65,536 bytes, each of which begins with a 24-byte header that tells
how far back the chunk around it begins and how far ahead it ends.  A chunk is a 40-byte header
and its data, with block headers in between, padded so that it spans at least one byte a record.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from chunkwell.functions.errors import HashMismatch
from chunkwell.functions.highway import hash_many, highway_hash_64

BLOCK, BLOCK_HEADER, CHUNK_HEADER = 65_536, 24, 40
USABLE = BLOCK - BLOCK_HEADER
FIRST_CHUNK = BLOCK_HEADER + CHUNK_HEADER
SIGNATURE, METADATA, PADDING, SIMPLE, TRANSPOSED = b"smprt"
MAX_RECORDS = (1 << 56) - 1


def block_start(pos: int) -> int:
    """The block boundary at or before ``pos``."""
    return pos - pos % BLOCK


def remaining_in_block(pos: int) -> int:
    return -pos % BLOCK


def is_chunk_boundary(pos: int) -> bool:
    """Whether a chunk can begin at ``pos``: not within or just behind a block header."""
    return remaining_in_block(pos) < USABLE


def next_chunk_boundary(pos: int) -> int:
    """``pos``, or the next place where a chunk can begin."""
    return pos + max(0, remaining_in_block(pos) - (USABLE - 1))


def canonical(pos: int) -> int:
    """A chunk behind a block header is addressed by the block boundary."""
    return pos - BLOCK_HEADER if pos % BLOCK == BLOCK_HEADER else pos


def add_with_overhead(begin: int, length: int) -> int:
    """The position after ``length`` bytes written from ``begin``, with the block headers between them."""
    if length == 0:
        return begin
    # count in usable bytes from the start of begin's block
    used = max(begin % BLOCK, BLOCK_HEADER) - BLOCK_HEADER
    blocks, rest = divmod(used + length, USABLE)
    if rest == 0:
        return block_start(begin) + blocks * BLOCK
    return block_start(begin) + blocks * BLOCK + BLOCK_HEADER + rest


def distance_without_overhead(begin: int, pos: int) -> int:
    """Bytes between two positions that are not in block headers."""

    def usable(p: int) -> int:
        return p // BLOCK * USABLE + max(0, p % BLOCK - BLOCK_HEADER)

    return max(0, usable(pos) - usable(begin))


def chunk_end(begin: int, data_size: int, records: int) -> int:
    """The position after a chunk, padding included."""
    at = canonical(begin)
    return max(add_with_overhead(at, CHUNK_HEADER + data_size), next_chunk_boundary(at + records))


def end_after_padding(pos: int, multiple: int) -> int:
    """Where a padding chunk written at ``pos`` ends so that the file's size is a multiple; ``pos`` if it is already."""
    if multiple <= 1 or pos % multiple == 0:
        return pos
    length = multiple - pos % multiple
    while length < CHUNK_HEADER:
        length += multiple
    end = pos + length
    while not (is_chunk_boundary(end) and distance_without_overhead(pos, end) >= CHUNK_HEADER):
        end += multiple
    return end


def block_header(previous: int, following: int) -> bytes:
    body = struct.pack("<2Q", previous, following)
    return struct.pack("<Q", highway_hash_64(body)) + body


def read_block_header(raw: bytes) -> tuple[int, int]:
    """(distance back, distance ahead)."""
    stored, previous, following = struct.unpack("<3Q", raw)
    if stored != highway_hash_64(raw[8:]):
        raise HashMismatch("block header hash")
    return previous, following


@dataclass(frozen=True)
class ChunkHeader:
    data_size: int
    data_hash: int
    kind: int
    records: int
    decoded_size: int

    def to_bytes(self) -> bytes:
        body = struct.pack("<4Q", self.data_size, self.data_hash, self.kind | self.records << 8, self.decoded_size)
        return struct.pack("<Q", highway_hash_64(body)) + body

    @staticmethod
    def from_bytes(raw: bytes, verify: bool = True) -> ChunkHeader:
        stored, size, data_hash, kind, decoded = struct.unpack("<5Q", raw)
        if verify and stored != highway_hash_64(raw[8:]):
            raise HashMismatch("chunk header hash")
        return ChunkHeader(size, data_hash, kind & 255, kind >> 8, decoded)


def signature() -> bytes:
    """The first 64 bytes of every file."""
    return block_header(0, FIRST_CHUNK) + ChunkHeader(0, highway_hash_64(b""), SIGNATURE, 0, 0).to_bytes()


def frame_chunks(pos: int, chunks: list[tuple[int, int, int, bytes]]) -> tuple[bytes, int]:
    """Bytes of chunks (kind, records, decoded size, data) written from ``pos``, and the position behind them.

    All headers are hashed together, then all block headers.
    """
    data_hashes = hash_many([c[3] for c in chunks])
    bodies = [struct.pack("<4Q", len(d), h, kind | n << 8, size) for (kind, n, size, d), h in zip(chunks, data_hashes, strict=True)]
    heads = [struct.pack("<Q", h) + b for h, b in zip(hash_many(bodies), bodies, strict=True)]
    spans, at = [], pos
    for _, n, _, d in chunks:
        spans.append((at, chunk_end(at, len(d), n)))
        at = spans[-1][1]
    # a block header is due at each boundary that a chunk covers
    due = [(b, s, e) for s, e in spans for b in range(s + remaining_in_block(s), e, BLOCK)]
    boxed = [struct.pack("<2Q", b - s, e - b) for b, s, e in due]
    blocks = {b: struct.pack("<Q", h) + x for (b, _, _), h, x in zip(due, hash_many(boxed), boxed, strict=True)}
    out = []
    for (s, e), head, (_, _, _, d) in zip(spans, heads, chunks, strict=True):
        body, taken, p = memoryview(head + d), 0, s
        while p < e:
            if p % BLOCK == 0:
                out.append(blocks[p])
                p += BLOCK_HEADER
                continue
            room = min(BLOCK - p % BLOCK, e - p)
            part = body[taken : taken + room]
            out.append(part)
            if len(part) < room:
                out.append(bytes(room - len(part)))
            taken += len(part)
            p += room
    return b"".join(out), at
