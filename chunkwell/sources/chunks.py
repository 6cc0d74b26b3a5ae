"""Walking the chunks of a file: headers, data, damage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa

from chunkwell.functions import layout as L
from chunkwell.functions.errors import HashMismatch, MalformedData, UnknownChunkType
from chunkwell.functions.highway import hash_many
from chunkwell.sources import simple


@dataclass(frozen=True)
class Region:
    """Bytes that could not be read: ``[begin, end)`` and why."""

    begin: int
    end: int
    message: str

    @property
    def length(self) -> int:
        return self.end - self.begin

    def __str__(self) -> str:
        return f"[{self.begin}..{self.end}): {self.message}"


@dataclass(frozen=True)
class Chunk:
    begin: int
    end: int
    data_begin: int
    header: L.ChunkHeader


class Input:
    """Positioned reads from a file of known size."""

    def __init__(self, source, size: int | None = None):
        self.source = source
        self.size = source.size() if size is None else size

    def at(self, pos: int, n: int) -> bytes:
        self.source.seek(pos)
        return self.source.read(n)

    def chunk_at(self, pos: int) -> Chunk | None:
        """The chunk at ``pos`` by its header; None at the end of the file."""
        begin = p = L.canonical(pos)
        raw, inner = b"", None
        while len(raw) < L.CHUNK_HEADER:
            if p % L.BLOCK == 0:
                box = self.at(p, L.BLOCK_HEADER)
                if not box and p == begin:
                    return None
                if len(box) < L.BLOCK_HEADER:
                    raise MalformedData(f"truncated file: incomplete chunk at {begin}")
                try:
                    previous, following = L.read_block_header(box)
                except HashMismatch:
                    raise HashMismatch(f"block header hash at {p}") from None
                if p - previous != begin:
                    raise MalformedData(f"block header at {p} knows another chunk than the one at {begin}")
                if raw:
                    inner = (p, following)
                p += L.BLOCK_HEADER
            part = self.at(p, min(L.CHUNK_HEADER - len(raw), L.BLOCK - p % L.BLOCK))
            if not part and p == begin:
                return None
            if len(part) < min(L.CHUNK_HEADER - len(raw), L.BLOCK - p % L.BLOCK):
                raise MalformedData(f"truncated file: incomplete chunk at {begin}")
            raw, p = raw + part, p + len(part)
        try:
            header = L.ChunkHeader.from_bytes(raw)
        except HashMismatch:
            raise HashMismatch(f"chunk header hash at {begin}") from None
        if header.data_size > self.size - p or header.records > self.size - begin:
            raise MalformedData(f"chunk at {begin} claims more than the file has")
        end = L.chunk_end(begin, header.data_size, header.records)
        if inner and inner[0] + inner[1] != end:
            raise MalformedData(f"block header at {inner[0]} knows another end of the chunk at {begin}")
        return Chunk(begin, end, p, header)

    def data_of(self, chunk: Chunk) -> bytes:
        """The data of a chunk without block headers, each of which is checked; its own hash is not."""
        size, p = chunk.header.data_size, chunk.data_begin
        stop = L.add_with_overhead(p, size)
        raw = self.at(p, stop - p)
        if len(raw) < stop - p:
            raise MalformedData(f"truncated file: incomplete chunk at {chunk.begin}")
        parts, start = [], p
        while p < stop:
            if p % L.BLOCK == 0:
                try:
                    previous, following = L.read_block_header(raw[p - start : p - start + L.BLOCK_HEADER])
                except HashMismatch:
                    raise HashMismatch(f"block header hash at {p}") from None
                if p - previous != chunk.begin or p + following != chunk.end:
                    raise MalformedData(f"block header at {p} contradicts the chunk at {chunk.begin}")
                p += L.BLOCK_HEADER
            q = min(stop, p + L.BLOCK - p % L.BLOCK)
            parts.append(memoryview(raw)[p - start : q - start])
            p = q
        return b"".join(parts)

    def resync(self, after: int) -> int:
        """Where reading can go on behind damage at ``after``: by the next sound block header, or the end."""
        p = L.block_start(after) + L.BLOCK
        while p < self.size:
            box = self.at(p, L.BLOCK_HEADER)
            if len(box) == L.BLOCK_HEADER:
                try:
                    previous, following = L.read_block_header(box)
                    target = p if previous == 0 else p + following
                    if target > after and (previous == 0 or following > 0):
                        return min(target, self.size)
                except HashMismatch:
                    pass
            p += L.BLOCK
        return self.size

    def first_chunk_from(self, pos: int) -> int:
        """The beginning of the first chunk at or behind ``pos`` (as far as block headers are sound)."""
        if pos <= 0:
            return 0
        p = L.block_start(pos)
        if p == 0:
            at = L.FIRST_CHUNK
        else:
            box = self.at(p, L.BLOCK_HEADER)
            if len(box) < L.BLOCK_HEADER:
                return self.size
            try:
                previous, following = L.read_block_header(box)
            except HashMismatch:
                return self.resync(p)
            at = p if previous == 0 else p + following
        return at


def check_special(chunk: Chunk, data: bytes) -> None:
    """Raise unless a chunk without records is as its kind has to be."""
    h = chunk.header
    if h.kind == L.SIGNATURE and (h.data_size or h.records or h.decoded_size):
        raise MalformedData(f"signature chunk at {chunk.begin} is not empty")
    if h.kind == L.METADATA and h.records:
        raise MalformedData(f"metadata chunk at {chunk.begin} has records")
    if h.kind == L.PADDING and (h.records or h.decoded_size):
        raise MalformedData(f"padding chunk at {chunk.begin} has records")
    if h.kind not in b"smprt" and h.records:
        raise UnknownChunkType(f"chunk type {h.kind} at {chunk.begin}")


def decode_records(chunk: Chunk, data: bytes, projection=None) -> pa.Array | None:
    """The records of a chunk; None for a kind without records."""
    h = chunk.header
    if h.kind == L.SIMPLE:
        return simple.decode(data, h.records, h.decoded_size)
    if h.kind == L.TRANSPOSED:
        from chunkwell.sources import transposed

        return transposed.decode(data, h.records, h.decoded_size, projection)
    check_special(chunk, data)
    return None


def complete_end(source: Input, known: int = 0) -> int:
    """Where the last complete chunk of a file that may still grow ends, or damage behind which nothing is sound yet.

    ``known`` is an earlier such end.  The walk begins at the last sound block header, whose chunk
    begins or ends near it.
    """
    at, p = known, L.block_start(max(0, source.size - 1))
    while p > known:
        box = source.at(p, L.BLOCK_HEADER)
        try:
            if len(box) == L.BLOCK_HEADER:
                previous, _ = L.read_block_header(box)
                if previous <= p - known:
                    at = p - previous if previous else p
                    break
        except HashMismatch:
            pass
        p -= L.BLOCK
    while at < source.size:
        try:
            chunk = source.chunk_at(at)
            if chunk is None or chunk.end > source.size:
                break
            at = chunk.end
        except MalformedData as e:
            # an incomplete chunk is waited for; behind damage, the next sound block header leads on
            after = source.resync(at) if isinstance(e, HashMismatch) else source.size
            if after >= source.size:
                break
            at = after
    return at


def walk(source: Input, begin: int = 0, stop: int | None = None, recover: bool = False, regions: list[Region] | None = None, exact: bool = False) -> Iterator[tuple[Chunk, bool]]:
    """(chunk, whether something was skipped just before it) of chunks that begin in ``[begin, stop)``.

    With ``recover``, damage of headers is skipped and noted in ``regions``; else it is raised.  A chunk is
    known to begin at ``begin`` if that is ``exact``; else block headers lead to the first one behind it.
    """
    stop = source.size if stop is None else stop
    if source.size and begin == 0 and source.size < L.FIRST_CHUNK:
        problem = MalformedData("a file of less than 64 bytes")
        if not recover:
            raise problem
        _note(regions, Region(0, source.size, str(problem)))
        return
    p, gap = begin if exact else source.first_chunk_from(begin), False
    while p < min(stop, source.size):
        try:
            chunk = source.chunk_at(p)
            if chunk is None:
                return
            if p == 0 and (chunk.header.kind != L.SIGNATURE or source.at(0, L.FIRST_CHUNK) != L.signature()):
                raise MalformedData("not a record file")
        except MalformedData as e:
            if not recover:
                raise
            after = source.resync(p)
            _note(regions, Region(p, after, str(e)))
            p, gap = after, True
            continue
        if chunk.begin >= begin:  # else it belongs to the part before
            yield chunk, gap
            gap = False
        p = chunk.end


def _note(regions, region: Region) -> None:
    if regions is not None:
        regions.append(region)


#: Chunks that are hashed together.
BATCH_BYTES = 32 << 20


def records(source: Input, begin: int = 0, stop: int | None = None, recover: bool = False, regions: list[Region] | None = None, verify: bool = True, projection=None, want=lambda chunk: True, exact: bool = False) -> Iterator[tuple[Chunk, pa.Array, bool]]:
    """(chunk, its records, after a gap) of the chunks with records; data hashes are checked batch by batch.

    ``projection`` may be a function of the chunk, which changes it between chunks.
    """
    held: list[tuple[Chunk, bytes | Exception, bool]] = []
    total, gap = 0, False

    def flush():
        nonlocal gap
        good = [i for i, (_, d, _) in enumerate(held) if isinstance(d, bytes)]
        hashes = dict(zip(good, hash_many([held[i][1] for i in good]), strict=True)) if verify else {}
        for i, (chunk, data, jump) in enumerate(held):
            gap |= jump
            try:
                if isinstance(data, Exception):
                    raise data
                if verify and hashes[i] != chunk.header.data_hash:
                    raise HashMismatch(f"data hash of the chunk at {chunk.begin}")
                found = decode_records(chunk, data, projection(chunk) if callable(projection) else projection)
            except MalformedData as e:
                if not recover:
                    raise
                _note(regions, Region(chunk.begin, chunk.end, str(e)))
                gap = True
                continue
            if found is not None and len(found):
                yield chunk, found, gap
                gap = False

    for chunk, jump in walk(source, begin, stop, recover, regions, exact):
        if chunk.header.kind in b"rt" and not want(chunk):
            continue
        try:
            data: bytes | Exception = source.data_of(chunk)
        except MalformedData as e:
            data = e
        held.append((chunk, data, jump))
        total += chunk.header.data_size
        if total >= BATCH_BYTES:
            yield from flush()
            held, total = [], 0
    yield from flush()


