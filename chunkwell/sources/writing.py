"""Writing a record file: packing records into chunks, framing, padding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from chunkwell.functions import layout as L
from chunkwell.functions.codecs import NAMES, NONE, check_options
from chunkwell.functions.errors import WriterClosed, WriterFailed
from chunkwell.sources import simple

DEFAULT_CHUNK = 1 << 20
#: How much is held back to be framed together: chunks, and bytes at most.
HELD_CHUNKS, HELD_BYTES = 256, 32 << 20


@dataclass(frozen=True)
class WriteOptions:
    """How a file is written; the defaults are a simple, uncompressed file with chunks of 1 MiB."""

    compression: str = "none"
    level: int | None = None
    window_log: int | None = None
    chunk_size: int = DEFAULT_CHUNK
    transpose: bool = False
    bucket_fraction: float = 1.0
    initial_padding: int = 1
    final_padding: int = 1
    metadata: bytes | None = None

    def __post_init__(self):
        if self.compression not in NAMES:
            raise ValueError(f"compression {self.compression!r}: one of {', '.join(NAMES)} is known")
        check_options(self.codec, self.level, self.window_log)

    @property
    def codec(self) -> int:
        return NAMES[self.compression]

    @property
    def most(self) -> int:
        return min(self.chunk_size, 8 * L.MAX_RECORDS)

    @property
    def bucket_size(self) -> int:
        return max(1, int(self.chunk_size * min(1.0, max(0.0, self.bucket_fraction)) + 0.5))


def pack(sizes: np.ndarray, most: int) -> list[int]:
    """Ends of the chunks: each holds as many records as fit at a cost of size + 8, one at least."""
    cost = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + 8)])
    ends, at, n = [], 0, len(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + most, side="right")) - 1)
        ends.append(end)
        at = end
    return ends


class RecordWriter:
    """Turns binary arrays into the bytes of a record file, in pieces; see :meth:`close`."""

    def __init__(self, options: WriteOptions | None = None):
        self.options = o = options or WriteOptions()
        self.pos = L.FIRST_CHUNK
        self.records = 0
        self._parts: list[bytes] = [L.signature()]
        self._sizes = np.empty(0, dtype=np.int64)
        self._values = b""
        self._waiting: list[tuple[np.ndarray, memoryview]] = []
        self._held = 0
        self._closed, self._failed = False, False
        if o.metadata is not None:
            from chunkwell.sources import transposed

            self._frame([(L.METADATA, 0, len(o.metadata), transposed.encode([o.metadata], o.codec, o.level, o.window_log))])

    def _check(self) -> None:
        if self._closed:
            raise WriterClosed("the writer is closed")
        if self._failed:
            raise WriterFailed("an earlier call failed")

    def write(self, records: pa.Array) -> None:
        """Append records; a null is an error."""
        self._check()
        if records.null_count:
            raise ValueError("a record is null")
        sizes, values = simple.buffers_of(records)
        self._waiting.append((sizes, values))
        self._held += len(values) + 8 * len(sizes)
        # chunks are hashed in lock step, so it pays to frame many of them together
        if self._held >= max(self.options.most, min(HELD_CHUNKS * self.options.most, HELD_BYTES)):
            self._emit(final=False)

    def write_record(self, record: bytes) -> None:
        self.write(pa.array([record], pa.binary()))

    def _emit(self, final: bool) -> None:
        self._sizes = np.concatenate([self._sizes, *(s for s, _ in self._waiting)])
        self._values = b"".join((self._values, *(v for _, v in self._waiting)))
        self._waiting, self._held = [], 0
        ends = pack(self._sizes, self.options.most)
        if not final and ends:
            # the last chunk may still grow, unless not even an empty record fits
            last = ends[-2] if len(ends) > 1 else 0
            if int((self._sizes[last:] + 8).sum()) + 8 <= self.options.most:
                ends.pop()
        if not ends:
            return
        offsets = np.concatenate([[0], np.cumsum(self._sizes)])
        chunks, start, view = [], 0, memoryview(self._values)
        try:
            for end in ends:
                a, b = int(offsets[start]), int(offsets[end])
                chunks.append(self._encoded(self._sizes[start:end], view[a:b]))
                start = end
            self._frame(chunks)
        except Exception:
            self._failed = True
            raise
        self.records += start
        self._sizes, self._values = self._sizes[start:], bytes(view[int(offsets[start]) :])

    def _encoded(self, sizes: np.ndarray, values) -> tuple[int, int, int, bytes]:
        o = self.options
        if not o.transpose:
            return L.SIMPLE, len(sizes), len(values), simple.encode(sizes, values, o.codec, o.level, o.window_log)
        from chunkwell.sources import transposed

        records = simple.binary_array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), bytes(values))
        return L.TRANSPOSED, len(sizes), len(values), transposed.encode(records, o.codec, o.level, o.window_log, o.bucket_size)

    def _frame(self, chunks) -> None:
        framed, self.pos = L.frame_chunks(self.pos, chunks)
        self._parts.append(framed)

    def take(self) -> list[bytes]:
        """The bytes since the last call."""
        out, self._parts = self._parts, []
        return out

    def flush(self) -> None:
        """End the current chunk and pad the file."""
        self._check()
        self._emit(final=True)
        end = L.end_after_padding(self.pos, self.options.final_padding)
        if end > self.pos:
            room = L.distance_without_overhead(self.pos, end) - L.CHUNK_HEADER
            self._frame([(L.PADDING, 0, 0, bytes(room))])

    def close(self) -> list[bytes]:
        """Flush; the remaining bytes.  Nothing can be written afterwards."""
        self.flush()
        self._closed = True
        return self.take()


def write_bytes(records: list[bytes], options: WriteOptions | None = None) -> bytes:
    """A whole file in memory."""
    w = RecordWriter(options)
    w.write(pa.array(records, pa.binary()))
    return b"".join(w.close())


__all__ = ["NONE", "RecordWriter", "WriteOptions", "pack", "write_bytes"]
