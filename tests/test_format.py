"""Layout, hash, codecs, chunks: fixed anchors, round trips, damage."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import Bytes, random_message, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwell.functions import codecs as C
from chunkwell.functions import layout as L
from chunkwell.functions import varint as V
from chunkwell.functions.errors import MalformedData, RecordFileError, WriterClosed
from chunkwell.functions.highway import hash_many, highway_hash_64
from chunkwell.operators.projection import Field, Projection
from chunkwell.sources import transposed
from chunkwell.sources.chunks import Input, Region, records, walk
from chunkwell.sources.writing import RecordWriter, WriteOptions, pack, write_bytes


def test_hash_of_nothing():
    assert highway_hash_64(b"") == 0x72C3B1E9C0139FE1


def test_hash_in_lock_step_is_the_scalar_one():
    strings = [os.urandom(n) for n in [*range(70), 1000, 4097]]
    assert hash_many(strings) == [highway_hash_64(s) for s in strings]


@pytest.mark.parametrize(
    ("n", "sha"),
    [
        (65_473, "e8c7a99e279f9429cb610a2a36ec6486e76ecb0d637c7cfd19c941120372df2f"),
        (65_496, "29856f50ae8864f836a277f5e97789e37e120aaff0722ab6500b1c8dfbb4cb23"),
        (65_472, "b7f0cc6c7af0490c7a6e72492c9abb9be579d4fb47121c893f9a915889e3d4dd"),
    ],
)
def test_published_digests_of_empty_records(n, sha):
    data = write_bytes([b""] * n, WriteOptions(compression="zstd"))
    assert hashlib.sha256(data).hexdigest() == sha
    assert len(rows_of(data)) == n


def test_chunk_behind_a_boundary_has_the_boundarys_address():
    first = write_bytes([b"a"], WriteOptions(final_padding=65_536))
    assert len(first) == 65_536
    both = first + write_bytes([b"b"])
    assert [c.begin for c, _ in walk(Input(Bytes(both))) if c.header.records] == [64, 65_600]
    assert rows_of(both) == [b"a", b"b"]


def test_overhead_against_a_walk():
    def walked(begin, n):
        p = begin
        while n:
            p += max(0, 24 - p % 65_536) if p % 65_536 < 24 else 0
            step = min(n, 65_536 - p % 65_536)
            p, n = p + step, n - step
        return p

    rng = random.Random(1)
    for _ in range(500):
        b, n = rng.choice([rng.randrange(300_000), 65_536 * rng.randrange(3), 131_072 - rng.randrange(60)]), rng.randrange(1, 300_000)
        end = L.add_with_overhead(b, n)
        assert end == walked(b, n)
        assert L.distance_without_overhead(b, end) == n


@pytest.mark.parametrize("codec", list(C.NAMES.values()))
def test_codecs_keep_bytes_and_sizes(codec):
    for data in (b"", b"x", b"ab" * 3000, os.urandom(500)):
        assert C.without_size(C.with_size(data, codec), codec) == data
    if codec != C.NONE:
        with pytest.raises(MalformedData):
            C.decompress(C.compress(b"abc" * 50, codec), codec, 149)


def test_zstd_takes_one_frame():
    twice = C.compress(b"abc", C.ZSTD) * 2
    with pytest.raises(MalformedData):
        C.decompress(twice, C.ZSTD, 3)


def test_codec_options_are_checked():
    for bad in ({"compression": "lz4"}, {"compression": "zstd", "level": 23}, {"compression": "none", "window_log": 20}, {"compression": "brotli", "window_log": 31}):
        with pytest.raises(ValueError):
            WriteOptions(**bad)
    assert rows_of(write_bytes([b"q" * 9000], WriteOptions(compression="zstd", window_log=12))) == [b"q" * 9000]


def test_packing_rule():
    assert pack(np.full(1000, 8), 4096) == [256, 512, 768, 1000]
    assert pack(np.array([5000, 1, 1]), 4096) == [1, 3]
    assert pack(np.array([0, 0, 0]), 1) == [1, 2, 3]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=40), st.sampled_from(["none", "zstd", "brotli", "snappy"]), st.sampled_from([1, 256, 4096]), st.booleans())
def test_any_records_come_back(rows, codec, size, transpose):
    data = write_bytes(rows, WriteOptions(compression=codec, chunk_size=size, transpose=transpose))
    assert rows_of(data) == rows


def test_ranges_of_a_file_hold_every_record_once():
    rng = random.Random(4)
    rows = [os.urandom(rng.choice([0, 10, 3000])) for _ in range(120)]
    data = write_bytes(rows, WriteOptions(chunk_size=2000))
    for step in (65_536, 131_072):
        assert [r for b in range(0, len(data), step) for r in rows_of(data, begin=b, stop=b + step)] == rows


def test_padding_and_flush():
    for multiple in (7, 100, 65_536):
        data = write_bytes([b"abc"], WriteOptions(final_padding=multiple))
        assert len(data) % multiple == 0
        assert rows_of(data) == [b"abc"]
    w = RecordWriter()
    w.write_record(b"1")
    w.flush()
    w.write_record(b"2")
    parts = w.take() + w.close()
    assert rows_of(b"".join(parts)) == [b"1", b"2"]
    with pytest.raises(WriterClosed):
        w.write_record(b"3")


def test_empty_and_short_files():
    assert rows_of(b"") == []
    with pytest.raises(MalformedData):
        rows_of(b"short")
    regions = []
    assert rows_of(b"short", recover=True, regions=regions) == []
    assert (regions[0].begin, regions[0].end) == (0, 5)
    with pytest.raises(MalformedData):
        rows_of(bytes(64))


def _numbered():
    return [b"%08d" % i for i in range(1000)]


def test_damaged_data_loses_its_chunk_alone():
    data = bytearray(write_bytes(_numbered(), WriteOptions(chunk_size=4096)))
    chunks = [c for c, _ in walk(Input(Bytes(bytes(data)))) if c.header.records]
    data[chunks[1].begin + 60] ^= 1
    with pytest.raises(MalformedData):
        rows_of(bytes(data))
    regions = []
    got = list(records(Input(Bytes(bytes(data))), recover=True, regions=regions))
    assert [r for _, a, _ in got for r in a.to_pylist()] == _numbered()[:256] + _numbered()[512:]
    assert regions == [Region(chunks[1].begin, chunks[1].end, regions[0].message)]
    assert [gap for _, _, gap in got] == [False, True, False]


def test_damaged_header_resumes_at_the_next_block():
    rows = [os.urandom(1000) for _ in range(300)]
    data = bytearray(write_bytes(rows, WriteOptions(chunk_size=10_000)))
    chunks = [c for c, _ in walk(Input(Bytes(bytes(data)))) if c.header.records]
    data[chunks[2].begin + 3] ^= 1
    regions = []
    got = rows_of(bytes(data), recover=True, regions=regions)
    assert len(regions) == 1 and regions[0].begin == chunks[2].begin and regions[0].end >= 65_536
    assert got == rows[: len(got) - len(rows) + rows.index(got[-1]) + 1][: 2 * chunks[0].header.records] + [r for r in rows if r in set(got[2 * chunks[0].header.records :])]
    assert 0 < len(got) < len(rows)


def test_random_damage_never_escapes():
    rng = random.Random(8)
    data = write_bytes([os.urandom(rng.randrange(400)) for _ in range(80)], WriteOptions(chunk_size=2000, compression="zstd"))
    for _ in range(40):
        bad = bytearray(data)
        for _ in range(2):
            bad[rng.randrange(64, len(bad))] ^= 255
        regions = []
        rows_of(bytes(bad), recover=True, regions=regions)
        assert all(r.length > 0 for r in regions)


def test_truncated_tail():
    data = write_bytes(_numbered(), WriteOptions(chunk_size=4096))
    regions = []
    got = rows_of(data[:-100], recover=True, regions=regions)
    assert got == _numbered()[:768] and len(regions) == 1


def test_transposed_trees_reach_every_state():
    for n in (1, 64, 65, 4097):
        slots, leads, paths = transposed._places(n)
        for state, path in enumerate(paths):
            base = 0
            for o in path:
                at, base = base + o, leads[base + o]
            assert slots[at] == state


def test_transposed_round_trip_of_random_messages():
    rng = random.Random(6)
    for _ in range(30):
        rows = [random_message(rng) if rng.random() < 0.8 else os.urandom(rng.randrange(12)) for _ in range(rng.randrange(1, 40))]
        data = transposed.encode(rows, rng.choice(list(C.NAMES.values())), bucket_size=rng.choice([None, 1, 100]))
        assert transposed.decode(data, len(rows), sum(map(len, rows))).to_pylist() == rows


def test_projection_while_decoding_is_projection_of_records():
    rng = random.Random(9)
    for _ in range(200):
        rows = [random_message(rng) if rng.random() < 0.8 else os.urandom(rng.randrange(12)) for _ in range(rng.randrange(1, 20))]
        data = transposed.encode(rows, rng.choice(list(C.NAMES.values())), bucket_size=rng.choice([None, 1, 100]))
        p = Projection(*[Field(tuple(rng.randrange(1, 40) for _ in range(rng.choice([1, 1, 2, 3]))), rng.random() < 0.3) for _ in range(rng.randrange(25))])
        assert transposed.decode(data, len(rows), sum(map(len, rows)), p).to_pylist() == [p.apply(r) for r in rows]


def _wide(n=400, fields=20):
    return [b"".join(V.encode_u64(k << 3) + V.encode_u64(1000 + i * k) for k in range(1, fields + 1)) for i in range(n)]


def test_unneeded_buckets_stay_packed(monkeypatch):
    rows, opened = _wide(), []
    data = transposed.encode(rows, C.ZSTD, bucket_size=1)
    real = transposed._Buffers.bucket
    monkeypatch.setattr(transposed._Buffers, "bucket", lambda self, k: (opened.append(k), real(self, k))[1])
    size = sum(map(len, rows))
    assert transposed.decode(data, len(rows), size).to_pylist() == rows and len(set(opened)) == 20
    for text, many in (("3", 1), ("3;7", 2), ("3?", 0), ("", 0), ("3?;9", 1), ("99", 0)):
        opened.clear()
        p = Projection.parse(text)
        assert transposed.decode(data, len(rows), size, p).to_pylist() == [p.apply(r) for r in rows]
        assert len(set(opened)) == many


def test_damage_in_an_unneeded_bucket_is_not_read():
    rows = _wide()
    data = transposed.encode(rows, C.ZSTD, bucket_size=1)
    b = transposed._Buffers
    seen = []
    real = b.__init__
    try:
        b.__init__ = lambda self, *a: (real(self, *a), seen.append(self))[0]
        transposed.decode(data, len(rows), sum(map(len, rows)))
    finally:
        b.__init__ = real
    at = seen[0].spans[-1][0] + 3
    bad = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    with pytest.raises(MalformedData):
        transposed.decode(bad, len(rows), sum(map(len, rows)))
    last = {i for i, (k, _) in enumerate(seen[0].places) if k == len(seen[0].spans) - 1}
    fine = [n for n in range(1, 21) if transposed.decode(data, len(rows), sum(map(len, rows)), Projection.parse(str(n))) is not None]
    good = 0
    for n in fine:
        try:
            good += transposed.decode(bad, len(rows), sum(map(len, rows)), Projection.parse(str(n))).to_pylist() == [Projection.parse(str(n)).apply(r) for r in rows]
        except MalformedData:
            pass
    assert len(last) == 1 and good == 19


def test_submessages_and_groups_of_one_number():
    inner = b"\x08\x96\x01\x12\x02hi"
    rows = [b"\x0a" + bytes([len(inner)]) + inner + b"\x0b" + inner + b"\x0c", b"\x0b\x0b\x08\xac\x02\x0c\x0c", b""]
    data = transposed.encode(rows)
    assert transposed.decode(data, 3, sum(map(len, rows))).to_pylist() == rows


def test_implicit_loops_are_rejected():
    with pytest.raises(MalformedData):
        transposed._reject_loops([1, 2, 0], [True, True, True])
    transposed._reject_loops([1, 2, 0], [True, True, False])


def test_transposed_damage_is_reported():
    rng = random.Random(7)
    rows = [random_message(rng) for _ in range(10)]
    data = transposed.encode(rows)
    for _ in range(300):
        bad = bytearray(data)
        bad[rng.randrange(1, len(bad))] ^= 1 << rng.randrange(8)
        try:
            transposed.decode(bytes(bad), len(rows), sum(map(len, rows)))
        except RecordFileError:
            pass


def test_varints():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    for v in values:
        raw = V.encode_u64(v)
        assert V.decode_u64(raw) == (v, len(raw)) and V.length_u64(v) == len(raw)
    joined = V.join_varints(np.array(values, dtype=np.uint64))
    assert V.split_varints(joined, len(values)).tolist() == values
    assert V.decode_u64(b"\x80\x00") == (0, 2) and V.decode_canonical(b"\x80\x00") is None
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(MalformedData):
            V.decode_u64(bad)
    for v in (0, -1, 1, 2**63 - 1, -(2**63)):
        assert V.unzigzag(V.zigzag(v)) == v


def test_writer_rejects_nulls():
    with pytest.raises(ValueError):
        RecordWriter().write(pa.array([None], pa.binary()))
