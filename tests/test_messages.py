"""Messages: parsing, building, projection, filters, handlers."""

import os
import random

import pyarrow as pa
import pytest
from helpers import random_message

from chunkwell.functions import messages as M
from chunkwell.functions import varint as V
from chunkwell.functions.errors import MessageError
from chunkwell.functions.messages import Spec, copy_fields, decode_events, encode_columns, encode_one, fields_of, is_message, parse, serialize_field
from chunkwell.operators.messages import DynamicHandlers, FieldHandler, HandlerSet, read_message
from chunkwell.operators.positions import Position
from chunkwell.operators.projection import Field, Projection


def tag(n, w):
    return V.encode_u64(n << 3 | w)


def varint(n, v):
    return tag(n, 0) + V.encode_u64(v)


def sub(n, inner):
    return tag(n, 2) + V.encode_u64(len(inner)) + inner


def group(n, inner):
    return tag(n, 3) + inner + tag(n, 4)


def test_known_bytes():
    assert encode_one({"a": 150}, (Spec("a", 1, "uint64"),)).hex() == "089601"
    assert encode_one({"a": -1}, (Spec("a", 1, "int32"),)) == b"\x08" + b"\xff" * 9 + b"\x01"
    assert encode_one({"a": -1}, (Spec("a", 1, "sint32"),)).hex() == "0801"
    assert encode_one({"s": "é"}, (Spec("s", 2, "string"),)).hex() == "1202c3a9"


def test_lock_step_parser_is_the_scalar_one():
    rng = random.Random(2)
    rows = [random_message(rng) for _ in range(400)] + [os.urandom(rng.randrange(8)) for _ in range(400)] + [b""]
    e = parse(pa.array(rows, pa.binary()))
    by = [[] for _ in rows]
    for r, n, w, v, s, z in zip(e.record, e.number, e.wire, e.value, e.start, e.size, strict=True):
        by[r].append((n, w, int(v) if w in (0, 1, 5) else e.data[s : s + z].tobytes() if w == 2 else None))
    for i, r in enumerate(rows):
        assert is_message(r) == e.ok[i]
        if e.ok[i]:
            assert [(f.number, f.wire, f.value) for f in fields_of(r)] == by[i]
            assert b"".join(map(serialize_field, fields_of(r))) == r


@pytest.mark.parametrize("bad", [b"\x08", b"\x08\x80\x00", b"\x00\x01", b"\x0e\x01", b"\x0d\x01", b"\x12\x05ab", tag(1, 3), tag(1, 4), tag(1, 3) + tag(2, 4)])
def test_no_messages(bad):
    assert not is_message(bad) and not parse(pa.array([bad], pa.binary())).ok[0]


def test_overlong_is_parseable_only():
    assert is_message(b"\x08\x80\x00", canonical=False) and not is_message(b"\x08\x80\x00")


def test_typed_views_round_trip():
    specs = (
        Spec("a", 1, "uint64"), Spec("b", 2, "string"), Spec("c", 3, "sint32"), Spec("d", 4, "double"), Spec("e", 5, "bool"), Spec("f", 600, "int32"),
        Spec("g", 7, (Spec("x", 1, "int64"), Spec("y", 2, "bytes"))), Spec("h", 8, "uint32", repeated=True), Spec("i", 9, "float"), Spec("j", 10, "fixed32"),
    )
    rng = random.Random(3)
    rows = [
        {"a": rng.choice([None, 0, 2**62]), "b": rng.choice([None, "", "ü"]), "c": rng.choice([None, -5]), "d": rng.choice([None, float("-inf"), 0.1]), "e": rng.choice([None, True, False]), "f": rng.choice([None, -1]),
         "g": rng.choice([None, {"x": None, "y": b"q"}, {"x": -2, "y": None}]), "h": rng.choice([[], [1, 300]]), "i": rng.choice([None, 0.5]), "j": rng.choice([None, 4_000_000_000])}
        for _ in range(200)
    ]
    columns = [pa.array([r[s.name] for r in rows], s.arrow) for s in specs]
    out = decode_events(parse(encode_columns(columns, specs, len(rows))), specs, len(rows))
    for s, a, b in zip(specs, columns, out, strict=True):
        assert a.to_pylist() == b.to_pylist(), s.name


def test_absent_is_not_zero():
    spec = (Spec("a", 1, "uint64"),)
    assert [c.to_pylist() for c in decode_events(parse(pa.array([b"", b"\x08\x00"], pa.binary())), spec, 2)] == [[None, 0]]


THREE = varint(1, 5) + tag(2, 5) + b"abcd" + sub(3, b"xyz!")
CASES = [
    (THREE, "1;3", varint(1, 5) + sub(3, b"xyz!")),
    (THREE, "", b""),
    (THREE, "9", b""),
    (sub(1, varint(3, 9)), "1.2", sub(1, b"")),
    (sub(1, varint(2, 777)), "1?", b"\x0a\x00"),
    (sub(1, varint(2, 7) + varint(3, 9)), "1?;1.2", sub(1, varint(2, 7))),
    (group(1, varint(2, 7) + varint(3, 9)), "1?;1.2", group(1, varint(2, 7))),
    (group(1, varint(2, 7) + varint(3, 9)), "1.2", group(1, varint(2, 7))),
    (group(4, varint(3, 7)) + varint(3, 9), "3", varint(3, 9)),
    (varint(3, 9) + group(4, varint(3, 7)), "3", varint(3, 9)),
    (varint(1, 300) + tag(2, 1) + b"12345678" + tag(3, 5) + b"1234" + sub(4, b"\xff") + group(5, b""), "1?;2?;3?;4?;5?", varint(1, 0) + tag(2, 1) + bytes(8) + tag(3, 5) + bytes(4) + sub(4, b"") + group(5, b"")),
    (b"\xff\xfe\x01\x02", "1", b"\xff\xfe\x01\x02"),
    (varint(1, 5), "1.2", varint(1, 5)),
    (sub(1, varint(2, 7) + varint(3, 9)), "1;1.2", sub(1, varint(2, 7) + varint(3, 9))),
    (sub(1, varint(2, 7) + varint(3, 9)), "1.2;1", sub(1, varint(2, 7) + varint(3, 9))),
]


@pytest.mark.parametrize(("record", "projection", "expected"), CASES)
def test_projection_cases(record, projection, expected):
    p = Projection.parse(projection)
    assert p.apply(record) == expected
    assert p.apply_array(pa.array([record], pa.binary())).to_pylist() == [expected]


def test_projection_of_everything():
    assert Projection.all().apply(THREE) == THREE
    assert Projection(Field(())).is_all and not Projection(Field((), True)).is_all and not Projection().is_all


def test_top_level_projection_is_the_general_one():
    rng = random.Random(5)
    rows = [random_message(rng) if rng.random() < 0.8 else os.urandom(6) for _ in range(300)]
    for numbers in ((1,), (1, 7, 20), tuple(range(1, 40))):
        p = Projection(*[Field((n,)) for n in numbers])
        assert p.apply_array(pa.array(rows, pa.binary())).to_pylist() == [p.apply(r) for r in rows]


def test_copy_fields_keeps_groups_whole():
    data = group(1, varint(2, 7)) + varint(2, 1) + varint(1, 4)
    assert copy_fields(data, {1}) == group(1, varint(2, 7)) + varint(1, 4)
    assert copy_fields(data, {2}) == varint(2, 1)
    with pytest.raises(MessageError):
        copy_fields(tag(1, 4), {1})


def test_handlers():
    seen = []

    class First(FieldHandler):
        number = 2

        def on_varint(self, value):
            seen.append(("first", value))

    class Second(First):
        def on_varint(self, value):
            seen.append(("second", value))

    read_message(group(1, varint(2, 7)) + varint(2, 8), HandlerSet(First(), Second()))
    assert seen == [("first", 7), ("first", 8)]
    seen.clear()
    d = DynamicHandlers().on(2, V.VARINT, lambda v: seen.append("old")).on(2, V.VARINT, seen.append).on(1, V.START_GROUP, lambda: seen.append("group"))
    read_message(group(1, varint(2, 7)) + sub(2, b"x"), d)
    assert seen == ["group", 7]
    with pytest.raises(MessageError):
        read_message(b"\x08", HandlerSet())


def test_positions():
    p = Position.parse("64/3")
    assert p.numeric == 67 and str(p) == "64/3" and Position(64, 2) < p < Position(65, 0)
    for bad in ("", "1", "1/", "/1", "-1/2", "1/2/3", f"{2**64}/0", f"{2**64 - 1}/1"):
        with pytest.raises(ValueError):
            Position.parse(bad)


def test_groups_in_typed_columns():
    inner = (M.Spec("a", 1, "uint64"), M.Spec("s", 2, "string"))
    deep = (M.Spec("x", 1, "uint64"), M.Spec("again", 3, inner, group=True))
    specs = (M.Spec("id", 1, "uint64"), M.Spec("one", 3, deep, group=True), M.Spec("many", 4, inner, repeated=True, group=True), M.Spec("sub", 5, deep))
    rows = [
        {"id": 7, "one": {"x": 1, "again": {"a": 5, "s": "in"}}, "many": [{"a": 1, "s": None}, {"a": None, "s": "q"}], "sub": {"x": None, "again": {"a": 9, "s": None}}},
        {"id": 8, "one": None, "many": [], "sub": None},
        {"id": None, "one": {"x": None, "again": None}, "many": [{"a": None, "s": None}], "sub": {"x": 3, "again": None}},
    ]
    records = M.encode_columns([pa.array([r[s.name] for r in rows], s.arrow) for s in specs], specs, 3)
    got = M.decode_events(M.parse(records), specs, 3)
    assert [dict(zip((s.name for s in specs), values, strict=True)) for values in zip(*(c.to_pylist() for c in got), strict=True)] == rows


def test_writer_scopes_groups_and_raw_fields():
    w = M.MessageWriter()
    w.varint(1, 300).varint(2, -1).zigzag(3, -2).fixed32(4, 7).fixed64(5, 8).float32(6, 1.5).float64(7, -2.5).data(8, "text").data(9, b"\0\1")
    with w.submessage(10):
        w.varint(1, 1)
        with w.group(2):
            w.data(1, "deep")
        assert w.as_bytes().endswith(V.encode_u64(V.make_tag(2, V.END_GROUP)))
    with w.submessage(11):
        pass
    w.start_group(12).varint(1, 4).end_group(12).field(M.Field(13, V.BYTES, b"raw", 0, 0))
    raw = w.finish()
    assert M.is_message(raw) and len(w) == 0
    events = [(f.number, f.wire, f.value) for f in M.fields_of(raw)]
    assert events[:3] == [(1, V.VARINT, 300), (2, V.VARINT, 2**64 - 1), (3, V.VARINT, 3)] and events[-1] == (13, V.BYTES, b"raw")
    assert (10, V.BYTES, M.MessageWriter().varint(1, 1).start_group(2).data(1, "deep").end_group(2).finish()) in events and (11, V.BYTES, b"") in events
    open_one = M.MessageWriter()
    with pytest.raises(Exception, match="scopes"), open_one.submessage(1):
        open_one.finish()
    for bad in (0, 1 << 29):
        with pytest.raises(ValueError):
            M.MessageWriter().varint(bad, 1)


def test_projection_predicates():
    assert Projection.all().is_all and Projection(Field(())).is_all and not Projection(Field((), existence_only=True)).is_all
    p = Projection(Field((1, 2)), Field((3,), existence_only=True))
    assert not p.is_all and p.has_full_include and p.mentions(2) and p.mentions(3) and not p.mentions(4)
    assert not Projection(Field((3,), existence_only=True)).has_full_include
    assert Projection.all().add(Field((1,))).is_all
