"""Transposed chunks: messages taken apart into one buffer per field path, and a state machine for their order.

Which states a chunk visits follows from its transitions alone, so reading lists the visits first;
sizes, places and bytes of all fields are then worked out in NumPy, a buffer at a time.  A
projection marks the visits that it keeps by the nesting of submessages and groups; buckets in which no kept
field has a buffer are not decompressed.

Reading accepts any valid machine.  Writing makes a plain one: the states are the leaves of a
64-ary tree whose inner nodes do nothing, so that any of them is reached by a few transition
bytes, the frequent ones by one; a state that is always followed by the same one costs none.

Both directions work from the last field of the last record to the first, as the format demands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from chunkwell.functions import codecs as C
from chunkwell.functions import varint as V
from chunkwell.functions.errors import MalformedData
from chunkwell.functions.messages import Events, parse_spans, slices_of, spans_of
from chunkwell.sources.simple import binary_array

NO_OP, NON_PROTO, START_SUBMESSAGE, START_MESSAGE = 0, 1, 2, 3
#: Wire type that marks the end of a submessage among the states' tags.
SUBMESSAGE_END = 6
INLINE, INLINE_MAX = 10, 137
_FAN = 64
_DEPTH = 100


class _Cursor:
    """Reads through a section of bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self, bits: int = 32) -> int:
        value, self.at = V.decode_u64(self.data, self.at, bits)
        return value

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise MalformedData("end of a buffer")
        self.at += n
        return out

    @property
    def left(self) -> int:
        return len(self.data) - self.at


class _Buffers:
    """The buffers of a chunk, end to end in its buckets; a bucket is decompressed when a buffer of it is first asked for."""

    def __init__(self, data: bytes, at: int, packed: list[int], sizes: list[int], codec: int):
        self.data, self.codec, self.sizes = data, codec, sizes
        self.spans, self.opened = [], {}
        claims = []
        for s in packed:
            self.spans.append((at, at + s))
            claims.append(s if codec == C.NONE else V.decode_u64(data[at : min(at + s, at + 10)])[0])
            at += s
        self.places = _split(claims, sizes)

    def bucket(self, k: int) -> bytes:
        if k not in self.opened:
            a, z = self.spans[k]
            self.opened[k] = C.without_size(self.data[a:z], self.codec)
        return self.opened[k]

    def __getitem__(self, i: int) -> bytes:
        k, at = self.places[i]
        return self.bucket(k)[at : at + self.sizes[i]] if self.sizes[i] else b""


# What a state does.
_NOTHING, _RAW, _MESSAGE, _BEGIN, _END, _COPY, _VARINT, _FIXED, _STRING = range(9)


def _state(tag: int, header: _Cursor, subtypes: list[int], buffers: int) -> tuple[int, bytes, int, int]:
    """(action, tag bytes, buffer, size) of a state."""

    def buffer() -> int:
        i = header.varint()
        if i >= buffers:
            raise MalformedData("a state's buffer does not exist")
        return i

    if tag == NO_OP:
        return _NOTHING, b"", -1, 0
    if tag == NON_PROTO:
        return _RAW, b"", buffer(), 0
    if tag == START_SUBMESSAGE:
        return _BEGIN, b"", -1, 0
    if tag == START_MESSAGE:
        return _MESSAGE, b"", -1, 0
    wire = tag & 7
    if tag >> 3 == 0 or wire == 7:
        raise MalformedData(f"state with tag {tag}")
    if wire == SUBMESSAGE_END:
        return _END, V.encode_u64(tag - SUBMESSAGE_END + V.BYTES), -1, 0
    raw = V.encode_u64(tag)
    if wire == V.VARINT:
        kind = subtypes.pop(0)
        if kind > INLINE_MAX:
            raise MalformedData(f"varint subtype {kind}")
        return (_COPY, raw + bytes([kind - INLINE]), -1, 0) if kind >= INLINE else (_VARINT, raw, buffer(), kind + 1)
    if wire in (V.FIXED32, V.FIXED64):
        return _FIXED, raw, buffer(), 4 if wire == V.FIXED32 else 8
    if wire == V.BYTES:
        return _STRING, raw, buffer(), 0
    return _COPY, raw, -1, 0


def decode(data: bytes, records: int, decoded_size: int, projection=None) -> pa.Array:
    """The records of a chunk; with a projection, messages are narrowed to it and unneeded buckets stay packed."""
    if not data:
        raise MalformedData("empty transposed chunk")
    codec = C.codec_of(data[0])
    size, at = V.decode_u64(data, 1)
    if size > len(data) - at:
        raise MalformedData("header reaches behind the chunk")
    header, at = _Cursor(C.without_size(data[at : at + size], codec)), at + size
    n_buckets, n_buffers = header.varint(), header.varint()
    if n_buckets + n_buffers > header.left:
        raise MalformedData("more buckets and buffers than their sizes")
    packed = [header.varint(64) for _ in range(n_buckets)]
    sizes = [header.varint(64) for _ in range(n_buffers)]
    n_states = header.varint()
    if n_states > header.left:
        raise MalformedData("more states than their tags")
    tags = [header.varint() for _ in range(n_states)]
    following = [header.varint() for _ in range(n_states)]
    subtypes = list(header.take(sum(1 for t in tags if t >> 3 and t & 7 == V.VARINT)))

    if sum(packed) > len(data) - at:
        raise MalformedData("buckets reach behind the chunk")
    buffers = _Buffers(data, at, packed, sizes, codec)
    transitions = C.without_size(data[at + sum(packed) :], codec)

    states = [_state(t, header, subtypes, n_buffers) for t in tags]
    implicit = [f >= n_states for f in following]
    following = [f - n_states if i else f for f, i in zip(following, implicit, strict=True)]
    if any(f >= n_states for f in following):
        raise MalformedData("a state is followed by none that exists")
    first = header.varint()
    if first >= n_states:
        raise MalformedData("the first state does not exist")
    if header.left:
        raise MalformedData("data behind the header")
    _reject_loops(following, implicit)
    visits = _visits(following, implicit, first, transitions)
    if projection is not None and projection.is_all:
        projection = None
    return _assemble(tags, states, visits, buffers, records, decoded_size, projection)


def _split(claims: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """(bucket, place in it) of each buffer, by their sizes; each bucket is used up exactly, one after the other."""
    if not claims:
        if sizes:
            raise MalformedData("too few buckets")
        return []
    out, k, at = [], 0, 0
    for s in sizes:
        if s > claims[k] - at:
            raise MalformedData("a buffer does not fit its bucket")
        out.append((k, at))
        at += s
        while at == claims[k] and k + 1 < len(claims):
            k, at = k + 1, 0
    if k + 1 < len(claims) or at < claims[k]:
        raise MalformedData("buckets that no buffer uses")
    return out


def _reject_loops(following: list[int], implicit: list[bool]) -> None:
    """Raise if states that consume nothing lead in a circle."""
    seen = [0] * len(following)
    for start in range(len(following)):
        i, mark = start, start + 1
        while not seen[i]:
            seen[i] = mark
            if not implicit[i]:
                break
            i = following[i]
        else:
            if seen[i] == mark and implicit[i]:
                raise MalformedData("a loop of implicit states")


def _visits(following: list[int], implicit: list[bool], first: int, transitions: bytes) -> np.ndarray:
    """The states in the order in which the machine visits them.

    A visit goes on by itself from implicit states to the next one that is none; then a
    transition byte leads on by an offset, and up to three times more without one.
    """
    n = len(following)
    leads = [-1] * n  # where the state at the end of the implicit ones leads
    for start in range(n):
        way, i = [], start
        while implicit[i] and leads[i] < 0:
            way.append(i)
            i = following[i]
        end = leads[i] if leads[i] >= 0 else following[i]
        leads[i] = end
        for i in way:
            leads[i] = end
    arrivals = [first]
    add, at = arrivals.append, leads[first]
    try:
        for t in transitions:
            i = at + (t >> 2)
            add(i)
            at = leads[i]
            for _ in range(t & 3):
                add(at)
                at = leads[at]
    except IndexError:
        raise MalformedData("a transition leads nowhere") from None
    stops = np.array(arrivals, dtype=np.int64)
    if not any(implicit):
        return stops
    chains, sizes, begins = [], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.unique(stops).tolist():
        begins[i] = len(chains)
        chains.append(i)
        k = i
        while implicit[k]:
            k = following[k]
            chains.append(k)
        sizes[i] = len(chains) - begins[i]
    size = sizes[stops]
    ends = np.cumsum(size)
    return np.array(chains, dtype=np.int64)[np.repeat(begins[stops] - (ends - size), size) + np.arange(ends[-1])]


def _string_ends(data: bytes, many: int) -> np.ndarray:
    """Where each of ``many`` length-prefixed strings ends."""
    ends, p, n = np.zeros(many, dtype=np.int64), 0, len(data)
    for k in range(many):
        if p >= n:
            raise MalformedData("end of a buffer")
        size = data[p]
        if size < 128:
            p += size + 1
        else:
            size, p = V.decode_u64(data, p, 32)
            p += size
        ends[k] = p
    if p > n:
        raise MalformedData("end of a buffer")
    return ends


def _varint_values(data: bytes, many: int) -> np.ndarray:
    cursor = _Cursor(data)
    return np.array([cursor.varint() for _ in range(many)], dtype=np.int64)


def _assemble(tags, states, visits: np.ndarray, buffers: _Buffers, records: int, decoded_size: int, projection) -> pa.Array:
    """The records that a sequence of visits spells, the last one first."""
    n = len(states)
    actions = np.array([s[0] for s in states], dtype=np.int8)
    visits = visits[actions[visits] != _NOTHING]
    act = actions[visits]
    edge = (act == _MESSAGE) | (act == _RAW)
    if int(edge.sum()) != records or (len(act) and not edge[-1]):
        raise MalformedData("another number of records than the header has, or the machine stops within one")
    depth = np.cumsum((act == _END).astype(np.int32) - (act == _BEGIN))
    if len(depth) and (depth.min() < 0 or depth[edge].any()):
        raise MalformedData("submessages do not open and close within their record")
    # of a submessage, the tag stands with its end and is written at its beginning
    names = visits.copy()
    deepest = int(depth.max(initial=0))
    pairs = []
    for level in range(deepest, 0, -1):
        ends, begins = np.flatnonzero((act == _END) & (depth == level)), np.flatnonzero((act == _BEGIN) & (depth == level - 1))
        names[begins] = visits[ends]
        pairs.append((ends, begins))

    heads = [s[1] for s in states]
    if projection is None:
        keep = np.ones(len(visits), dtype=bool)
    else:
        keep, presence = _kept(np.array(tags), act, visits, projection)
        heads = [*heads, *(_presence(t, s) for t, s in zip(tags, states, strict=True))]
        names[presence] += n
    widths = np.array([len(h) for h in heads], dtype=np.int64)
    table = np.zeros((len(heads), max(1, int(widths.max(initial=1)))), dtype=np.uint8)
    for i, h in enumerate(heads):
        table[i, : len(h)] = np.frombuffer(h, dtype=np.uint8)

    # what each visit takes out of its buffer
    takes = np.isin(act, (_VARINT, _FIXED, _STRING, _RAW))
    wanted = takes & keep & (names < n)
    of = np.array([s[2] for s in states], dtype=np.int64)[visits]
    start, size = np.zeros(len(visits), dtype=np.int64), np.zeros(len(visits), dtype=np.int64)
    step = np.array([s[3] for s in states], dtype=np.int64)[visits]
    raw = np.flatnonzero(act == _RAW)
    if len(raw):
        step[raw] = _varint_values(buffers[len(buffers.sizes) - 1], len(raw))
    chosen, base = [], 0
    for b in np.unique(of[wanted]).tolist():
        at = np.flatnonzero(takes & (of == b))
        data = buffers[b]
        strings = act[at] == _STRING
        if strings.all():
            ends = _string_ends(data, len(at))
        elif strings.any():
            ends, p = np.zeros(len(at), dtype=np.int64), 0
            for k, is_string in enumerate(strings.tolist()):
                p += int(_string_ends(data[p:], 1)[0]) if is_string else int(step[at[k]])
                ends[k] = p
        else:
            ends = np.cumsum(step[at])
        if ends[-1] > len(data):
            raise MalformedData("end of a buffer")
        size[at] = np.diff(ends, prepend=0)
        start[at] = base + ends - size[at]
        chosen.append(np.frombuffer(data, dtype=np.uint8))
        base += len(data)
    start, size = start * wanted, size * wanted

    named = keep & ~edge & (act != _END)
    piece = np.where(named, widths[names], 0) + size
    lengths = np.zeros(len(visits), dtype=np.int64)
    for ends, begins in pairs:
        before = np.cumsum(piece) - piece
        lengths[begins] = before[begins] - before[ends]
        piece[begins] += _varint_widths(lengths[begins]) * keep[begins]
    until = np.cumsum(piece)
    total = int(until[-1]) if len(until) else 0
    if projection is None and total != decoded_size:
        raise MalformedData("records do not fill their chunk")
    out = np.zeros(total, dtype=np.uint8)
    place = total - until
    width = np.where(named, widths[names], 0)
    for j in range(table.shape[1]):
        at = np.flatnonzero(width > j)
        out[place[at] + j] = table[names[at], j]
    place = place + width
    begins = np.flatnonzero((act == _BEGIN) & keep)
    if len(begins):
        raw_lengths, many = V.encode_many(lengths[begins])
        for j in range(int(many.max())):
            has = many > j
            out[place[begins[has]] + j] = raw_lengths[has, j]
    at = np.flatnonzero(size)
    if len(at):
        source = np.concatenate(chosen)
        ends = np.cumsum(size[at])
        inner = np.arange(int(ends[-1]))
        out[np.repeat(place[at] - (ends - size[at]), size[at]) + inner] = source[np.repeat(start[at] - (ends - size[at]), size[at]) + inner]
        varints = at[act[at] == _VARINT]
        for j in range(int(size[varints].max(initial=1)) - 1):
            out[place[varints[size[varints] > j + 1]] + j] |= 128
    return binary_array(np.concatenate([[0], np.cumsum(np.diff(until[edge], prepend=0)[::-1])]).astype(np.int64), out.tobytes())


def _varint_widths(v: np.ndarray) -> np.ndarray:
    out = np.ones(len(v), dtype=np.int64)
    for i in range(1, 5):
        out += v >= 1 << (7 * i)
    return out


def _presence(tag: int, state: tuple) -> bytes:
    """What an existence-only projection leaves of a state: its tag and a zero of its type; ends of groups stay."""
    wire = tag & 7
    if wire == SUBMESSAGE_END or tag >> 3 == 0 or wire in (V.START_GROUP, V.END_GROUP):
        return state[1]
    return V.encode_u64(tag) + bytes({V.FIXED32: 4, V.FIXED64: 8}.get(wire, 1))


#: Of what a field stands in: all of it is kept, nothing of it is; else the number of a subtree of the projection.
_WHOLE, _GONE = -1, -2


def _kept(tags: np.ndarray, act: np.ndarray, visits: np.ndarray, projection) -> tuple[np.ndarray, np.ndarray]:
    """(whether a visit's bytes are kept, whether only its presence is), by the projection's tree."""
    from chunkwell.operators.projection import EXISTENCE, FULL

    trees: list[dict] = [projection.tree()]
    tag = tags[visits]
    number, group = tag >> 3, (act == _COPY) * (tag & 7)
    opens, closes = (act == _END) | (group == V.END_GROUP), (act == _BEGIN) | (group == V.START_GROUP)
    change = opens.astype(np.int32) - closes
    level = np.cumsum(change) - change - closes
    edge = (act == _MESSAGE) | (act == _RAW)
    if len(level) and (level.min() < 0 or level[edge].any()):
        raise MalformedData("groups do not open and close within their record")
    keep, presence = edge.copy(), np.zeros(len(visits), dtype=bool)
    below, places = np.full(len(visits), _GONE, dtype=np.int64), np.arange(len(visits))
    outer = None  # the opening visit that is last at each place, one level up
    for depth in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero((level == depth) & ~closes & ~edge)
        holds = np.zeros(len(at), dtype=np.int64) if outer is None else below[outer[at]]
        keys, which = np.unique((holds - _GONE) << 30 | number[at] << 1 | opens[at], return_inverse=True)
        kinds = []
        for key in keys.tolist():
            held, num, opening = (key >> 30) + _GONE, key >> 1 & 0x1FFFFFFF, key & 1
            kind, subtree = (FULL, None) if held == _WHOLE else trees[held].get(num, (None, None)) if held != _GONE else (None, None)
            if kind is None:
                kinds.append((False, False, _GONE))
            elif kind == EXISTENCE:
                kinds.append((True, True, _GONE))
            elif kind == FULL or not opening:
                kinds.append((True, False, _WHOLE))
            else:
                trees.append(subtree)
                kinds.append((True, False, len(trees) - 1))
        if kinds:
            found = np.array(kinds, dtype=np.int64)[which]
            keep[at], presence[at], below[at] = found[:, 0], found[:, 1], found[:, 2]
        outer = np.maximum.accumulate(np.where(opens & (level == depth), places, -1))
        ends = np.flatnonzero(closes & (level == depth))
        keep[ends], presence[ends] = keep[outer[ends]], presence[outer[ends]]
    presence &= (act != _BEGIN) & (act != _END)  # a submessage's presence is its tag and length 0
    return keep, presence


# Writing.


@dataclass
class _Level:
    """The fields of one depth of submessages, by record and in order, and where each stands among all steps."""

    events: Events
    scope: np.ndarray
    sub: np.ndarray
    below: _Level | None = None
    total: np.ndarray | None = None
    place: np.ndarray | None = None


class _Scopes:
    """Numbers for the paths of submessages and groups (a group has a negative field number)."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def inner(self, scope: int, number: int) -> int:
        return self.known.setdefault((scope, number), len(self.known) + 1)

    def of_groups(self, e: Events, outer: np.ndarray) -> np.ndarray:
        """The scope of each field, of which some stand in groups; those of a group's ends are the outer one."""
        scope = outer.copy()
        for r in np.unique(e.record[(e.depth > 0) | (e.wire == V.START_GROUP)]).tolist():
            lo, hi = np.searchsorted(e.record, (r, r + 1))
            way = [int(outer[lo])]
            for k in range(lo, hi):
                if e.wire[k] == V.END_GROUP:
                    way.pop()
                scope[k] = way[-1]
                if e.wire[k] == V.START_GROUP:
                    way.append(self.inner(way[-1], -int(e.number[k])))
        return scope


def _levels(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, scope: np.ndarray, depth: np.ndarray, scopes: _Scopes) -> _Level:
    """The fields of the messages at ``[begin, end)`` and, below them, of the submessages that they hold."""
    e = parse_spans(buf, begin, end)
    own, deep = scope[e.record], depth[e.record] + e.depth
    if len(e.depth) and ((e.depth > 0).any() or (e.wire == V.START_GROUP).any()):
        own = scopes.of_groups(e, own)
    level = _Level(e, own, np.zeros(len(e.number), dtype=bool))
    maybe = np.flatnonzero((e.wire == V.BYTES) & (e.size > 0) & (deep < _DEPTH))
    if len(maybe):
        start, size = e.start[maybe], e.size[maybe]
        pairs, which = np.unique(own[maybe] << 32 | e.number[maybe], return_inverse=True)
        inner = np.array([scopes.inner(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], dtype=np.int64)[which]
        # a message begins with a tag of a known wire type and a number: most strings end here
        first = buf[start]
        likely = (first >= 8) & ((first & 7) <= 5)
        maybe, start, size, inner = maybe[likely], start[likely], size[likely], inner[likely]
        fine = parse_spans(buf, start, start + size).ok if len(maybe) else np.zeros(0, dtype=bool)
        maybe, start, size, inner = maybe[fine], start[fine], size[fine], inner[fine]
        if len(maybe):
            level.sub[maybe] = True
            level.below = _levels(buf, start, start + size, inner, deep[maybe] + 1, scopes)
    return level


def _sizes(level: _Level) -> np.ndarray:
    """Steps of each field: one, or of a submessage its two ends and what is between them."""
    n = np.ones(len(level.sub), dtype=np.int64)
    if level.below is not None:
        at = np.flatnonzero(level.sub)
        inside = np.bincount(level.below.events.record, weights=_sizes(level.below), minlength=len(at)).astype(np.int64)
        n[at] = 2 + inside
    level.total = n
    return n


def _set_places(level: _Level, base: np.ndarray) -> None:
    """Places of the fields, forward, where those of record ``r`` begin at ``base[r]``."""
    before = np.cumsum(level.total) - level.total
    r = level.events.record
    first = np.searchsorted(r, np.arange(len(base)))
    level.place = base[r] + before - before[np.minimum(first, len(before) - 1)][r] if len(r) else base[:0]
    if level.below is not None:
        _set_places(level.below, level.place[level.sub] + 1)


class _Parts:
    """Records taken apart: the steps in decoding order (scope, tag, kind) and the buffers by scope and tag."""

    def __init__(self, records: pa.Array):
        buf, begin, end = spans_of(records)
        root = _levels(buf, begin, end, np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64), _Scopes())
        ok = root.events.ok
        inside = np.bincount(root.events.record, weights=_sizes(root), minlength=len(begin)).astype(np.int64)
        ends = np.cumsum(inside + 1)
        marks = ends - inside - 1
        _set_places(root, marks + 1)
        n = int(ends[-1]) if len(ends) else 0
        self.scope, self.tag, self.kind = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.tag[marks] = np.where(ok, START_MESSAGE, NON_PROTO)
        self.buffers: dict[tuple[int, int], bytes] = {}
        values: list[tuple[np.ndarray, ...]] = []  # place, scope, tag, start in buf, size
        level: _Level | None = root
        while level is not None:
            e, at = level.events, level.place
            tag = e.number << 3 | e.wire
            leaf = ~level.sub
            self.scope[at[leaf]], self.tag[at[leaf]] = level.scope[leaf], tag[leaf]
            self.tag[at[level.sub]] = START_SUBMESSAGE
            last = at[level.sub] + level.total[level.sub] - 1
            self.scope[last], self.tag[last] = level.scope[level.sub], tag[level.sub] - V.BYTES + SUBMESSAGE_END
            small = leaf & (e.wire == V.VARINT) & (e.value <= 3)
            self.kind[at[small]] = INLINE + e.value[small].astype(np.int64)
            k = np.flatnonzero(leaf & (e.wire == V.VARINT) & (e.value > 3))
            raw, width = V.encode_many(e.value[k])
            self.kind[at[k]] = width - 1
            values.append((at[k], level.scope[k], tag[k], raw & np.uint8(127), width))
            for wire, size in ((V.FIXED32, 4), (V.FIXED64, 8)):
                k = np.flatnonzero(e.wire == wire)
                values.append((at[k], level.scope[k], tag[k], np.ascontiguousarray(e.value[k].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size], np.full(len(k), size)))
            k = np.flatnonzero(leaf & (e.wire == V.BYTES))
            self._strings(at[k], level.scope[k], tag[k], buf, e.start[k], e.size[k])
            level = level.below
        self._numbers(values)
        other = np.flatnonzero(~ok)[::-1]
        if len(other):
            _, data = slices_of(buf, begin[other], (end - begin)[other])
            self.buffers[0, NON_PROTO] = data
        self.lengths = V.join_varints((end - begin)[other].astype(np.uint64))
        self.scope, self.tag, self.kind = self.scope[::-1], self.tag[::-1], self.kind[::-1]

    def _numbers(self, values) -> None:
        """Fill the buffers of varints and fixed numbers, each from the last field to the first."""
        for place, scope, tag, raw, width in values:
            if not len(place):
                continue
            for key, k in _by_path(place, scope, tag):
                part = raw[k]
                self._add(key, part[np.arange(part.shape[1])[None, :] < width[k][:, None]].tobytes())

    def _strings(self, place, scope, tag, buf, start, size) -> None:
        if not len(place):
            return
        start, size = start - _varint_widths(size), size + _varint_widths(size)  # the length stands before the bytes
        for key, k in _by_path(place, scope, tag):
            self._add(key, slices_of(buf, start[k], size[k])[1])

    def _add(self, key, data: bytes) -> None:
        if key in self.buffers:
            raise AssertionError(f"two depths share the path {key}")
        self.buffers[key] = data


def _by_path(place: np.ndarray, scope: np.ndarray, tag: np.ndarray):
    """(scope and tag, the fields that have them from the last to the first)."""
    order = np.lexsort((-place, scope << 32 | tag))
    keys = (scope << 32 | tag)[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield (int(keys[a]) >> 32, int(keys[a]) & 0xFFFFFFFF), order[a:z]


def _reads(step: tuple) -> bool:
    tag, kind = step[1], step[2]
    if tag == NON_PROTO:
        return True
    wire = tag & 7
    return tag >> 3 > 0 and (wire in (V.FIXED32, V.FIXED64, V.BYTES) or (wire == V.VARINT and kind < INLINE))


def _places(n: int) -> tuple[list[int | None], list[int], list[tuple[int, ...]]]:
    """A tree of blocks of 64 for ``n`` states: (state or None for an inner node, the block an inner node leads to, offsets to each state)."""
    slots: list[int | None] = []
    leads: list[int] = []
    paths: list[tuple[int, ...]] = [()] * n

    def block(start_state: int, count: int, prefix: tuple[int, ...]) -> None:
        inner, room = 0, 1
        while True:
            inner = 0
            while inner < _FAN and (_FAN - inner) + inner * _FAN**room < count:
                inner += 1
            if (_FAN - inner) + inner * _FAN**room >= count:
                break
            room += 1
        base = len(slots)
        direct = min(count, _FAN - inner)
        for k in range(direct):
            slots.append(start_state + k)
            leads.append(0)
            paths[start_state + k] = (*prefix, k)
        nodes = list(range(len(slots), len(slots) + inner))
        slots.extend([None] * inner)
        leads.extend([0] * inner)
        rest, state = count - direct, start_state + direct
        for node in nodes:
            share = min(rest, _FAN**room)
            if not share:
                break
            leads[node] = len(slots)
            block(state, share, (*prefix, node - base))
            state, rest = state + share, rest - share

    block(0, n, ())
    return slots, leads, paths


def encode(records: list[bytes] | pa.Array, codec: int = C.NONE, level: int | None = None, window_log: int | None = None, bucket_size: int | None = None) -> bytes:
    """The data of a transposed chunk of ``records``."""
    parts = _Parts(records if isinstance(records, pa.Array) else pa.array(records, pa.binary()))
    order = sorted(parts.buffers, key=lambda k: (k[1] & 7, -len(parts.buffers[k]), k))
    place = {k: i for i, k in enumerate(order)}
    blobs = [parts.buffers[k] for k in order] + ([parts.lengths] if parts.lengths else [])
    buckets = _bucketed(blobs, codec, bucket_size)

    # one number for each (scope, tag, kind); kinds are under 256 and tags under 2^32
    keys, walk, counts = np.unique(parts.scope << 40 | parts.tag << 8 | parts.kind, return_inverse=True, return_counts=True) if len(parts.tag) else (np.empty(0, np.int64),) * 3
    
    rank = np.argsort(-counts, kind="stable")
    number = np.empty(len(rank), dtype=np.int64)
    number[rank] = np.arange(len(rank))
    walk = number[walk]
    real = [(k >> 40, k >> 8 & 0xFFFFFFFF, k & 255) for k in keys[rank].tolist()]
    last = int(walk[-1]) if len(walk) else -1
    links = np.unique(walk[:-1] * max(1, len(real)) + walk[1:])
    after, following = links // max(1, len(real)), links % max(1, len(real))
    ways = np.bincount(after, minlength=max(1, len(real)))
    sole = {a: b for a, b in zip(after.tolist(), following.tolist(), strict=True) if ways[a] == 1 and a != last}

    slots, leads, paths = _places(max(1, len(real)))
    if not real:
        real, slots = [(0, NO_OP, 0)], [0]
    at_slot = {s: k for k, s in enumerate(slots) if s is not None}
    n = len(slots)
    tags = [NO_OP if s is None else real[s][1] for s in slots]
    following = [leads[k] if s is None else (n + at_slot[sole[s]] if s in sole else 0) for k, s in enumerate(slots)]
    used = [real[s] for s in slots if s is not None]
    subtypes = bytes(s[2] for s in used if s[1] >> 3 and s[1] & 7 == V.VARINT)
    indices = [place[s[:2]] for s in used if _reads(s)]

    free = np.ones(len(real), dtype=bool)
    free[list(sole)] = False
    steps = walk[1:][free[walk[:-1]]]
    sizes = np.array([len(p) for p in paths], dtype=np.int64)
    flat, begins = np.array([o for p in paths for o in p], dtype=np.int64), np.cumsum(sizes) - sizes
    size = sizes[steps]
    ends = np.cumsum(size)
    offsets = flat[np.repeat(begins[steps] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    transitions = _packed_transitions(offsets)
    packed = [C.with_size(b, codec, level, window_log) for b in buckets]
    head = V.join_varints(np.array([len(buckets), len(blobs), *map(len, packed), *map(len, blobs), n, *tags, *following], dtype=np.uint64))
    head += subtypes + V.join_varints(np.array([*indices, at_slot[int(walk[0])] if len(walk) else 0], dtype=np.uint64))
    blob = C.with_size(head, codec, level, window_log)
    return b"".join((bytes([codec]), V.encode_u64(len(blob)), blob, *packed, C.with_size(transitions, codec, level, window_log)))


def _packed_transitions(offsets: np.ndarray) -> bytes:
    """A byte for each offset and up to three zeros that follow it."""
    n = len(offsets)
    if not n:
        return b""
    at = np.arange(n)
    run = at - np.maximum.accumulate(np.where((offsets != 0) | (at == 0), at, 0))  # place since the last offset that is not zero
    heads = np.flatnonzero(run % 4 == 0)
    many = np.diff(np.append(heads, n)) - 1
    return (offsets[heads] << 2 | many).astype(np.uint8).tobytes()


def _bucketed(blobs: list[bytes], codec: int, bucket_size: int | None) -> list[bytes]:
    """Buffers joined into buckets of about ``bucket_size``; one bucket without compression."""
    blobs = [b for b in blobs if b]
    if not blobs:
        return []
    if codec == C.NONE or bucket_size is None:
        return [b"".join(blobs)]
    out, held, size = [], [], 0
    for b in blobs:
        if held and size + len(b) / 2 > bucket_size:
            out.append(b"".join(held))
            held, size = [], 0
        held.append(b)
        size += len(b)
    return [*out, b"".join(held)]
