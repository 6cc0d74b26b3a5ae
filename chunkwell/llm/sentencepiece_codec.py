"""Operator 10: SentencePiece encoding and decoding on the Tokenizers library.

:func:`parse_model` reads the model protobuf with a small wire parser: pieces with scores and
kinds, model type, normaliser and byte fallback.  :func:`build` makes a Tokenizers pipeline of it:
the normaliser (a precompiled character map, if there is one; white space removal; the marker
before the text and for each space), Unigram with the scores or BPE whose merges are the splits
of each piece ordered by its score, byte fallback, and the decoder.  Ids and decoded texts are
those of this pipeline; the SentencePiece library is only the check, ``parity`` says whether it agrees.

If no piece holds the marker behind another character and texts are not normalised, the marker
starts a new segment and a text's ids are the ids of its segments in order; then the distinct
segments are encoded by multithreaded ``encode_batch`` calls, checked against SentencePiece and
decoded once each, and a text's ids are gathered from theirs.  Otherwise whole texts are
encoded, checked and decoded.

One case is beyond Tokenizers: its Unigram matches control and byte pieces that stand in a text
literally, which SentencePiece never does.  Such texts (or segments) are encoded with these pieces
hidden, and their unknown characters are turned into bytes here.

``round_trip`` says whether decoding the ids gives the text back (for a model that normalises:
the normalised text; a marker that stands in the text itself comes back as a space).

Cases: a null text has null ids and 0 tokens; an empty text has no ids.  Texts are encoded
whole, in slices of bounded size; the cache of segments is bounded too.  Only ``doc_id`` and
``text`` are read.  Ids outside the model decode to nothing.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm.common import Numbers, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Segments kept between batches.
CACHE = 120_000
#: New segments that are encoded as one text.
GROUP = 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Spec:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value = varint()
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire} in a model file")
        if at > n:
            raise ValueError("truncated model file")
        yield tag >> 3, value


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    (score,) = struct.unpack("<f", v)
                elif k == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in fields(value):
                if k == 3:
                    spec.kind = v
                elif k == 24:
                    spec.suffix_marker = bool(v)
                elif k == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for k, v in fields(value):
                if k == 2:
                    spec.charsmap = v
                elif k == 3:
                    spec.dummy_prefix = bool(v)
                elif k == 4:
                    spec.trim_spaces = bool(v)
                elif k == 5:
                    spec.escape_spaces = bool(v)
    if spec.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {spec.kind}: only unigram and BPE models are known")
    if spec.suffix_marker or not spec.escape_spaces:
        raise ValueError("models with a marker suffix or without markers are not supported")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, best piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, score, kind in spec.pieces:
        if kind == NORMAL:
            ways = sorted((ids[p[:k]], ids[p[k:]], k) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
            found += [(-score, len(found) + n, p[:k], p[k:]) for n, (_, _, k) in enumerate(ways)]
    found.sort(key=lambda m: m[:2])
    return [(a, b) for _, _, a, b in found]


#: Before the pieces that no text may match (a noncharacter, so texts do not hold it).
HIDDEN = "\U0010ffff"
#: What SentencePiece decodes an unknown character to.
UNKNOWN_TEXT = " \u2047 "


def build(spec: Spec, prefix: bool | None = None, hidden: bool = False):
    """The Tokenizers pipeline of a model; ``prefix`` overrides whether a marker is put before a text.

    With ``hidden`` a unigram model matches no control or byte piece and has no byte fallback.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = _first(spec, UNKNOWN)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(HIDDEN + p if hidden and kind not in (NORMAL, USER) else p, s) for p, s, kind in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback and not hidden)
    else:
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges=merges(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.trim_spaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARKER))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    added = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER]
    if added:
        t.add_tokens(added)
    strip = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(spec.pieces[unknown][0], UNKNOWN_TEXT), decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


def _first(spec: Spec, kind: int) -> int:
    return next((i for i, p in enumerate(spec.pieces) if p[2] == kind), 0)


class Codec:
    """Encodes and decodes texts by the SentencePiece model in ``data``, on Tokenizers."""

    def __init__(self, data: bytes, threads: int = 2, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.spec = spec = parse_model(data)
        self.tokenizer = build(spec)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.most, self.threads = cache, threads
        plain = [p for p, _, kind in spec.pieces if kind in (NORMAL, USER)]
        #: Pieces that begin with the marker; by segments, each opens one.
        self._opens = np.array([p.startswith(MARKER) for p, _, _ in spec.pieces])
        self.by_segment = MARKER in plain and spec.dummy_prefix and not spec.trim_spaces and not spec.charsmap and not any(MARKER in p.lstrip(MARKER) for p in plain)
        self._silent = {i for i, (_, _, kind) in enumerate(spec.pieces) if kind == CONTROL}
        self._cut = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        self._literal = self._hidden = None
        if spec.kind == UNIGRAM and (odd := [p for p, _, kind in spec.pieces if kind not in (NORMAL, USER)]):
            self._literal = re.compile("|".join(map(re.escape, odd)))
            self._unknown = _first(spec, UNKNOWN)
            self._byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(spec.pieces) if kind == BYTE}
        self.forget()

    def forget(self) -> None:
        """Drop the segments."""
        self._at = Numbers()
        self._flat, self._starts = np.empty(0, np.int32), np.zeros(1, np.int64)
        self._differs, self._broken = np.empty(0, bool), np.empty(0, bool)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """Tokenizers' ids of texts."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self._literal is not None:
            for i in [i for i, t in enumerate(texts) if self._literal.search(t)]:
                got[i] = self._without_literals(texts[i])
        return got

    def _without_literals(self, text: str) -> list[int]:
        if self._hidden is None:
            self._hidden = build(self.spec, hidden=True)
        e, out = self._hidden.encode(text, add_special_tokens=False), []
        for i, token in zip(e.ids, e.tokens, strict=True):
            out += map(self._byte_ids.__getitem__, token.encode()) if i == self._unknown and self._byte_ids else (i,)
        return out

    def _segments(self, text: str) -> list[str]:
        """The segments without their first marker; one that is nothing else is a marker."""
        if not text:
            return []
        if "  " not in text and MARKER not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        cut = self._cut.findall(MARKER + text.replace(" ", MARKER))
        return [s if s == MARKER else s[1:].replace(MARKER, " ") for s in cut]

    def _learn(self, new: list[str]) -> None:
        """Encode, check and decode new segments, those without white space many in one text."""
        plain = [s for s in new if " " not in s and s not in ("", MARKER) and not (self._literal and self._literal.search(s))]
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        joined = [" ".join(g) for g in groups]
        got = self._encoded(joined)
        want = self.reference.encode(joined, num_threads=self.threads)
        back = self.decode_all(got)
        learnt: dict[str, tuple[list[int], bool, bool]] = {}
        alone = list(set(new).difference(plain))
        for group, text, g, w, t in zip(groups, joined, got, want, back, strict=True):
            ids = np.array(g, np.int32)
            starts = np.flatnonzero(self._opens[ids])
            if g == w and t == text and len(starts) == len(group):
                ends = [*starts[1:].tolist(), len(g)]
                learnt.update((s, (g[a:z], False, False)) for s, a, z in zip(group, starts.tolist(), ends, strict=True))
            else:
                alone += group
        if alone:
            learnt.update(self._learn_alone(alone))
        found = [learnt[s] for s in new]
        sizes = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
        self._flat = np.concatenate([self._flat, np.fromiter(itertools.chain.from_iterable(f[0] for f in found), np.int32, int(sizes.sum()))])
        self._differs = np.concatenate([self._differs, [f[1] for f in found]])
        self._broken = np.concatenate([self._broken, [f[2] for f in found]])

    def _learn_alone(self, new: list[str]):
        got = self._encoded(new)
        want = self.reference.encode(new, num_threads=self.threads)
        for k in [k for k, s in enumerate(new) if s == MARKER]:
            # both put no marker before nothing: a lone marker occurs inside texts only
            got[k] = build(self.spec, prefix=False).encode(" ", add_special_tokens=False).ids
            want[k] = self.reference.encode("a ")[len(self.reference.encode("a")) :]
        for s, g, w, b in zip(new, got, want, self.decode_all(got), strict=True):
            yield s, (g, g != w, b != ("" if s == MARKER else s))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """Ids of all texts in a row, the borders between texts, and parity and round trip of each text."""
        if not self.by_segment:
            return self._encode_whole(texts)
        cut = [self._segments(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        if len(self._at) > self.most:
            self.forget()
        known = len(self._at)
        rows = np.fromiter(map(self._at.__getitem__, flat), np.int64, len(flat))
        if len(self._at) > known:
            try:
                self._learn(list(itertools.islice(self._at, known, None)))
            except BaseException:
                self.forget()
                raise
        sizes = self._starts[rows + 1] - self._starts[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._flat[np.repeat(self._starts[rows] - (ends - sizes), sizes) + np.arange(total)]
        segments = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]).astype(np.int64)
        borders = np.concatenate([[0], ends])[segments]
        parity, whole = (_none_in(x[rows], segments) for x in (self._differs, self._broken))
        for i in [i for i, ok in enumerate(whole) if not ok]:  # parts that do not come back alone may do so together
            whole[i] = self.decode(ids[borders[i] : borders[i + 1]].tolist()) == self.expected(texts[i])
        return ids, borders, parity, whole

    def _encode_whole(self, texts):
        given = [i for i, t in enumerate(texts) if t is not None]
        got = self._encoded([texts[i] for i in given])
        want = self.reference.encode([texts[i] for i in given], num_threads=self.threads)
        back = self.decode_all(got)
        sizes, parity, whole = np.zeros(len(texts), np.int64), [True] * len(texts), [True] * len(texts)
        for i, g, w, b in zip(given, got, want, back, strict=True):
            sizes[i], parity[i], whole[i] = len(g), g == w, b == self.expected(texts[i])
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)]), parity, whole

    def encode(self, texts: list[str | None]) -> list[tuple[list[int] | None, bool]]:
        """(Tokenizers' ids, whether SentencePiece gives the same) of each text."""
        ids, borders, parity, _ = self.encode_flat(texts)
        return [(None if t is None else ids[s:e].tolist(), p) for t, s, e, p in zip(texts, borders[:-1].tolist(), borders[1:].tolist(), parity, strict=True)]

    def decode_all(self, many: list[list[int]]) -> list[str]:
        """The texts of lists of ids; invalid UTF-8 from byte pieces becomes U+FFFD, control pieces nothing."""
        if self._silent:
            many = [ids if self._silent.isdisjoint(ids) else [i for i in ids if i not in self._silent] for ids in many]
        return self.tokenizer.decode_batch(many, skip_special_tokens=False)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([ids])[0]

    def expected(self, text: str) -> str:
        """What decoding the ids of ``text`` has to give."""
        if not self.spec.charsmap and not self.spec.trim_spaces:
            return text.replace(MARKER, " ")
        n = self.tokenizer.normalizer.normalize_str(text).replace(MARKER, " ")
        return n[1:] if self.spec.dummy_prefix and n else n


def _none_in(flags: np.ndarray, borders: np.ndarray) -> list[bool]:
    """Whether no flag is set in each span between ``borders``."""
    n = np.concatenate([[0], np.cumsum(flags)])
    return (n[borders[1:]] == n[borders[:-1]]).tolist()


_CODECS: dict[tuple, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    """One codec for the worker's model; :func:`encode` drops its segments when the task ends."""
    key = (hash(data), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def load_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model's bytes; a path with a scheme is read by Spark, any other by the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def _forget() -> None:
    for codec in _CODECS.values():
        codec.forget()


def encode(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``doc_id, n_tokens, ids, parity, round_trip`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(doc_ids, texts):
        import pyarrow as pa

        ids, borders, parity, whole = _codec(shared.value, threads).encode_flat(texts)
        lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_()))
        return doc_ids, pa.array(np.diff(borders)), lists, parity, whole

    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean", _forget)


def decode(encoded: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared.value, threads)
        for b in batches:
            many = b.column(1).to_pylist()
            texts = [None if ids is None else t for ids, t in zip(many, codec.decode_all([ids or [] for ids in many]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
