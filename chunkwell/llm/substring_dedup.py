"""Operator 2: substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the 16 bytes before it alone, so texts that share a passage
cut it at the same places, whatever stands before: an insertion moves no later cut.  A place is
a cut where no hash of the 16 places before and behind it is less (every 33 bytes on average, and
seldom much more, unlike cuts at a fixed pattern of bits; text that repeats itself within 16
bytes is cut once a period); the cut moves on to the next white space if that is within 64 bytes,
so that chunks are whole words.

Every two neighbouring chunks have a 64-bit digest, their link.  A link knows its first occurrence:
the smallest ``doc_id`` that has it, and the place there.  A passage is removed if its links have
their first occurrences in one other document in the same succession (one link may be
missing between two that fit, since those hold both of its chunks) and it has ``MIN_WORDS`` words or more.
A stretch of equal chunks, such as one word again and again, has a link for each power of two up
to its length besides, and goes in pieces of the longest such power that another document has.
So every removed span stands, as a whole, in a document with a smaller ``doc_id``; a common phrase, or
parts that stand in different documents, remove nothing, and first occurrences stay.  With
``within``, what follows itself in the same succession earlier in its own document goes too.

A link goes through the shuffle once for each document that has it, is combined before that,
and meets its first occurrence by an equi-join that adaptive execution can split; no list of
a link's documents is built.

Cases: a null text stays null, an empty one empty.  A row without ``doc_id`` neither takes nor
gives a passage to others.  Rows with the same ``doc_id`` count as one document for
others, and if their texts differ, the places of any of them may count.  A text of repeats alone
becomes empty; its row stays.  Other columns are kept and may have any name not starting with ``__sub_``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.llm.common import give_back, map_texts, slices, store

WINDOW = 16
#: Places on either side that a cut's hash has to undercut; a power of two.
REACH = 16
SNAP = 64
MIN_WORDS = 15
_GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 16, size=256, dtype=np.uint16)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def chunks(texts: list[str | None]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each text: its bytes, the chunk borders (0 .. length), and the words that start before each border."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] = sum of GEAR[data[i - j]] << j over 2 * step bytes
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h, step = more, 2 * step
    at = _minima(h)
    white = _WHITE[data]
    text_of = np.searchsorted(starts, at, side="right") - 1
    # neither the hash's window nor the minimum's reaches across a text's ends
    ok = (at - starts[text_of] >= WINDOW - 1 + REACH) & (at + REACH < starts[text_of + 1])
    at, text_of = at[ok], text_of[ok]
    spaces = np.flatnonzero(white)
    following = np.searchsorted(spaces, at)
    snapped = np.append(spaces, len(data) + SNAP + 1)[following] if len(spaces) else np.full(len(at), len(data) + SNAP + 1)
    near = snapped - at <= SNAP
    cut = np.where(near, snapped, at) + 1
    inside = ~near & (cut < len(data))
    while inside.any():  # never inside a character
        inside[inside] = (data[cut[inside]] & 0xC0) == 0x80
        cut = cut + inside
        inside &= cut < len(data)
    cut, text_of = cut[cut < starts[text_of + 1]], text_of[cut < starts[text_of + 1]]
    new = ~white
    new[1:] &= white[:-1]
    first = starts[:-1][starts[:-1] < len(data)]
    new[first] = ~white[first]
    words = np.concatenate([[0], np.cumsum(new)])
    lo, hi = np.searchsorted(text_of, np.arange(len(raw))), np.searchsorted(text_of, np.arange(len(raw)), side="right")
    out = []
    for i, r in enumerate(raw):
        if not r:
            out.append((r, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)))
            continue
        borders = np.unique(np.concatenate([[starts[i]], cut[lo[i] : hi[i]], [starts[i + 1]]]))
        out.append((r, borders - starts[i], words[borders] - words[starts[i]]))
    return out


def _minima(h: np.ndarray) -> np.ndarray:
    """Places whose value is not above any of the ``REACH`` before and behind them."""
    n = len(h)
    if n <= 2 * REACH:
        return np.empty(0, dtype=np.int64)
    low, step = h, 1
    while step < REACH:  # low[i] = min(h[i : i + step])
        low, step = np.minimum(low[: len(low) - step], low[step:]), 2 * step
    middle = h[REACH : n - REACH]
    before, behind = low[: n - 2 * REACH], low[REACH + 1 : n - REACH + 1]
    return np.flatnonzero((middle <= before) & (middle <= behind)) + REACH


def digests(raw: bytes, borders: np.ndarray) -> list[int]:
    """64-bit digest of each chunk, as a signed number."""
    b, d = borders.tolist(), xxhash.xxh3_64_intdigest
    return [x - (1 << 64) if (x := d(raw[s:e])) >> 63 else x for s, e in zip(b, b[1:], strict=False)]


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def links(raw: bytes, borders: np.ndarray) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """A signed 64-bit digest of each two neighbouring chunks; (first chunk, last + 1, links by power) of stretches."""
    d = np.array(digests(raw, borders), dtype=np.int64).view(np.uint64)
    pairs = _mixed((d[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ d[1:]).view(np.int64).tolist()
    ends = np.flatnonzero(np.concatenate([d[1:] != d[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    stretches = []
    for k in np.flatnonzero(ends - starts >= 4).tolist():
        powers = np.arange(2, int(ends[k] - starts[k]).bit_length(), dtype=np.uint64)
        stretches.append((int(starts[k]), int(ends[k]), _mixed(d[starts[k]] + powers * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).tolist()))
    return pairs, stretches


def _emit(ids, texts):
    out: tuple[list, list, list] = ([], [], [])
    for i, (raw, borders, _) in zip(ids, chunks(texts), strict=True):
        pairs, stretches = links(raw, borders)
        first = dict(zip(reversed(pairs), range(len(pairs) - 1, -1, -1), strict=True))
        for start, _, powers in stretches:
            for link in powers:
                first.setdefault(link, start)
        out[0].extend(first)
        out[1].extend([i] * len(first))
        out[2].extend(first.values())
    return out


def repeated_runs(found, words: np.ndarray, elsewhere: dict, min_words: int = MIN_WORDS, within: bool = False) -> list[tuple[int, int]]:
    """(first chunk, last + 1) of each span to remove, in order and apart; ``elsewhere``: the (document, place) of links."""
    pairs, stretches = found
    here: dict[int, int] = {}
    open_at: dict[tuple, list[int]] = {}  # document and shift of the places: first link, last link
    done: list = []
    for k, link in enumerate(pairs) if elsewhere or within else ():
        sources = [(None, here[link] - k)] if within and link in here else []
        if link in elsewhere:
            document, at = elsewhere[link]
            sources.append((document, at - k))
        here[link] = k
        for source in sources:
            run = open_at.get(source)
            if run is not None and k - run[1] <= 2:
                run[1] = k
            else:
                open_at[source] = run = [k, k]
                done.append(run)
    spans = [(a, z + 2) for a, z in done]
    for start, end, powers in stretches:
        size = max((1 << j for j, link in enumerate(powers, 2) if link in elsewhere), default=0)
        spans += [(max(start, z - size), z) for z in range(end, start, -size)] if size else []
    out, end = [], 0
    for a, z in sorted((a, z) for a, z in spans if words[z] - words[a] >= min_words):
        if z > end:  # what another source has already given is not removed twice
            out.append((max(a, end), z))
            end = z
    return out


def clean(text: str | None, chunked, elsewhere: dict, min_words: int = MIN_WORDS, within: bool = False) -> tuple[str | None, list[dict]]:
    """The text without its repeats, and the removed spans in code points."""
    if not text:
        return text, []
    raw, borders, words = chunked
    runs = repeated_runs(links(raw, borders), words, elsewhere, min_words, within)
    if not runs:
        return text, []
    kept, spans, at, chars = [], [], 0, 0
    for a, z in runs:
        s, e = int(borders[a]), int(borders[z])
        before, gone = raw[at:s].decode("utf-8", "surrogatepass"), raw[s:e].decode("utf-8", "surrogatepass")
        chars += len(before)
        kept.append(before)
        spans.append({"start": chars, "end": chars + len(gone), "words": int(words[z] - words[a])})
        chars, at = chars + len(gone), e
    return "".join(kept) + raw[at:].decode("utf-8", "surrogatepass"), spans


def _elsewhere(found) -> dict:
    """The (document, place) of each link, of an Arrow list of structs."""
    if not found.is_valid or not len(found):
        return {}
    link, first, at = (c.to_pylist() for c in found.values.flatten())
    return dict(zip(link, zip(first, at, strict=True), strict=True))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())]))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``n_chars`` (if there is one) renewed, and ``__sub_removed`` (spans)."""
    emitted = map_texts(docs.where("doc_id is not null and text is not null"), ["doc_id", "text"], _emit, "link long, doc_id long, place int")
    emitted, _ = store(emitted, "substring-links")
    firsts = emitted.groupBy("link").agg(F.min("doc_id").alias("first"), F.min_by("place", "doc_id").alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("link").alias("l2"), "first", "at")
    firsts, _ = store(firsts, "substring-firsts")  # a join with a stored side can be split where a link is in very many documents
    repeats = emitted.select("link", "doc_id").join(firsts, F.col("link") == F.col("l2")).where(F.col("doc_id") > F.col("first"))
    by_doc = repeats.groupBy(F.col("doc_id").alias("__sub_id")).agg(F.collect_list(F.struct("link", "first", "at")).alias("__sub_links"))
    joined = docs.join(by_doc, docs["doc_id"] == by_doc["__sub_id"], "left").drop("__sub_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("__sub_removed", SPANS)])
    at_text, at_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "words")]))
        for batch in batches:
            for lo, hi in slices(batch.column(at_text)):
                b = batch.slice(lo, hi - lo)
                columns = list(b.columns)
                texts = columns[at_text].to_pylist()
                done = [clean(t, c, _elsewhere(x), min_words, within) for t, c, x in zip(texts, chunks(texts), columns.pop(), strict=True)]
                columns[at_text] = pa.array([t for t, _ in done], type=b.schema.field(at_text).type)
                if at_chars is not None:
                    kind = b.schema.field(at_chars).type
                    columns[at_chars] = pa.array([len(t) if s else old for (t, s), old in zip(done, columns[at_chars].to_pylist(), strict=True)], type=kind)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in done], type=spans_type)], names=schema.names)
        give_back()

    return joined.select(*docs.columns, "__sub_links").mapInArrow(run, schema)
