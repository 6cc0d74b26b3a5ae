"""Operator 9: chat formatting by quotation linking.

Each message is parsed into its own text and quoted passages (lines behind ``>`` marks, with
their nesting level; an attribution line such as "On ... wrote:" before a quote goes with it).
The hashes of a normalised quoted passage (lower case, single spaces), its lines and its sentences are
joined to those of messages: their whole text, paragraphs, lines and sentences, so a quote that is trimmed or
wrapped anew still finds its original.  The smallest turn of the conversation that
holds a quoted passage of level 1 is the message's original; of several, the latest one.  Where no
passage of level 1 has an original, those of level 2 are asked, and so on.
Messages then stand in reply order: by thread (the turn of the message at the root of the
replies), then by turn, so every reply follows its original and a thread is contiguous.

Result: one row per message, ``conv_id, thread, turn, reply_to, depth, role, text, n_quotes,
formatted``; a conversation is its rows ordered by ``thread, turn``.  ``formatted`` is the
message's part of the chat template.  No conversation is gathered in one task: links are
equi-joins on (conversation, passage hash) or (conversation, turn) against aggregated sides, and
roots are found by pointer jumping.

A message that quotes nothing known starts no new thread: it belongs to the thread of turn order,
that is to the conversation's first message without quotes (``thread`` is the smallest turn).

Cases: null text counts as empty; a message that only quotes has an empty text.  A quote whose
original is unknown, later or in another conversation links nothing.  Rows without ``conv_id`` or
``turn`` are kept, without a thread.  Rows with the same ``conv_id`` and ``turn`` share reply and
thread.  An empty table gives an empty result.  Only the four named columns are read.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import drop_stored, map_texts, store

_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_SPACE = re.compile(r"\s+")
_ATTRIBUTION = re.compile(r"^(?:on\b.*\bwrote|.+ (?:wrote|said|writes)|(?:am|le)\b.*\b(?:schrieb|a écrit)|el\b.*\bescribió)\b[^:]*:$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_ROUNDS = 60


def _is_attribution(line: str) -> bool:
    return line.endswith(":") and _ATTRIBUTION.match(line) is not None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message; a passage is a run of lines of one level."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    open_level = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if not open_level:
                while own and not own[-1].strip():
                    own.pop()
                if own and _is_attribution(own[-1].strip()):
                    own.pop()
            bare = line[m.end() :]
            if level != open_level or not bare.strip():
                if quotes and quotes[-1][1] or not quotes or quotes[-1][0] != level:
                    quotes.append((level, []))
                quotes[-1] = (level, quotes[-1][1])
            if bare.strip() and not _is_attribution(bare.strip()):
                quotes[-1][1].append(bare)
        else:
            own.append(line)
        open_level = level
    return "\n".join(own).strip(), [(n, "\n".join(lines)) for n, lines in quotes if lines]


def passage_hash(passage: str) -> int | None:
    """Hash of a normalised passage; null if nothing is left of it."""
    s = _SPACE.sub(" ", passage).strip().lower()
    if not s:
        return None
    x = xxhash.xxh3_64_intdigest(s)
    return x - (1 << 64) if x >> 63 else x


def parts(passage: str) -> list[str]:
    """A passage, its paragraphs, its lines, and the sentences of its paragraphs."""
    paragraphs = re.split(r"\n\s*\n", passage)
    return [passage, *paragraphs, *passage.split("\n"), *(s for p in paragraphs for s in _SENTENCE.split(p))]


def passages(own: str) -> set[int]:
    """Hashes of the parts of a message."""
    return {h for part in parts(own) if (h := passage_hash(part)) is not None}


def formatted(role: str | None, text: str) -> str:
    return f"<|{role or 'unknown'}|>\n{text}\n"


def _parsed(convs, turns, roles, texts):
    own, quoted, levels, held, n = [], [], [], [], []
    for t in texts:
        o, q = parse(t)
        own.append(o)
        n.append(len(q))
        asked = sorted({(level, h) for level, p in q for h in passages(p)})
        levels.append([level for level, _ in asked])
        quoted.append([h for _, h in asked])
        held.append(sorted(passages(o)))
    return convs, turns, roles, own, n, levels, quoted, held, [formatted(r, o) for r, o in zip(roles, own, strict=True)]


_PARSED = "conv_id long, turn long, role string, text string, n_quotes long, levels array<int>, quoted array<long>, held array<long>, formatted string"


def link(messages: DataFrame) -> DataFrame:
    """One row per message, see above."""
    parsed, _ = store(map_texts(messages, ["conv_id", "turn", "role", "text"], _parsed, _PARSED), "chat-parsed")
    placed = parsed.where("conv_id is not null and turn is not null")
    quotes = placed.where("size(quoted) > 0").select("conv_id", "turn", F.explode(F.arrays_zip("levels", "quoted")).alias("q")).select("conv_id", "turn", F.col("q.levels").alias("level"), F.col("q.quoted").alias("h"))
    # only passages that somebody quotes in the conversation matter; the earliest turn of each is its original
    asked, asked_path = store(quotes.select("conv_id", "h").distinct(), "chat-asked")
    with_quotes = asked.select(F.col("conv_id").alias("c1")).distinct()
    held = placed.join(with_quotes, F.col("conv_id") == F.col("c1"), "left_semi").select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.explode("held").alias("h2"))
    originals = asked.join(held, (F.col("conv_id") == F.col("c2")) & (F.col("h") == F.col("h2"))).groupBy(F.col("conv_id").alias("c3"), F.col("h").alias("h3")).agg(F.min("t2").alias("original"))
    linked = quotes.join(originals, (F.col("conv_id") == F.col("c3")) & (F.col("h") == F.col("h3"))).where("original < turn")
    by_level = linked.groupBy("conv_id", "turn", "level").agg(F.max("original").alias("original"))
    parents, _ = store(by_level.groupBy("conv_id", "turn").agg(F.min_by("original", "level").alias("reply_to")), "chat-links")
    drop_stored(messages.sparkSession, asked_path)
    threads = _roots(parents)
    first = placed.join(threads.select(F.col("conv_id").alias("c4"), F.col("turn").alias("t4")), (F.col("conv_id") == F.col("c4")) & (F.col("turn") == F.col("t4")), "left_anti")
    starts = first.groupBy(F.col("conv_id").alias("c5")).agg(F.min("turn").alias("start"))
    t = threads.select(F.col("conv_id").alias("c6"), F.col("turn").alias("t6"), "reply_to", "root", "depth")
    out = parsed.join(t, (F.col("conv_id") == F.col("c6")) & (F.col("turn") == F.col("t6")), "left")
    roots = threads.select(F.col("conv_id").alias("c7"), F.col("root").alias("t7")).distinct().withColumn("is_root", F.lit(True))
    out = out.join(roots, (F.col("conv_id") == F.col("c7")) & (F.col("turn") == F.col("t7")), "left").join(starts, F.col("conv_id") == F.col("c5"), "left")
    thread = F.when(F.col("turn").isNull() | F.col("conv_id").isNull(), None).when(F.col("root").isNotNull(), F.col("root")).when(F.col("is_root"), F.col("turn")).otherwise(F.col("start"))
    return out.select("conv_id", thread.alias("thread"), "turn", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "role", "text", "n_quotes", "formatted")


def _roots(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, root, depth`` of every message with a link, by pointer jumping."""
    now, path = store(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "chat-roots")
    for _ in range(_ROUNDS):
        up = now.select(F.col("conv_id").alias("c8"), F.col("turn").alias("t8"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = now.join(up, (F.col("conv_id") == F.col("c8")) & (F.col("root") == F.col("t8")), "left")
        if joined.where("above is not null").isEmpty():
            return now
        following, next_path = store(joined.select("conv_id", "turn", "reply_to", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-roots")
        drop_stored(parents.sparkSession, path)
        now, path = following, next_path
    raise RuntimeError("chat: replies form no forest")
