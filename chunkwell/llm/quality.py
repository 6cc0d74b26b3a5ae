"""Operator 8: quality rules as a short-circuit cascade.

A :class:`Rule` rejects a text by features that are computed when first asked for.  On a bounded
sample the cascade measures each rule's cost and how many texts it rejects, and then evaluates the rules
by rejections per second, most first, stopping at the first one that rejects.  Costs are those
beyond what a row has already paid for: where the contract's counts are computed for every row anyway, they are
not part of a rule's cost.  The order changes the cost and never the verdict, which is the
conjunction of the rules; every row of the table is judged, over its whole text.

The sample has about ``sample_rows`` rows, the first ones of evenly chosen partitions of the table, so that no
task reads more than its first rows; texts over ``SAMPLE_TEXT_BYTES`` are passed over in it (only in it).

Cases: a null text has no words.  An empty table gives an empty result, with the rules in their
given order.  Very long texts are processed alone in their slice.  Repeated rows are judged
alike; only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import WORD_PY, map_texts

WINDOW = 8
SAMPLE_ROWS = 512
SAMPLE_TEXT_BYTES = 65_536
_WORD = re.compile(WORD_PY)
_SYMBOLS = "#*$%&|<>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Features of one text, each computed at most once and only if a rule asks."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(map(t.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of ``WINDOW`` words that occur twice or more; hashes find them, words confirm them."""
        m = self.n_words - WINDOW + 1
        if m < 2:
            return 0
        h = np.fromiter(map(hash, self.words), dtype=np.int64, count=self.n_words).view(np.uint64)
        acc = h[:m].copy()
        for j in range(1, WINDOW):
            acc *= _FACTOR
            acc += h[j : j + m]
        ordered = np.sort(acc)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(acc, twice)).tolist()
        windows = [tuple(self.words[i : i + WINDOW]) for i in at]
        found = Counter(windows)
        covered = np.zeros(self.n_words + 1, dtype=np.int64)
        starts = np.array([i for i, w in zip(at, windows, strict=True) if found[w] > 1], dtype=np.int64)
        if not len(starts):
            return 0
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + WINDOW, self.n_words), -1)
        return int((np.cumsum(covered)[:-1] > 0).sum())

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or any(map(str.isalpha, w)))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


RULES = (
    Rule("symbols", lambda x: 10 * x.n_symbols > 2 * x.n_words),
    Rule("word_length", lambda x: not 3 * x.n_words <= x.word_chars <= 10 * x.n_words),
    Rule("dup_lines", lambda x: 10 * x.n_dup_lines > 4 * x.n_lines),
    Rule("letters", lambda x: 10 * x.n_letter_words < 7 * x.n_words),
)


def ordered(texts: list[str | None], rules: tuple[Rule, ...] = RULES, clock=time.perf_counter, paid: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """``rules`` with (seconds a text, share rejected) on ``texts``, by rejections per second, most first.

    The features in ``paid`` are computed before the clock starts.
    """
    measured = []
    for rule in rules:
        fresh = [Features(t) for t in texts]  # a rule pays for all else that it asks for
        for x in fresh:
            for name in paid:
                getattr(x, name)
        began, rejected = clock(), 0
        for x in fresh:
            rejected += rule.rejects(x)
        n = max(1, len(texts))
        measured.append((rule, max((clock() - began) / n, 1e-9), rejected / n))
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[1])) if texts else measured


def sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """About ``sample_rows`` texts, from evenly chosen partitions of ``docs``."""
    texts = docs.select("text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    parts = max(1, texts.rdd.getNumPartitions())
    stride, each = -(-parts // sample_rows), -(-sample_rows // parts)

    def first(batches):
        left = each if TaskContext.get().partitionId() % stride == 0 else 0
        for batch in batches if left else ():
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return

    return [r[0] for r in texts.mapInArrow(first, "text string").collect()]


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, paid: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """The order of ``rules`` on a sample of ``docs``."""
    return ordered(sample(docs, sample_rows), rules, paid=paid)


def verdict(x: Features, rules) -> str | None:
    """Name of the first rule that rejects ``x``."""
    return next((r.name for r in rules if r.rejects(x)), None)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, kept, rejected_by`` for every row; features are computed only as far as needed.

    ``rejected_by`` is the first rule in the measured order, so of two rules that both reject a
    text another run may name the other; ``kept`` is always the same.
    """
    order = [r for r, _, _ in plan(docs, rules, sample_rows)]

    def judge(ids, texts):
        by = [verdict(Features(t), order) for t in texts]
        return ids, [b is None for b in by], by

    return map_texts(docs, ["doc_id", "text"], judge, "doc_id long, kept boolean, rejected_by string")


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_and_verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts of every row, ``base_failed``, and ``kept`` by the cascade where the base rules pass."""
    order = [r for r, _, _ in plan(docs, rules, sample_rows, _COUNTS)]

    def judge(ids, texts):
        x = [Features(t) for t in texts]
        failed = [f.base_failed for f in x]
        kept = [not bad and verdict(f, order) is None for f, bad in zip(x, failed, strict=True)]
        return ids, *([getattr(f, c) for f in x] for c in _COUNTS), failed, kept

    return map_texts(docs, ["doc_id", "text"], judge, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, words, t, lines, len(words) AS n,
         CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) ELSE [] END AS grams
  FROM w),
u AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
twice AS (SELECT doc_id, gram FROM u GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT u.doc_id, unnest(range(u.i, u.i + 8)) AS p FROM u JOIN twice ON u.doc_id = twice.doc_id AND u.gram = twice.gram) s GROUP BY doc_id),
s AS (
  SELECT g.doc_id, CAST(n AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM g LEFT JOIN covered ON g.doc_id = covered.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (10 * n_symbols > 2 * n_words) AND word_chars BETWEEN 3 * n_words AND 10 * n_words
        AND NOT (10 * n_dup_lines > 4 * n_lines) AND NOT (10 * n_letter_words < 7 * n_words)) AS kept
FROM b
"""
