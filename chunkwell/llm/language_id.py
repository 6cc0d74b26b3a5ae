"""Operator 1: language identification, word first, with back-off to character n-grams.

Training counts words and their character n-grams (with word ends marked) by language, on a sample of
the labelled documents.  The sample is bounded by ``SAMPLE_DOCS`` documents and about ``SAMPLE_BYTES``
bytes, both parameters, and every language has the same share of it, so that a large one does not
crowd out a small one.  Every word and n-gram of the sample is kept, and prediction covers every
word of every text.

A known word scores its log frequency in each language; a language that lacks it scores half of the
least frequency there is.  An unknown word falls back to its 5-grams, or 4-, 3-, 2- and 1-grams if
it has no longer one that is known, and scores the mean log frequency of the known ones.  The
language with the largest sum wins, the first by code point of equal ones.  ``score`` is its share of
the softmax of the sums divided by the square root of the number of words.  Scores are added as
integers, so that a text's prediction does not depend on the rows beside it.

Entries are known by 64-bit hashes of their letters, in sorted arrays of (hash, language, log
frequency): 14 bytes for each entry of a language, so a model is small beside a table of strings.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing was labelled.  Rows without language, text or id are not learned from.  Very long texts
are processed whole.  Repeated rows get equal predictions.  Only the named columns are read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import Numbers, drop_stored, give_back, map_texts, slices, store

SAMPLE_DOCS = 10_000
SAMPLE_BYTES = 64_000_000
ORDERS = (5, 4, 3, 2, 1)
#: The order of whole words.
WORD = 0
MIN_SCORE = 0.5
UNDETERMINED = "und"
SMOOTH = 0.5
#: Scores are whole multiples of this.
UNIT = 2.0**-20
_LETTERS = re.compile(r"[^\W\d_]+")
_KNOWN_LIMIT = 100_000
_BLOCK = 20_000
_STEP = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return [] if not text else _LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(pow(_STEP, len(_POWERS), 1 << 64))])
    return _POWERS


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point of all strings in a row, and the lengths of the strings."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return _scrambled((codes + np.uint64(1)) * np.uint64(_STEP)), np.fromiter(map(len, strings), np.int64, len(strings))


def hashes_of(strings: list[str]) -> np.ndarray:
    """A 64-bit hash of each string (none empty): a polynomial of its code points."""
    if not strings:
        return np.empty(0, np.uint64)
    codes, sizes = _coded(strings)
    starts = np.cumsum(sizes) - sizes
    return _scrambled(np.add.reduceat(codes * _powers(int(sizes.max()))[np.arange(len(codes)) - np.repeat(starts, sizes)], starts))


def gram_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of the words, each as :func:`hashes_of` has it, and whose word each is."""
    codes, sizes = _coded([f"^{w}$" for w in words])
    many = np.maximum(sizes - order + 1, 0)
    of = np.repeat(np.arange(len(words)), many)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many) + np.arange(len(of))
    h = np.zeros(len(of), dtype=np.uint64)
    for j, power in enumerate(_powers(order)[:order]):
        h += codes[at + j] * power
    return _scrambled(h), of


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        """``words`` and ``grams``: (language, entry, count)."""
        entries = [*((lang, WORD, e, n) for lang, e, n in words), *((lang, len(e), e, n) for lang, e, n in grams)]
        langs = sorted({lang for lang, _, _ in words})
        entries = [e for e in entries if e[0] in set(langs)]
        self._fill(langs, [langs.index(e[0]) for e in entries], [e[1] for e in entries], hashes_of([e[2] for e in entries]), [e[3] for e in entries])

    @classmethod
    def of_counts(cls, languages: list[str], lang, order, entry, n) -> Model:
        """From arrays: place in ``languages`` (sorted), order (0: word), hash and count of each entry."""
        model = cls.__new__(cls)
        model._fill(languages, lang, order, entry, n)
        return model

    def _fill(self, languages, lang, order, entry, n) -> None:
        self.languages = list(languages)
        lang, order, n = np.asarray(lang, np.int16), np.asarray(order, np.int8), np.asarray(n, np.float64)
        self.tables = {}
        for o in (WORD, *ORDERS):
            here = np.flatnonzero(order == o)
            at = here[np.lexsort((lang[here], entry[here]))]
            totals = np.bincount(lang[at], weights=n[at], minlength=len(self.languages))
            unseen = np.log(SMOOTH / max(1.0, totals.max(initial=0.0)))
            self.tables[o] = entry[at], lang[at], (np.log(n[at] / totals[lang[at]]) - unseen).astype(np.float32), unseen
        self.forget()

    def forget(self) -> None:
        """Drop the scores of words seen since training."""
        self._rows = Numbers()
        self._scores = np.zeros((1024, max(len(self.languages), 1)), dtype=np.int32)

    def __getstate__(self):
        return {"languages": self.languages, "tables": self.tables}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _of_order(self, order: int, hashes: np.ndarray, of: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """For ``many`` words: the mean score of those of their ``hashes`` that are known, and their number."""
        keys, langs, above, unseen = self.tables[order]
        lo = np.searchsorted(keys, hashes)
        hi = np.searchsorted(keys, hashes, side="right")
        size, k = hi - lo, len(self.languages)
        known = np.bincount(of[size > 0], minlength=many)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        sums = np.bincount(np.repeat(of, size) * k + langs[at], weights=above[at], minlength=many * k).reshape(many, k)
        return unseen + sums / np.maximum(known, 1)[:, None], known

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log frequency in each language, by the word or the longest n-grams of it that are known."""
        out, left = np.zeros((len(words), len(self.languages))), np.arange(len(words))
        for order in (WORD, *ORDERS):
            if not len(left):
                break
            rest = [words[i] for i in left.tolist()]
            hashes, of = (hashes_of(rest), np.arange(len(rest))) if order == WORD else gram_hashes(rest, order)
            scores, known = self._of_order(order, hashes, of, len(rest))
            out[left[known > 0]] = scores[known > 0]
            left = left[known == 0]
        return out

    def score_word(self, word: str) -> np.ndarray:
        return self.score_words([word])[0]

    def _learn(self, new: list[str]) -> None:
        first, n = len(self._rows) - len(new), len(self._rows)
        if n > len(self._scores):
            more = np.zeros((max(n, 2 * len(self._scores)), self._scores.shape[1]), dtype=np.int32)
            more[: len(self._scores)] = self._scores
            self._scores = more
        for i in range(0, len(new), _BLOCK):
            part = new[i : i + _BLOCK]
            self._scores[first + i : first + i + len(part)] = np.rint(self.score_words(part) / UNIT)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        # a run may also hold numerals such as U+00BD, which alone are no letter
        given = [i for i, w in enumerate(words) if w and any(map(str.isalpha, texts[i]))] if self.languages else []
        if not given:
            return out
        if len(self._rows) > _KNOWN_LIMIT:
            self.forget()
        known = len(self._rows)
        flat = itertools.chain.from_iterable(words[i] for i in given)
        sizes = np.fromiter((len(words[i]) for i in given), np.int64, len(given))
        try:
            rows = np.fromiter(map(self._rows.__getitem__, flat), np.int64, int(sizes.sum()))
            self._learn(list(itertools.islice(self._rows, known, None)))
        except BaseException:
            self.forget()
            raise
        total = np.zeros((len(given), len(self.languages)), dtype=np.int64)
        of, block = np.repeat(np.arange(len(given)), sizes), max(1, (1 << 21) // len(self.languages))
        for i in range(0, len(rows), block):
            part = of[i : i + block]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            total[part[starts]] += np.add.reduceat(self._scores[rows[i : i + block]], starts, axis=0, dtype=np.int64)
        best = total.argmax(axis=1)
        gap = (total - total.max(axis=1, keepdims=True)) * UNIT
        share = 1.0 / np.exp(gap / np.sqrt(sizes)[:, None]).sum(axis=1)
        for i, b, x in zip(given, best.tolist(), share.tolist(), strict=True):
            out[i] = (self.languages[b], x)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _count(langs, texts):
    """(language, order, hash, count) of the words and n-grams of some texts."""
    by: dict[str, Counter] = {}
    for lang, t in zip(langs, texts, strict=True):
        by.setdefault(lang, Counter()).update(words_of(t))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for lang, counts in by.items():
        words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        for order in (WORD, *ORDERS) if words else ():
            hashes, of = (hashes_of(words), np.arange(len(words))) if order == WORD else gram_hashes(words, order)
            found, at = np.unique(hashes, return_inverse=True)
            many = np.bincount(at, weights=n[of])
            for column, values in zip(out, ([lang] * len(found), [order] * len(found), found.view(np.int64).tolist(), many.astype(np.int64).tolist()), strict=True):
                column += values
    return out


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the rows of ``labelled`` (``doc_id, text, lang``) with text and language.

    Of a language with more than its share of ``sample_docs`` rows or ``sample_bytes`` bytes, about that
    many are chosen by a hash of their id.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    sizes, path = store(labelled.groupBy(F.col("lang").alias("lang2")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "language-sizes")
    languages = sorted(r[0] for r in sizes.select("lang2").collect())
    share = F.least(F.lit(1.0), F.lit(sample_docs / max(1, len(languages))) / F.col("n"), F.lit(sample_bytes / max(1, len(languages))) / F.greatest("bytes", F.lit(1)))
    # the stored sizes are small, so this join broadcasts them and moves no text
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(sizes.select("lang2", share.alias("share")), F.col("lang") == F.col("lang2")).where(chance < F.col("share")).select("lang", "text")
    counted = map_texts(chosen, ["lang", "text"], _count, "lang string, ord int, entry long, n long").groupBy("lang", "ord", "entry").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    drop_stored(labelled.sparkSession, path)
    import pyarrow.compute as pc
    import pyarrow as pa

    at = pc.index_in(counted["lang"], pa.array(languages, pa.string()))
    entries = counted["entry"].to_numpy().view(np.uint64)
    return Model.of_counts(languages, at.to_numpy(), counted["ord"].to_numpy(), entries, counted["n"].to_numpy())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        out = shared.value.predict_all(texts)
        return ids, [o[0] for o in out], [o[1] for o in out]

    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double", lambda: shared.value.forget())


def held_out():
    """True for the ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """The fields of the contract: train on what is not held out, predict everything."""
    return predict(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known with ``min_score`` at least."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi in slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                kept = [lang != UNDETERMINED and score >= min_score for lang, score in shared.value.predict_all(part.column(at).to_pylist())]
                yield part.filter(pa.array(kept, pa.bool_()))
        shared.value.forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)
