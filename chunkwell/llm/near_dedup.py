"""Operator 6: near-duplicates by Order MinHash, verified by banded alignment.

The k-mers of a document are its shingles of ``SHINGLE`` words (lower case), each labelled with
its occurrence number.  Each of ``SKETCHES`` hash functions selects the ``PER_SKETCH`` labelled
k-mers with the smallest values; the sketch is their hash *in text order*, so that two documents
share it with a probability that follows their edit similarity.  Documents that share a sketch
are candidates; they are linked if the edit distance of their words is at most
``(1 - SIMILARITY)`` of the longer one, found by a bit-parallel alignment within that band.

Classes are the connected components of the links, as if all members of a bucket of equal sketches
were compared.  First every document is compared with those of smallest and of largest ``doc_id``
in its bucket, its leaders.  A bucket whose members are then in one class is done.  The members of
the others, such as unlike documents that share a passage, are compared with one another, exactly: in a bucket, those
outside its largest class with all of other classes.  Of buckets with the same members one is taken, and a pair is
compared in one of the buckets that it shares.  So every pair of a bucket is compared or in one class already.

A task gets the members of some small buckets, or two blocks of one with ``HOT`` such pairs or more.  A pair becomes
a row only if its words allow a link: all words of either text but the edited ones are in the other, so first of ``BITS``
marks of their words, then of the words themselves, neither text has more than that which the other lacks.
Nothing is left out, so the comparing of marks in a large bucket still grows with the product of the two sides, and so do
the rows, if more slowly: many documents that share so much and yet are unlike are compared pair by pair.

Exact copies (by MD5 of the text) are joined first, so only distinct texts are sketched into
buckets.  Texts travel as 2 bytes a word: two different words look equal once in 65,536, which
can raise a similarity by 0.00002 and can never lower it.

Cases: a null text or one without words is in a class of its own; so is a row without
``doc_id`` (its class is null).  A text of fewer than ``SHINGLE`` words is one k-mer.  Rows with
the same ``doc_id`` count as one document and share a class.  Only ``doc_id`` and ``text`` are read;
:func:`keep_first` keeps all columns.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import WORD_PY, components, drop_stored, give_back, map_texts, slices, store

SHINGLE = 4
SKETCHES = 64
PER_SKETCH = 2
SIMILARITY = 0.8
#: For :func:`rarest`: groups in which words are counted; so many of the rarest words are marked, and of those whose group counts FREQUENT times the mean.
GROUPS = 1 << 18
FIRST, FIRST_FREQUENT = 4, 8
FREQUENT = 4
#: Marks of a text, a bit for each labelled word; words said more than MANY times before have the last BITS_MANY alone.
BITS, BITS_MANY, MANY = 2048, 256, 16
#: Pairs of members of several classes from which a bucket is hot, and its documents and words in a block; parts into which other buckets are dealt.
HOT, BLOCK, BLOCK_WORDS, PARTS = 4_000, 4_096, 1 << 21, 1_024
#: So many ids are broadcast at most (16 MB or so in an executor).
FEW_IDS = 500_000
_WORD = re.compile(WORD_PY)
_RNG = np.random.default_rng(0x0517)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64)
_CACHE: dict[str, int] = {}
_CACHE_LIMIT = 200_000


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    words = _WORD.findall((text or "").lower())
    if len(_CACHE) > _CACHE_LIMIT:
        _CACHE.clear()
    get = _CACHE.get
    found = list(map(get, words))
    if None in found:
        for w in set(words):
            if w not in _CACHE:
                _CACHE[w] = xxhash.xxh3_64_intdigest(w)
        found = [_CACHE[w] for w in words]
    return np.array(found, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def occurrences(x: np.ndarray) -> np.ndarray:
    """How many equal numbers stand before each one."""
    order = np.argsort(x, kind="stable")
    s, out = x[order], np.zeros(len(x), dtype=np.uint64)
    same = s[1:] == s[:-1]
    if same.any():
        at = np.arange(len(x))
        out[order] = (at - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))).astype(np.uint64)
    return out


def labelled_kmers(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order."""
    n = max(1, len(h) - size + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(min(size, len(h))):
        acc = acc * _STEP + h[j : j + n]
    return _mixed(acc + occurrences(acc) * np.uint64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray, count: int = 32, per: int = PER_SKETCH, size: int = SHINGLE) -> np.ndarray:
    """``count`` order-min-hash sketches of a text's word hashes, as signed 64-bit numbers."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    kmers = labelled_kmers(h, size)
    n, block = len(kmers), max(1, 400_000 // len(kmers))
    out = np.empty(count, dtype=np.uint64)
    for j in range(0, count, block):
        m = _MULTIPLY[j : min(j + block, count)]
        x = kmers[None, :] * m[:, None]
        rows, chosen = np.arange(len(m)), []
        for _ in range(min(per, n)):
            best = x.argmin(axis=1)
            chosen.append(best)
            x[rows, best] = np.iinfo(np.uint64).max
        at = np.sort(np.array(chosen), axis=0)
        acc = _SALT[j : j + len(m)].copy()
        for a in at:
            acc = _mixed(acc * _STEP + kmers[a])
        out[j : j + len(m)] = acc
    return out.view(np.int64)


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is ``most`` or less, else ``most + 1``.

    Only the ``2 most + 1`` diagonals around the main one are computed, one bit each (Hyyro's
    bit-parallel form of the banded alignment).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    most = min(most, n)
    if most == 0:
        return int(a != b)
    width = 2 * most + 2
    mask = (1 << width) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    vp, vn = (mask << (width - most - 1)) & mask, 0
    distance, start = most, most + 1 - width
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    limit = most + m - (n - most)
    turn = n - most
    get = places.get
    for i, y in enumerate(b):
        p = get(y, 0)
        x = (p << -start if start < 0 else p >> start) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if i < turn:
            distance += not d0 & diagonal
        else:
            distance += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        if distance > limit:
            return most + 1
        half = d0 >> 1
        vp = hn | (mask & ~(half | hp))
        vn = half & hp
        start += 1
    return distance if distance <= most else most + 1


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether ``1 - distance / longer length`` of two word sequences is ``similarity`` or more."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    if not len(differ):
        return True  # the rest of the longer one is within the limit
    if len(a) == len(b) and len(differ) <= most:
        return True
    head = int(differ[0])
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    if not len(differ) or (len(differ) + longer - m <= most and len(a) != len(b) and len(differ) + abs(len(a) - len(b)) <= most):
        return True
    tail = int(differ[0])
    if tail:
        a, b = a[:-tail], b[:-tail]
    if max(len(a), len(b)) <= most:
        return True
    shared = min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum()))
    if max(len(a), len(b)) - shared > most:
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def marks(words: np.ndarray) -> np.ndarray:
    """``BITS`` marks, as signed 64-bit numbers: a bit for each labelled word of a text's words as they are aligned."""
    x, out = words.astype(np.uint64), np.zeros(BITS, dtype=bool)
    h, few = labelled_kmers(x, 1)[: len(x)], np.uint64(BITS - BITS_MANY)
    out[np.where(occurrences(x) < MANY, h % few, few + h % np.uint64(BITS_MANY)).astype(np.int64)] = True
    return np.packbits(out).view(np.int64)


def _sketch_rows(ids, digests, texts):
    payload, counts, sketches = [], [], []
    for t in texts:
        h = word_hashes(t)
        payload.append((h >> np.uint64(48)).astype(np.uint16).tobytes())
        counts.append(len(h))
        sketches.append(sketch(h, SKETCHES).tolist())
    return ids, digests, payload, counts, sketches


def _verify(similarity: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi in slices(batch.column(2), 500_000):
                part = batch.slice(lo, hi - lo)
                ok = [alike(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), similarity) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                kept = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])
        give_back()

    return run


def prefix_size(words: int, similarity: float = SIMILARITY) -> int:
    """Of how many of its rarest labelled words a text shares one with every text that is alike.

    A text of ``longer`` words within the limit has ``longer`` less the limit of them in common with it,
    which is least where ``longer`` is ``words``.
    """
    return int((1 - similarity) * words + 1e-9) + 1


def rarest(codes: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The ``prefix_size`` first labelled words of a text in an order that all texts share, and the marked ones of them.

    The order is by the count of a word's group, then by the word: rare words stand first (but for
    those that share a group with a frequent one).  Any order would do; this one keeps buckets small.
    Words are given by 32 bits of their hash: two that share these share a bucket, which loses nothing.
    :func:`classes` compares whole buckets instead, whose rows do not grow with the length of a text.
    """
    words = labelled_kmers(codes.astype(np.uint64), 1)
    n = counts[(words % np.uint64(GROUPS)).astype(np.int64)]
    first = np.lexsort((words, n))[: prefix_size(len(words), similarity)]
    words, n = (words[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), n[first]
    frequent = np.flatnonzero(n > FREQUENT * max(1.0, counts.mean()))[:FIRST_FREQUENT]
    return words, words[np.union1d(np.arange(min(FIRST, len(words))), frequent)]


def _most_edits(similarity: float):
    return F.floor((1 - similarity) * F.greatest("words", "words2") + 1e-9)


def _lengths_fit(similarity: float):
    return F.abs(F.col("words") - F.col("words2")) <= _most_edits(similarity)


def _fitting(pairs: DataFrame, known: DataFrame, fits) -> DataFrame:
    """The pairs (``doc_id, leader``) for which ``fits`` holds of what is ``known`` of either text by its ``doc_id``."""
    columns = known.columns[1:]
    own = pairs.join(known.toDF("own_id", *columns), F.col("doc_id") == F.col("own_id"))
    return own.join(known.toDF("leader_id", *(f"{c}2" for c in columns)), (F.col("leader") == F.col("leader_id")) & fits).select("doc_id", "leader")


def _links(pairs: DataFrame, payload: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``doc_id, leader``) that are alike, as edges ``a, b``."""
    with_own = pairs.join(payload.toDF("id1", "p1"), F.col("doc_id") == F.col("id1")).select("doc_id", "leader", "p1")
    with_both = with_own.join(payload.toDF("id2", "p2"), F.col("leader") == F.col("id2")).select("doc_id", "leader", "p1", "p2")
    return store(with_both.mapInArrow(_verify(similarity), "a long, b long"), "near-links")[0]


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "doc_id")).drop("node", "component")


def _mixed_buckets(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows (``sketch, doc_id, class``) of buckets that hold several classes, and where their list is stored; of buckets with the same members, one."""
    sums = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    several = rows.groupBy("sketch").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n"), *sums).where("lo < hi")
    several, path = store(several.groupBy("n", "x0", "x1").agg(F.min("sketch").alias("s2")).select("s2"), "near-several")
    return rows.join(several, F.col("sketch") == F.col("s2")).drop("s2"), path


def _texts_of_buckets(mixed: DataFrame, base: DataFrame) -> tuple[DataFrame, str]:
    """``doc_id, class, words, payload, sketches`` of each document of ``mixed`` (``sketch, doc_id, class``), and where it is stored."""
    members, members_path = store(mixed.groupBy(F.col("doc_id").alias("id1")).agg(F.min("class").alias("class"), F.sort_array(F.collect_list("sketch")).alias("sketches")), "near-undecided")
    own = base.select("doc_id", "payload", "words")
    if members.count() <= FEW_IDS:  # else all texts are shuffled for those of few documents
        own = own.join(F.broadcast(members.select(F.col("id1").alias("few_id"))), F.col("doc_id") == F.col("few_id"), "left_semi")
    texts, path = store(own.join(members, F.col("doc_id") == F.col("id1")).select("doc_id", "class", "words", "payload", "sketches"), "near-texts")
    drop_stored(base.sparkSession, members_path)
    return texts, path


def _pairs_of_classes(texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """``doc_id, leader``: the pairs of different classes in a bucket of ``texts`` whose words allow a link, each once; those found in hot buckets apart.

    The members outside the largest class of a bucket are dealt into blocks, and so are all members; each two
    of these blocks meet.  So a few strangers among many near copies cost a row for each copy, and no more.
    """
    each = texts.select("doc_id", "class", "words", F.explode("sketches").alias("sketch"))
    counted = each.groupBy("sketch", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    several = counted.groupBy(F.col("sketch").alias("s3")).agg(F.max_by("class", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    hot = (F.col("n") - F.col("most")) * F.col("n") >= HOT
    blocks = lambda n: F.when(hot, F.greatest(F.ceil(n / BLOCK), F.ceil(F.col("w") * n / (F.col("n") * BLOCK_WORDS)))).otherwise(1).cast("int")
    several, several_path = store(several.select("s3", "main", hot.alias("hot"), blocks(F.col("n") - F.col("most")).alias("lefts"), blocks(F.col("n")).alias("rights")), "near-several")
    left, right = (F.pmod(F.xxhash64("doc_id", F.lit(c)), F.col(c)).cast("int") for c in ("lefts", "rights"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # where there is one block of either, a task takes the members outside from among all
    twice = (F.col("class") != F.col("main")) & (F.col("lefts") * F.col("rights") > 1)
    lefts = F.transform(F.when(twice, upto("rights")).otherwise(F.array().cast("array<int>")), lambda k: F.struct(left.alias("a"), k.alias("b"), F.lit(True).alias("is_left")))
    rights = F.transform(upto("lefts"), lambda k: F.struct(k.alias("a"), right.alias("b"), F.lit(False).alias("is_left")))
    dealt = each.drop("words").join(several, F.col("sketch") == F.col("s3")).withColumn("at", F.explode(F.concat(lefts, rights)))
    part = F.when(F.col("hot"), F.xxhash64("sketch", "at.a", "at.b")).otherwise(F.pmod(F.xxhash64("sketch"), F.lit(PARTS)))
    dealt = dealt.select("doc_id", "class", "sketch", "main", "hot", "at.a", "at.b", "at.is_left", part.alias("part"))
    known = texts.select(F.col("doc_id").alias("known_id"), "payload", "sketches")
    rows = dealt.join(known, F.col("doc_id") == F.col("known_id")).drop("known_id")
    met, met_path = store(rows.groupBy("part").applyInArrow(_meet(similarity), "doc_id long, leader long, hot boolean"), "near-fitting")
    return met.where("not hot").drop("hot"), met.where("hot").drop("hot"), [several_path, met_path]


#: Numbers that labelled words are given where common ones are counted; two that share one can only make texts look more alike.
_NUMBERS = 1 << 20


def _meet(similarity: float):
    def run(table):
        import pyarrow as pa

        ids, kinds, mains, sketches, hots, is_left = (table.column(c).to_numpy() for c in ("doc_id", "class", "main", "sketch", "hot", "is_left"))
        found: dict[tuple, int] = {}  # rows of one doc_id may have several texts
        text = np.array([found.setdefault(x, len(found)) for x in zip(ids.tolist(), table.column("payload").to_pylist(), strict=True)])
        codes = [np.frombuffer(p, np.uint16) for _, p in found]
        _, first = np.unique(text, return_index=True)
        shared = [frozenset(x) for x in table.column("sketches").take(pa.array(first)).to_pylist()]
        n = np.array([len(c) for c in codes])
        numbers = [(labelled_kmers(c.astype(np.uint64), 1) % np.uint64(_NUMBERS)).astype(np.int32) for c in codes]
        bits = np.array([marks(c) for c in codes]).view(np.uint64)
        marked = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        seen, out = np.zeros(_NUMBERS, dtype=bool), []
        keys = np.array([sketches, table.column("a").to_numpy(), table.column("b").to_numpy()])
        order = np.lexsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)]))
        for rows in np.split(order, starts[1:]):
            sketch, outside = sketches[rows[0]], kinds[rows] != mains[rows]
            right = rows[~is_left[rows]]
            lefts = rows[is_left[rows]] if is_left[rows].any() else rows[outside]
            right = right[np.argsort(n[text[right]], kind="stable")]
            of, strange = text[right], kinds[right] != mains[right]
            lengths, held, count = n[of], bits[of], marked[of]
            for k in lefts:
                t = text[k]
                lo, hi = np.searchsorted(lengths, [similarity * n[t] - 1, n[t] / similarity + 1 if similarity > 0 else np.inf])
                longer = np.maximum(lengths[lo:hi], n[t])
                most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
                meets = (kinds[right[lo:hi]] != kinds[k]) & (~strange[lo:hi] | (ids[right[lo:hi]] < ids[k])) & (np.abs(lengths[lo:hi] - n[t]) <= most)
                some = np.flatnonzero(meets)
                common = np.bitwise_count(held[lo + some] & bits[t]).sum(axis=1, dtype=np.int64)
                some = some[np.maximum(count[lo + some], marked[t]) - common <= most[some]]
                # of the buckets that two texts share, the first one compares them
                some = [o for o in some.tolist() if min(shared[t] & shared[of[lo + o]]) == sketch]
                if some:
                    seen[numbers[t]] = True
                    fit = [o for o in some if longer[o] - np.count_nonzero(seen[numbers[of[lo + o]]]) <= most[o]]
                    seen[numbers[t]] = False
                    out += [(max(x, ids[k]), min(x, ids[k]), hots[k]) for x in ids[right[lo:hi][fit]].tolist()] if fit else []
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "leader": pa.array(columns[1], pa.int64()), "hot": pa.array(columns[2], pa.bool_())})

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of every row: the smallest ``doc_id`` of its class."""
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    base, base_path = store(map_texts(rows, ["doc_id", "digest", "text"], _sketch_rows, "doc_id long, digest string, payload binary, words int, sketches array<long>", _CACHE.clear), "near-base")
    wordy = base.where("doc_id is not null and size(sketches) > 0")
    # aggregated sides are stored before they are joined: only then can adaptive execution split a hot key
    first, first_path = store(wordy.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-first")
    with_rep = base.select("doc_id", F.when(F.expr("size(sketches) > 0"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "digest").cast("string"))).alias("digest")).join(first.withColumnRenamed("digest", "d2"), F.col("digest") == F.col("d2"), "left")
    members, _ = store(with_rep.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "near-members")

    reps = members.where("rep = doc_id").select("rep")
    buckets = wordy.select("doc_id", "sketches").join(reps, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", F.explode("sketches").alias("sketch"))
    buckets, buckets_path = store(buckets, "near-buckets")
    leaders = buckets.groupBy("sketch").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("last > leader")
    leaders, leaders_path = store(leaders.withColumnRenamed("sketch", "s2"), "near-leaders")
    met, met_path = store(buckets.join(leaders, F.col("sketch") == F.col("s2")).drop("s2"), "near-met")
    drop_stored(docs.sparkSession, buckets_path, leaders_path)
    others = met.select("doc_id", F.explode(F.filter(F.array("leader", "last"), lambda x: x != F.col("doc_id"))).alias("other"))
    pairs = others.select(F.greatest("doc_id", "other").alias("doc_id"), F.least("doc_id", "other").alias("leader")).distinct()
    pairs, pairs_path = store(pairs, "near-pairs")
    payload = base.select("doc_id", "payload")
    links = _links(_fitting(pairs, base.select("doc_id", "words"), _lengths_fit(similarity)), payload, similarity)
    found = components(links, "near-cc")
    # what the leaders have not decided: members of buckets of several classes, if there are two besides them
    inner = _with_class(met.where("size > 3 and doc_id <> leader and doc_id <> last").select("sketch", "doc_id"), found)
    mixed, several_path = _mixed_buckets(inner)
    texts, texts_path = _texts_of_buckets(mixed, base)
    drop_stored(docs.sparkSession, met_path, several_path)
    cold, hot, more_paths = _pairs_of_classes(texts, similarity)
    more, more_path = store(cold.unionByName(hot).join(pairs, ["doc_id", "leader"], "left_anti"), "near-pairs")
    new = _links(more, texts.select("doc_id", "payload"), similarity)
    if not new.isEmpty():
        # the components so far are stars, which stand for their links
        found = components(found.toDF("a", "b").unionByName(new), "near-cc")
    paths = [base_path, first_path, pairs_path, texts_path, more_path, *more_paths]
    drop_stored(docs.sparkSession, *paths)
    out = members.join(found, members["rep"] == found["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return out


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that come first in their class (smallest ``doc_id``), all columns."""
    dropped = classes(docs, similarity).where("doc_id <> class_id").select(F.col("doc_id").alias("__near_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["__near_id"], "left_anti")
