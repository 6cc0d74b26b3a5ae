"""Language ID, substring dedup, licences, quality, SentencePiece, fingerprints: against brute force and edge cases."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest

from chunkwell.llm import fingerprint, language_id, license_scan, quality, sentencepiece_codec, substring_dedup

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, digest long, size int, rule string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (None, None, None, None, None, 1, 1, "r"), (None, "the lone cat", "en", "s", 1, 1, 1, "r"), (1, "", None, None, 0, 1, 1, "r"), (2, " \n ", "en", "s", 3, 1, 1, "r"),
        (3, "the cat sat on the mat " * 40, "en", "s", 5, 1, 1, "r"), (3, "the cat sat on the mat " * 40, "en", "s", 5, 1, 1, "r"), (4, "le chat noir " * 3, "fr", "t", 5, 1, 1, "r"), (4, "der hund ist da", "de", "t", 5, 1, 1, "r"),
        (5, "x" * 300_000 + " end", "en", "t", 5, 1, 1, "r"), (6, "日本語" * 50 + "\U0001f600", "ja", None, 5, 1, 1, "r"), (7, "12 34 !!", "en", "t", 5, 1, 1, "r"),
    ]
    return spark.createDataFrame(rows, CLASHING)


OPERATORS = {
    "language": language_id.identify, "substring": substring_dedup.dedup, "license": license_scan.license_scan, "fingerprint": fingerprint.fingerprints,
    "quality": quality.base_and_verdict, "cascade": quality.cascade, "sentencepiece": lambda d: sentencepiece_codec.encode(d, sentencepiece_codec.load_model(d.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](odd.limit(0)).count() == 0


# Language ID.


def test_held_out_accuracy(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_undetermined(odd):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd).collect()}
    assert {(None, "und"), (1, "und"), (2, "und"), (7, "und")} <= got and (5, "und") not in got


def test_a_rare_language_beside_a_large_vocabulary(spark):
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:100_200]
    rows = [(1, " ".join(words * 2), "aa"), (2, "zuvy wuzy vuxy", "zz")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "zz"]
    assert model.predict("vuxy zuvy")[0] == "zz" and model.predict(words[-1])[0] == "aa"


def test_backoff_goes_down_the_orders():
    m = language_id.Model([("a", "house", 9), ("b", "maison", 9)], [("a", "^hous", 3), ("b", "^mais", 3), ("a", "us", 2), ("b", "on", 2)])
    assert m.score_word("house")[0] > m.score_word("house")[1]
    assert m.predict("housing")[0] == "a" and m.predict("lotion")[0] == "b" and m.predict("bus")[0] == "a"
    assert m.score_word("zzz").tolist() == [0, 0]


def test_scores_against_a_model_of_strings():
    """The same definition in plain dictionaries of words and n-grams, a word at a time."""
    import math
    from collections import Counter

    rng = random.Random(61)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "un", "er", "ka"], "cc": ["я", "не", "ко", "та"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(lang, text(lang, rng.randint(1, 40))) for lang in syllables for _ in range(8)]
    langs = sorted(syllables)
    tables = {o: {lang: Counter() for lang in langs} for o in range(6)}
    for lang, t in rows:
        for w in language_id.words_of(t):
            tables[0][lang][w] += 1
            for o in range(1, 6):
                tables[o][lang].update(language_id.grams_of(w, o))

    def entry(o, e):
        unseen = math.log(0.5 / max(sum(c.values()) for c in tables[o].values()))
        return [math.log(tables[o][lang][e] / sum(tables[o][lang].values())) if tables[o][lang][e] else unseen for lang in langs]

    known = lambda o, e: any(tables[o][lang][e] for lang in langs)

    def score(w):
        if known(0, w):
            return entry(0, w)
        for o in (5, 4, 3, 2, 1):
            found = [entry(o, g) for g in language_id.grams_of(w, o) if known(o, g)]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [0.0] * len(langs)

    counted = language_id._count([r[0] for r in rows], [r[1] for r in rows])
    model = language_id.Model.of_counts(langs, [langs.index(x) for x in counted[0]], counted[1], np.array(counted[2]).view(np.uint64), counted[3])
    probes = [text(rng.choice(langs), rng.randint(1, 30)) for _ in range(60)] + ["kaschя zzz", "日本", "ka"]
    words = sorted({w for t in probes for w in language_id.words_of(t)})
    assert np.allclose(model.score_words(words), [score(w) for w in words], atol=1e-4)
    for (lang, share), t in zip(model.predict_all(probes), probes, strict=True):
        totals = [sum(c) for c in zip(*(score(w) for w in language_id.words_of(t)), strict=True)]
        root = math.sqrt(len(language_id.words_of(t)))
        expected = 1 / sum(math.exp((x - max(totals)) / root) for x in totals)
        assert totals[langs.index(lang)] >= max(totals) - 1e-3 and share == pytest.approx(expected, abs=1e-3)
    assert model.predict_all(probes) == [model.predict(t) for t in probes]


def test_languages_have_equal_shares_of_the_sample(spark):
    rows = [(i, f"großes wort {i}", "aa") for i in range(2000)] + [(5000 + i, f"kleine rede {i}", "bb") for i in range(30)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=100)
    assert model.languages == ["aa", "bb"]
    assert model.predict("kleine rede")[0] == "bb" and model.predict("großes wort")[0] == "aa"


def test_rejected_documents_go(odd):
    model = language_id.train(odd)
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert {1, 2, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


# Substring dedup.


def test_chunks_are_the_text_and_ignore_what_stands_before():
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(10_000)}" for _ in range(200))
    a, b = passage, "an insertion " + passage
    for t in (a, b, "日本語" * 300, "é" * 500, "", "a" * 5000):
        raw, borders, words = substring_dedup.chunks([t])[0]
        assert b"".join(raw[s:e] for s, e in zip(borders, borders[1:], strict=False)).decode() == t
        assert words[-1] == len(t.split())
    da, db = (substring_dedup.digests(*substring_dedup.chunks([t])[0][:2]) for t in (a, b))
    assert len(set(da) & set(db)) >= len(da) - 2


def _places(text):
    """The first place of each link of a text, in document 0."""
    raw, borders, _ = substring_dedup.chunks([text])[0]
    out = {}
    pairs, stretches = substring_dedup.links(raw, borders)
    for at, link in enumerate(pairs):
        out.setdefault(link, (0, at))
    return out | {link: (0, a) for a, _, powers in stretches for link in powers}


def test_passages_of_51_words_are_cut_wherever_they_stand():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    for _ in range(200):
        passage = " ".join(word() for _ in range(51))
        one, two = (" ".join([*(word() for _ in range(rng.randint(0, 40))), passage, *(word() for _ in range(30))]) for _ in range(2))
        cleaned, spans = substring_dedup.clean(two, substring_dedup.chunks([two])[0], _places(one))
        assert spans and passage not in cleaned
        for s in reversed(spans):
            assert two[s["start"] : s["end"]] in passage + " "


def _windows(text, size):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _holds(spark, docs_by_id, frame):
    """Every removed span stands earlier as a whole; every passage of 51 words stands once."""
    out = {r["doc_id"]: r for r in substring_dedup.dedup(frame).collect()}
    seen, seen_text, changed = set(), "", 0
    for i in sorted(docs_by_id):
        text, spans = docs_by_id[i], out[i]["__sub_removed"]
        kept, at = [], 0
        for s in spans:
            gone = text[s["start"] : s["end"]]
            assert s["start"] >= at and s["words"] >= 1
            assert gone in seen_text, (i, gone)
            kept.append(text[at : s["start"]])
            at = s["end"]
        assert "".join(kept) + text[at:] == out[i]["text"]
        assert not (_windows(text, 51) & seen & _windows(out[i]["text"], 51))
        seen |= _windows(text, 51)
        seen_text += text + "\0"
        changed += bool(spans)
    return changed


def test_substring_dedup_by_brute_force(spark, docs, texts):
    assert 0 < _holds(spark, texts, docs) < len(texts)


def test_parts_from_different_documents_stay(spark):
    rng = random.Random(15)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3))
    filler = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(30))
    rows = {1: f"{filler()} {a} {filler()}", 2: f"{filler()} {b} {filler()}", 3: f"{filler()} {c} {filler()}", 4: f"{filler()} {a} {b} {c} {filler()}"}
    assert _holds(spark, rows, spark.createDataFrame(list(rows.items()), "doc_id long, text string")) == 0
    rows[5] = f"{filler()} {a} {b} {c} {filler()}"
    assert _holds(spark, rows, spark.createDataFrame(list(rows.items()), "doc_id long, text string")) == 1


def test_repeats_within_a_document():
    rng = random.Random(18)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    text = f"one {passage} two {passage} three"
    chunked = substring_dedup.chunks([text])[0]
    assert substring_dedup.clean(text, chunked, {}) == (text, [])
    cleaned, spans = substring_dedup.clean(text, chunked, {}, within=True)
    assert spans and cleaned.startswith(f"one {passage}") and len(cleaned) < 0.65 * len(text)


@pytest.mark.parametrize("unit", ["from", "buy now", "a line of 14 b"])
def test_repeated_words_between_others(unit):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    for _ in range(20):
        one, two = (" ".join([*(word() for _ in range(25)), *[unit] * 60, *(word() for _ in range(25))]) for _ in range(2))
        cleaned = substring_dedup.clean(two, substring_dedup.chunks([two])[0], _places(one))[0]
        assert cleaned.count(unit) < 12 and cleaned.split()[:20] == two.split()[:20] and cleaned.split()[-20:] == two.split()[-20:]


def test_substring_dedup_of_large_random_texts(spark):
    """Texts of copied, repeated and new pieces: nothing that stands once goes."""
    rng = random.Random(17)
    pieces = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(3000)}" for _ in range(rng.choice([3, 10, 60]))) for _ in range(40)]
    rows = {i: "\n".join(rng.choice(pieces) if rng.random() < 0.5 else " ".join(f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(40))) for _ in range(rng.randrange(12))) for i in range(80)}
    assert _holds(spark, rows, spark.createDataFrame(list(rows.items()), "doc_id long, text string")) > 10


# Licences.


def test_every_sentence_has_a_keyword():
    samples = {"SPDX": "SPDX-License-Identifier: MIT", "CC0": "CC0 1.0"}
    for name, pattern in license_scan.SENTENCES:
        probe = samples.get(name, pattern)
        assert license_scan._KEY.search(probe), name


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", ["Apache-2.0"]),
        ("a | b\nReleased under the MIT License.\nc | d", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("No licence here, just a warranty of fun.", []),
        ("", []),
        (None, []),
    ],
)
def test_licences(text, expected):
    assert license_scan.scan(text)[0] == expected


def test_wrapped_licence_in_comments():
    head = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# See the License for the specific language governing permissions and\n# limitations under the License.'
    licences, ids, unmatched = license_scan.scan(head)
    assert licences == ["Apache-2.0"] and ids[0] == "APACHE2_HEAD" and "APACHE2_SEE" in unmatched


# Quality.


def test_quality_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(quality.ORACLE_SQL)
    names = [d[0] for d in expected.description]
    got = quality.base_and_verdict(spark.read.parquet(f"{sf}/documents.parquet")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_cascade_order_and_verdict():
    clock = iter(range(100))
    dear = quality.Rule("dear", lambda x: [next(clock) for _ in range(3)] and len(x.text) > 3)
    cheap = quality.Rule("cheap", lambda x: len(x.text) > 5)
    never = quality.Rule("never", lambda x: False)
    order = [r.name for r, _, _ in quality.ordered(["a" * n for n in range(10)], (never, dear, cheap), clock=lambda: next(clock))]
    assert order == ["cheap", "dear", "never"]
    x = quality.Features("abcd")
    assert quality.verdict(x, [dear, cheap]) == "dear" and quality.verdict(quality.Features("ab"), [cheap]) is None


def test_costs_leave_out_what_is_paid_for():
    dear, cheap = quality.Rule("dear", lambda x: x.n_repeat_words >= 0), quality.Rule("cheap", lambda x: len(x.text) > 2)
    texts = ["a b c d e f g h " * 200] * 50
    fresh, paid = (dict((r.name, cost) for r, cost, _ in quality.ordered(texts, (dear, cheap), paid=p)) for p in ((), ("n_repeat_words",)))
    assert paid["dear"] < fresh["dear"] / 5


def test_sample_is_spread_over_the_table_and_bounded(spark):
    frame = spark.range(0, 4000, 1, 40).selectExpr("id as doc_id", "case when id % 7 = 0 then null when id % 5 = 0 then repeat('x', 100000) else concat('t', id div 100) end as text")
    got = quality.sample(frame, 80)
    assert len(got) == 80 and len(set(got)) == 40 and all(len(t) < 10 for t in got)
    assert len(quality.sample(frame, 10)) == 10 and quality.sample(frame.limit(0)) == []


def test_repeat_words_by_definition():
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        assert quality.Features(" ".join(words)).n_repeat_words == len(covered)


# SentencePiece.


def _piece(text, score, kind=1):
    raw = text.encode()
    body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
    return b"\x0a" + bytes([len(body)]) + body


def _unigram_model():
    pieces = _piece("<unk>", 0, 2) + _piece("<s>", 0, 3) + _piece("</s>", 0, 3) + b"".join(_piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁a", -4.2), ("▁ab", -6.0), ("ba", -6.5), ("▁the", -2.0), ("the", -4.0), ("t", -6.0), ("h", -6.1), ("e", -5.9)):
        pieces += _piece(p, s)
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # unigram, byte fallback
    normaliser = b"\x0a\x08identity" + b"\x18\x01\x20\x00\x28\x01"
    return pieces + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normaliser)]) + normaliser


ODD_TEXTS = ["", " ", "  a", "a ", "a  b", "\n", "▁", "a▁b", "日本 語🎉", "<s> <0x41>", "\x00", "x " * 300, "the abab the"]


@pytest.mark.parametrize("data", [None, "unigram"])
def test_parity_with_sentencepiece(data, texts):
    import sentencepiece

    model = _unigram_model() if data else open(sentencepiece_codec.MODEL, "rb").read()
    codec, reference = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [*ODD_TEXTS, *list(texts.values())[:20]]
    for t, (ids, parity) in zip(rows, codec.encode(rows), strict=True):
        assert parity and ids == reference.encode(t)
        assert codec.decode(ids) == codec.expected(t) == t.replace("▁", " ")
    assert codec.encode([None]) == [(None, True)]


class _Spoiled:
    """A Tokenizers pipeline whose ids are wrong."""

    def __init__(self, real):
        self.real = real

    def encode_batch_fast(self, texts, **options):
        return [type("E", (), {"ids": [5] * len(e.ids)})() for e in self.real.encode_batch_fast(texts, **options)]

    def __getattr__(self, name):
        return getattr(self.real, name)


@pytest.mark.parametrize("data", [None, "unigram"])
def test_ids_are_those_of_tokenizers(data):
    model = _unigram_model() if data else open(sentencepiece_codec.MODEL, "rb").read()
    codec = sentencepiece_codec.Codec(model)
    codec.tokenizer = _Spoiled(codec.tokenizer)
    ids, parity = codec.encode(["abab the cat"])[0]
    assert set(ids) == {5} and not parity
    assert codec.encode_flat(["abab the cat", None])[3] == [False, True]


def _trimming_model():
    return _unigram_model()[:-4] + b"\x20\x01\x28\x01"


def test_models_that_trim_spaces_are_encoded_whole():
    import sentencepiece

    codec, reference = sentencepiece_codec.Codec(_trimming_model()), sentencepiece.SentencePieceProcessor(model_proto=_trimming_model())
    assert not codec.by_segment
    rows = [*(t for t in ODD_TEXTS if "▁" not in t), " a  b ", "the\n abab"]
    for t, (ids, parity) in zip(rows, codec.encode(rows), strict=True):
        assert parity and ids == reference.encode(t)
        assert codec.decode(ids) == codec.expected(t) == " ".join(x for x in t.split(" ") if x)
    assert codec.encode([None]) == [(None, True)]


def test_segments_are_learnt_again_after_the_cache_is_full():
    data = open(sentencepiece_codec.MODEL, "rb").read()
    small, large = sentencepiece_codec.Codec(data, cache=10), sentencepiece_codec.Codec(data)
    rng = random.Random(6)
    for _ in range(20):
        rows = [" ".join(rng.choice(["alpha", "beta  two", "日本", "▁x", "y"]) + str(rng.randrange(50)) for _ in range(20)) for _ in range(5)]
        assert small.encode(rows) == large.encode(rows)
        assert all(ids == large.reference.encode(t) for t, (ids, _) in zip(rows, small.encode(rows), strict=True))


def test_encoded_documents_decode(docs, texts):
    model = sentencepiece_codec.load_model(docs.sparkSession)
    encoded = sentencepiece_codec.encode(docs, model).cache()
    assert encoded.where("not parity or not round_trip").count() == 0
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, model).collect()} == texts


# Fingerprints.


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _lcs(a, b):
    """Length of the longest common subsequence, by bits."""
    at, row = {}, 0
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    for y in b:
        x = row | at.get(y, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def _within_bounds(likeness, a, b):
    """At least what both ends share, at most what any alignment has."""
    if a == b:
        return likeness == 1.0
    n, p = max(len(a), len(b)), _common(a, b)
    ends = p + min(min(len(a), len(b)) - p, _common(a[::-1], b[::-1]))
    return ends / n - 1e-12 <= likeness <= _lcs(a, b) / n + 1e-12


def test_scattered_edits_cost_their_own_length():
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    for _ in range(40):
        a = "".join(rng.choice(letters) for _ in range(9000))
        places = sorted(rng.sample(range(0, 8900, 300), 12))
        b, cost = a, 0
        for at in reversed(places):
            gone, new = rng.randrange(4), rng.choice(["", "x", "yy", "zzz"])
            b = b[:at] + new + b[at + gone :]
            cost += max(gone, len(new))
        b = "#" + b[1:-1] + "#"  # one edit at each end besides
        p, q = fingerprint.Prefix(a), fingerprint.Prefix(b)
        spans = fingerprint.common_spans(p, q)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in spans)
        assert all(i + n <= x and j + n <= y for (i, j, n), (x, y, _) in zip(spans, spans[1:], strict=False))
        assert 1 - (cost + 40) / 9000 <= fingerprint.likeness(p, q) <= _lcs(a, b) / max(len(a), len(b))
    assert fingerprint.likeness(fingerprint.Prefix("".join(rng.sample(letters * 99, 2000))), fingerprint.Prefix("".join(rng.sample(letters * 99, 2000)))) < 0.02
    assert fingerprint.likeness(fingerprint.Prefix(""), fingerprint.Prefix("")) == 1.0 and fingerprint.likeness(fingerprint.Prefix(""), fingerprint.Prefix("a")) == 0.0


def test_likeness_of_small_and_repetitive_texts():
    rng = random.Random(22)
    for _ in range(300):
        a, b = ("".join(rng.choice(["ab", "abc", "x" * 30, "the cat sat on the mat "]) for _ in range(rng.randrange(12))) for _ in range(2))
        assert _within_bounds(fingerprint.likeness(fingerprint.Prefix(a), fingerprint.Prefix(b)), a, b)


def test_anchors_of_a_joined_text_are_its_own():
    rng = random.Random(23)
    a, b = ("".join(rng.choice("abcd") for _ in range(400)) for _ in range(2))
    joined, whole = fingerprint.Joined(fingerprint.Prefix(a), 250, fingerprint.Prefix(b), 130), fingerprint.Prefix(a[:250] + b[:130])
    across = lambda at: 250 - fingerprint.SPAN < at < 250
    assert list(zip(*(x.tolist() for x in joined.anchors), strict=True)) == [(at, h) for at, h in zip(*(x.tolist() for x in whole.anchors), strict=True) if not across(at)]


def test_fingerprints_against_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        own, other = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.Prefix(own).digest, fingerprint.Prefix(edited).digest)
        assert _within_bounds(r["near_edited"], own, edited) and _within_bounds(r["near_next"], own, other)


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(2))
        p, q = fingerprint.Prefix(a), fingerprint.Prefix(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert fingerprint.extension(p, i, q, j) == _common(a[i:], b[j:])
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert fingerprint.equal_spans(p, i, q, j, n) == (a[i : i + n] == b[j : j + n])


def test_digits_of_numpy_types_do_not_leak():
    assert isinstance(substring_dedup.chunks(["a b"])[0][1], np.ndarray)
