"""URL filters, near-dedup, mixing, chats, components, pipeline: against brute force and edge cases."""

import random
import time
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.llm import chat, common, mixing, near_dedup, url_filter
from chunkwell.llm.common import components


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)] + [(7, None), (None, 8), (9, 9)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# URL filters.


def _parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:end]


def _rule(host, path):
    fits = [(len(r), v == "allow", r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[2:] if fits else (None, None)


def test_url_rules_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in url_filter.judge(pages).join(pages.select("page_id", "url"), "page_id").collect():
        host, path = _parts(r["url"])
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


CANONICAL = '<link rel="canonical" href="%s">'
REFRESH = "<meta http-equiv='Refresh' content='0; URL=%s'>"


def test_aliases_take_block_decisions(spark):
    rows = [
        (1, "http://a.net/x", CANONICAL % "https://example.org/es/5"), (2, "http://b.net/y#f", REFRESH % "http://a.net/x"), (3, "https://b.net/y", ""),
        (4, "http://c.net/1", CANONICAL % "/2"), (5, "http://c.net/2", ""), (6, "http://d.net/1", CANONICAL % "http://x.com/de/1"), (7, "http://d.net/2", CANONICAL % "http://d.net/1"),
        (8, "http://www.x.com/fr/9", CANONICAL % "http://d.net/9"), (9, "http://d.net/9", CANONICAL % "http://y.com/de/9"), (10, "http://y.com/de/9", ""),
        (11, "nothing", CANONICAL % "http://x.com/de/1"), (12, None, None), (13, "HTTP://WWW.Example.ORG/en/12?q", None), (14, "http://notexample.org/es/1", ""), (15, "http://e.net/1", CANONICAL % "http://[bad"),
        (16, "http://example.org", None), (1, "http://a.net/x", CANONICAL % "https://example.org/es/5"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "allow", 13: "block", 14: "allow", 15: "allow", 16: "allow"}
    assert url_filter.judge(frame).count() == len(rows)
    assert url_filter.judge(frame.limit(0)).count() == 0
    extra = spark.createDataFrame([("http://c.net/2", "http://z.com/de/7")], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame, edges=extra).collect()}
    assert (got[4], got[5]) == ("block", "block")


def test_random_link_graphs_against_union_find(spark):
    """Pages with canonical links, redirects and a hot alias that a third of them name."""
    rng = random.Random(31)
    hosts = ["a.net", "b.net", "x.com", "example.org", "www.example.org"]
    paths = ["/", "/es/1", "/en/1", "/en/2", "/de/3", "/fr/4", "/p", "/q?x=1", "/q?x=2"]
    urls = [f"http://{h}{p}{k}" for h in hosts for p in paths for k in range(120)]
    rng.shuffle(urls)
    hot, edges, rows = "http://b.net/p7", [], []
    for i, u in enumerate(urls):
        r = rng.random()
        to = hot if r < 0.33 and i % 7 else rng.choice(urls) if r < 0.45 else None
        tag = "" if to is None else (CANONICAL if rng.random() < 0.5 else REFRESH) % to
        if rng.random() < 0.1:
            tag = f"<!-- {CANONICAL % rng.choice(urls)} --><script>'{CANONICAL % rng.choice(urls)}'</script>" + tag
        if to is not None:
            edges.append((u, to))
        rows.append((i, u, f"<html>{tag}</html>"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    node = lambda u: u.split("://")[1]
    for a, b in edges:
        parent[root(node(a))] = root(node(b))
    members = {}
    for u in urls:
        members.setdefault(root(node(u)), []).append(u)

    def expected(u):
        own = _rule(*_parts(u))[1]
        if own:
            return own
        verdicts = {_rule(*_parts(x))[1] for x in members[root(node(u))]}
        return "block" if "block" in verdicts and "allow" not in verdicts else "allow"

    for keep in (len(rows), 400):
        part = rows[:keep]
        if keep < len(rows):  # few pages: small components, of which some are blocked
            parent.clear()
            members.clear()
            for (a, b), _ in zip([e for e in edges if e[1] != hot], range(60)):
                parent[root(node(a))] = root(node(b))
            for u in urls:
                members.setdefault(root(node(u)), []).append(u)
            kept = {a for (a, b), _ in zip([e for e in edges if e[1] != hot], range(60))}
            part = [(i, u, h if u in kept else "") for i, u, h in rows]
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(part, "page_id long, url string, html string")).collect()}
        assert got == {i: expected(u) for i, u, _ in part}


def test_pages_without_hosts_and_long_pages(spark):
    rows = [(i, None, None) for i in range(300)] + [(400, "http://a.net/1", "z" * 1_000_000 + CANONICAL % "http://x.com/de/1"), (401, "http://x.com/de/1", "<!-- open")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[400] == got[401] == "block" and len(got) == 302


# Near-dedup.


def _distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_distance_against_the_full_table():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice([2, 4, 30])
        a = [rng.randrange(letters) for _ in range(rng.randrange(25))]
        b = [x if rng.random() < 0.8 else rng.randrange(letters) for x in a if rng.random() < 0.9]
        most, d = rng.randrange(14), _distance(a, b)
        got = near_dedup.banded_distance(a, b, most)
        assert got == d if d <= most else got > most or got == d
        if max(len(a), len(b)):
            s = rng.choice([0.5, 0.8])
            assert near_dedup.alike(np.array(a, np.uint16), np.array(b, np.uint16), s) == (d <= int((1 - s) * max(len(a), len(b)) + 1e-9))


def test_order_matters_to_a_sketch():
    words = [f"w{i}" for i in range(200)]
    same = near_dedup.sketch(near_dedup.word_hashes(" ".join(words)))
    swapped = near_dedup.sketch(near_dedup.word_hashes(" ".join(words[100:] + words[:100])))
    assert (same == near_dedup.sketch(near_dedup.word_hashes(" ".join(words).upper()))).all()
    assert 0 < (same == swapped).sum() < 25


def test_recall_against_brute_force(docs):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    seqs = {r["doc_id"]: (near_dedup.word_hashes(r["text"]) >> np.uint64(48)).astype(np.uint16) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(seqs)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(seqs[a]) and near_dedup.alike(seqs[a], seqs[b])]
    assert len(pairs) > 10
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert all(got[i] == i for i in ids if i not in linked)


def test_planted_copies_in_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]

    def near():
        words = list(base)
        words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, near()) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(100)] + [(500 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame).collect()}
    assert all(got[i] == 0 for i in [*range(150), *range(200, 300)])
    assert all(got[500 + i] == 500 + i for i in range(60))
    assert near_dedup.keep_first(frame).count() == 61


def test_isolated_pairs_near_the_threshold_share_a_sketch():
    rng = np.random.default_rng(4)
    for similarity, least in ((0.8, 193), (0.82, 196), (0.84, 198), (0.86, 199)):
        met = 0
        for _ in range(200):
            a = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
            b, at = a.copy(), rng.choice(300, round(300 * (1 - similarity)), replace=False)
            b[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
            met += bool((near_dedup.sketch(a, near_dedup.SKETCHES) == near_dedup.sketch(b, near_dedup.SKETCHES)).any())
        assert met >= least, similarity


def test_members_that_are_like_neither_end_of_their_bucket(spark):
    rng = random.Random(8)
    original = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def copy():  # 0.88 like the original, 0.77 like another copy
        words = list(original)
        for at in rng.sample(range(300), 36):
            words[at] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    rows = [(i, " ".join(original) if i == 150 else copy()) for i in range(300)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # by brute force over all pairs of each bucket
    texts = {i: near_dedup.word_hashes(t) for i, t in rows}
    seqs, buckets, parent = {i: (h >> np.uint64(48)).astype(np.uint16) for i, h in texts.items()}, {}, {i: i for i in texts}
    for i, h in texts.items():
        for s in near_dedup.sketch(h, near_dedup.SKETCHES).tolist():
            buckets.setdefault(s, []).append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for found in buckets.values() for k, a in enumerate(found) for b in found[k + 1 :]}:
        if find(a) != find(b) and near_dedup.alike(seqs[a], seqs[b]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {i: find(i) for i in texts}
    assert len(set(got.values())) < 15


def test_alike_texts_share_a_rare_word():
    rng = random.Random(11)
    for similarity in (0.6, 0.8, 0.9):
        for _ in range(600):
            n, letters = rng.randint(1, 60), rng.choice([3, 30, 1000])
            a = [rng.randrange(letters) for _ in range(n)]
            b = list(a)
            for _ in range(int((1 - similarity) * n * rng.random() * 1.4)):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 1)] = [rng.randrange(letters)] * rng.randint(0, 1)
                b = b or a[:1]
            x, y = np.array(a, np.uint16), np.array(b, np.uint16)
            if near_dedup.alike(x, y, similarity):
                pairs = [near_dedup.labelled_kmers(v.astype(np.uint64), 1).tolist() for v in (x, y)]
                rank = {k: rng.random() for k in {*pairs[0], *pairs[1]}}  # any order that both share
                first = [set(sorted(p, key=rank.get)[: near_dedup.prefix_size(len(v), similarity)]) for p, v in zip(pairs, (x, y), strict=True)]
                assert first[0] & first[1]
                counts = np.array([rng.choice([0, 1, 50]) for _ in range(near_dedup.GROUPS)]) if not rng.randrange(100) else np.zeros(near_dedup.GROUPS, dtype=np.int64)
                assert set(near_dedup.rarest(x, counts, similarity)[0].tolist()) & set(near_dedup.rarest(y, counts, similarity)[0].tolist())


def test_unlike_texts_with_a_common_passage(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(110)]
    rows = []
    for i in range(400):
        at = rng.randrange(50)
        own = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        rows.append((i, " ".join([*own[:at], *passage, *own[at:]])))
    for k in range(20):  # near copies of some of them
        words = rows[10 * k][1].split()
        for at in rng.sample(range(160), 25):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((1000 + k, " ".join(words)))
    compared = []
    links = near_dedup._links

    def counted(pairs, payload, similarity):
        compared.append(pairs.count())
        return links(pairs, payload, similarity)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(400)}, **{1000 + k: 10 * k for k in range(20)}}
    assert sum(compared[1:]) < 1000  # of 88,000


def test_no_marks_rule_a_link_out():
    rng = random.Random(13)
    for _ in range(300):
        n, letters = rng.randint(1, 300), rng.choice([2, 30, 60_000])
        a = [rng.randrange(letters) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, n // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randrange(letters)] * rng.randint(0, 1)
        x, y = np.array(a, np.uint16), np.array(b, np.uint16)
        edits = near_dedup.banded_distance(a, b, len(a) + len(b))
        p, q = (np.unpackbits(near_dedup.marks(v).view(np.uint8)).astype(int) for v in (x, y))
        assert max(p.sum(), q.sum()) - (p & q).sum() <= edits


def test_unlike_texts_of_common_words_are_not_aligned(spark, monkeypatch):
    """Texts that share three quarters of their words and still more by chance: their bags allow a link, their words do not."""
    rng = random.Random(14)
    passage = [w for _ in range(150) for w in ("is", "so")]
    rows = [(i, " ".join([*(f"w{rng.randrange(1500)}" for _ in range(100)), *passage])) for i in range(150)]
    words = rows[7][1].split()
    for at in rng.sample(range(400), 60):
        words[at] = f"x{rng.randrange(10**9)}"
    rows.append((1000, " ".join(words)))
    aligned = []
    links = near_dedup._links

    def counted(pairs, payload, similarity):
        aligned.append(pairs.count())
        return links(pairs, payload, similarity)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(150)}, 1000: 7}
    assert sum(aligned[1:]) < 2000  # of 11,175


def _alike_copies_and_common_passages(rng):
    base = [f"b{rng.randrange(80)}" for _ in range(100)]
    rows = []
    for i in range(70):  # like the original, but hardly like one another
        words = list(base)
        for at in rng.sample(range(100), 12):
            words[at] = f"c{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows.append((35_000, " ".join(base)))
    passage = ["is", "so"] * 60
    return rows + [(50_000 + i, " ".join([*(f"w{rng.randrange(60)}" for _ in range(rng.randint(30, 50))), *passage])) for i in range(60)]


@pytest.mark.parametrize(("hot", "block"), [(1, 7), (300, 512), (10**9, 512)])
def test_no_pair_is_lost_between_blocks_and_joins(spark, monkeypatch, hot, block):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    made, find = [], near_dedup._pairs_of_classes

    def kept(texts, similarity):
        cold, blocks, paths = find(texts, similarity)
        made.append(([tuple(r) for r in cold.collect()], [tuple(r) for r in blocks.collect()], texts.select("doc_id", "class", "payload").collect()))
        return cold, blocks, paths

    monkeypatch.setattr(near_dedup, "_pairs_of_classes", kept)
    near_dedup.classes(spark.createDataFrame(_alike_copies_and_common_passages(random.Random(15)), "doc_id long, text string")).collect()
    cold, blocks, texts = made[0]
    codes = {r["doc_id"]: np.frombuffer(r["payload"], np.uint16) for r in texts}
    kinds = {r["doc_id"]: r["class"] for r in texts}
    links = {(a, b) for a in codes for b in codes if a > b and kinds[a] != kinds[b] and near_dedup.alike(codes[a], codes[b])}
    assert len(links) > 15 and links <= {*cold, *blocks}
    assert len({*cold, *blocks}) == len(cold) + len(blocks)
    assert bool(blocks) == (hot < 10**9) and (hot > 1 or not cold)
    for a, b in blocks:
        common = sum((Counter(codes[a].tolist()) & Counter(codes[b].tolist())).values())
        assert kinds[a] != kinds[b] and common >= 0.8 * max(len(codes[a]), len(codes[b]))


def test_texts_of_a_hot_word_are_not_joined_pair_by_pair(spark, monkeypatch):
    rng = random.Random(16)
    passage = ["is", "so"] * 135
    rows = [(i, " ".join([*(f"w{rng.randrange(500)}" for _ in range(130)), *passage])) for i in range(300)]
    words = rows[7][1].split()
    for at in rng.sample(range(400), 60):
        words[at] = f"x{rng.randrange(10**9)}"
    rows.append((1000, " ".join(words)))
    joined, aligned, fitting, links = [], [], near_dedup._fitting, near_dedup._links

    def counted(pairs, known, fits):
        joined.append(pairs.count())
        return fitting(pairs, known, fits)

    def counted_links(pairs, payload, similarity):
        aligned.append(pairs.count())
        return links(pairs, payload, similarity)

    monkeypatch.setattr(near_dedup, "HOT", 500, raising=False)
    monkeypatch.setattr(near_dedup, "_fitting", counted)
    monkeypatch.setattr(near_dedup, "_links", counted_links)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(300)}, 1000: 7}
    assert sum(joined[1:]) + sum(aligned[1:]) < 2000  # of 44,850


def test_buckets_of_the_same_members_are_compared_once(spark):
    rows = [(sketch, doc, doc % 2) for sketch in (3, -7, 9) for doc in range(4)] + [(5, doc, doc % 2) for doc in range(1, 4)] + [(6, doc, 1) for doc in (1, 3)]
    mixed, _ = near_dedup._mixed_buckets(spark.createDataFrame(rows, "sketch long, doc_id long, class long"))
    assert sorted(tuple(r) for r in mixed.collect()) == sorted(r for r in rows if r[0] in (-7, 5))


def test_rows_of_the_rest_do_not_grow_with_the_length_of_texts(spark, monkeypatch):
    """Texts that share a passage: each comes once for each of its buckets, not once for each of its rare words."""
    rng, rows = random.Random(17), []
    passage = " ".join(f"p{i}" for i in range(200))
    frame = spark.createDataFrame([(i, f"{passage} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(800))}") for i in range(80)], "doc_id long, text string")
    find = near_dedup._pairs_of_classes

    def kept(texts, similarity):
        rows.extend(texts.collect())
        return find(texts, similarity)

    monkeypatch.setattr(near_dedup, "_pairs_of_classes", kept)
    assert {r["class_id"] for r in near_dedup.classes(frame).collect()} == set(range(80))
    assert rows and all("rare" not in r and len(r["sketches"]) <= near_dedup.SKETCHES for r in rows)


def test_stored_tables_leave_no_shuffles(spark):
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
        return {f for f in found if "shuffle_" in f}

    before = shuffles()
    stored, _ = common.store(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and stored.count() == 100
    assert spark.conf.get(common._CLEANUP, "false") == "false"


def test_near_dedup_of_odd_rows(spark):
    rows = [(None, None, "e"), (1, "", "e"), (2, "a b", "s"), (2, "a b", "s"), (4, "a b", "s"), (5, "zz", "e"), (None, "a b", "e"), (6, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    assert sorted(map(str, (tuple(r) for r in near_dedup.classes(frame).collect()))) == sorted(map(str, [(None, None), (1, 1), (2, 2), (2, 2), (4, 2), (5, 5), (None, None), (6, 6)]))
    kept = near_dedup.keep_first(frame)
    assert kept.columns == frame.columns and kept.count() == 7
    assert near_dedup.classes(frame.limit(0)).count() == 0


# Mixing.


def _waterfill(sizes, weights, most=3.0):
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / share
        over = {i for i in free if out[i] > most * sizes[i] + 1e-9}
        if not over:
            break
        for i in over:
            out[i] = most * sizes[i]
        free -= over
    return out


def test_targets_against_resharing(spark):
    rng = random.Random(3)
    for _ in range(6):
        names = [*(f"s{i}" for i in range(rng.randint(1, 12))), None]
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 5000)]) for _ in names]
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        order = [*sorted(n for n in names if n is not None), None]
        by = dict(zip(names, sizes, strict=True))
        expected = _waterfill([by[n] for n in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
        for n, e in zip(order, expected, strict=True):
            assert got[n] == pytest.approx(e, abs=1e-6)


def test_mix_meets_targets_and_reruns_agree(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, largest = {}, {}, {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(copies.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in rows)


def test_inclusion_probabilities_are_solved_with_certain_documents(spark):
    """By bisection: c makes the expected words those that are left, documents with c * x of 1 or more being certain."""
    rng = random.Random(51)
    sizes = {"a": [rng.choice([3, 40, 900, 20_000]) for _ in range(300)], "b": [rng.randint(1, 60) for _ in range(100)], "c": [5] * 40}
    rows, i = [], 0
    for source, many in sizes.items():
        for n in many:
            rows.append((i, " ".join(["w"] * n), source))
            i += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = {r["source"]: r for r in mixing.plan(mixing._base(frame, mixing.SEED)).collect()}
    got = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    for source, many in sizes.items():
        r = table[source]
        left = r["target"] - r["__mix_whole"] * r["source_size"]
        x = [round(np.log1p(n) * 1024) for n in many]
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(1.0, mid * y) for n, y in zip(many, x, strict=True)) < left else (lo, mid)
        assert sum(n * min(1.0, r["__mix_c"] * y) for n, y in zip(many, x, strict=True)) == pytest.approx(left, rel=1e-9, abs=1e-6)
        assert r["__mix_c"] == pytest.approx(lo, rel=1e-6, abs=1e-12)
        for (d, _, s), y in zip([row for row in rows if row[2] == source], x, strict=True):
            if r["__mix_c"] * y >= 1:
                assert got[d]["taken"] >= (r["__mix_whole"] + 1) * got[d]["size"]
    taken = {s: sum(got[d]["taken"] for d, _, t in rows if t == s) for s in sizes}
    assert all(abs(taken[s] - table[s]["target"]) <= max(sizes[s]) / 2 + 1 for s in sizes)


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", None, 2), (2, "a b", "s", 3), (2, "a b", "s", 3), (3, "a b c", "t", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(frame).collect()
    assert len(got) == 5 and {r["doc_id"]: r["size"] for r in got} == {None: 0, 1: 0, 2: 2, 3: 2}
    assert mixing.apply_mix(frame).columns == frame.columns
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.apply_mix(frame.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, source string, size int")
    assert [r["taken"] for r in mixing.mix(nulls).collect()] == [0, 0, 0]
    long = spark.createDataFrame([(1, "word " * 400_000, "s"), (2, "a b", "t")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(long).collect()} == {1: 400_000, 2: 2}


# Chats.


def test_parse_quotes():
    own, quotes = chat.parse("On Monday, Bob wrote:\n> Hi there.\n> > older\n> back\n\nMy answer.\n>> deep\nend")
    assert own == "My answer.\nend"
    assert quotes == [(1, "Hi there."), (2, "older"), (1, "back"), (2, "deep")]
    assert chat.parse(None) == ("", []) and chat.parse("a > b") == ("a > b", [])


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Fine!\n\nAnd the weather?"), (1, 2, "user", "On Monday, Bob wrote:\n> Hello there.\n> How are you?\n\nGood too."),
        (1, 3, "assistant", "> Good too.\nThanks"), (1, 4, "user", "> and the   WEATHER?\nRain"), (1, 5, "user", "> unknown\nhm"), (None, 1, "user", "x"), (2, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("root", F.lit(1))
    got = chat.link(frame).where("conv_id = 1").orderBy("thread", "turn").collect()
    assert [(r["thread"], r["turn"], r["reply_to"], r["depth"], r["text"]) for r in got] == [
        (0, 0, None, 0, "Hello there.\nHow are you?"), (0, 2, 0, 1, "Good too."), (0, 3, 2, 2, "Thanks"), (0, 5, None, 0, "hm"), (1, 1, None, 0, "Fine!\n\nAnd the weather?"), (1, 4, 1, 1, "Rain"),
    ]
    assert chat.link(frame).count() == len(rows) and chat.link(frame.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["turn"], r["thread"], r["depth"]) for r in got} == {(i, 0, i) for i in range(40)}


def test_random_quote_trees_against_brute_force(spark):
    """Messages that quote a whole earlier one, one sentence of it, or it wrapped anew, below other quotes or not."""
    rng = random.Random(41)
    rows, expected = [], {}
    for conv in range(60):
        turns = 150 if conv == 0 else rng.randint(1, 12)
        texts = []
        for turn in range(turns):
            sentences = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(".!?") for _ in range(rng.randint(1, 6))]
            own, cut = "", 0
            while cut < len(sentences):
                n = rng.randint(1, 3)
                own += " ".join(sentences[cut : cut + n]) + rng.choice(["\n", "\n\n"])
                cut += n
            own = own.strip()
            reply, quote = None, ""
            if turn and rng.random() < 0.7:
                reply = rng.randrange(turn)
                original, kind = texts[reply], rng.randrange(4)
                if kind == 0:
                    quoted = original
                elif kind == 1:
                    quoted = rng.choice(original.split("\n\n"))
                elif kind == 2:
                    quoted = rng.choice(re.split(r"(?<=[.!?])\s+", original))
                else:
                    words, quoted = rng.choice(original.split("\n\n")).split(), ""
                    for k, w in enumerate(words):
                        quoted += w + (" " if k % 5 else "\n")
                mark = "> " if rng.random() < 0.8 else ">> "
                quote = rng.choice(["", "On Monday, somebody wrote:\n"]) + "".join(f"{mark}{line.upper() if rng.random() < 0.2 else line}\n" for line in quoted.strip().split("\n") if line.strip())
                if mark == "> " and rng.random() < 0.3:
                    quote += f">> {texts[rng.randrange(turn)].split(chr(10))[0]}\n"
            texts.append(own)
            rows.append((conv, turn, "user", f"{quote}\n{own}"))
            expected[conv, turn] = reply
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == expected
    for (conv, turn), r in got.items():
        way, depth = turn, 0
        while expected[conv, way] is not None:
            way, depth = expected[conv, way], depth + 1
        assert r["depth"] == depth and (depth == 0 or r["thread"] == way)
        assert ">" not in r["text"]


def test_quotes_of_sentences_and_of_deeper_levels(spark):
    rows = [
        (1, 0, "user", "First thing. Second thing! Is there a third?"), (1, 1, "user", "Nothing of it."), (1, 2, "user", "> second   thing!\nYes."), (1, 3, "user", ">> Nothing of it.\nDeep."), (1, 4, "user", "> unknown\n>> Is there a\n>> third?\nNo."),
        (1, 5, "user", "> Yes.\n>> First thing.\nBoth."), (2, 0, "user", "On " + "x" * 5000 + " wrote:\n> nobody\nlong"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["text"]) for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): 0, (1, 5): 2, (2, 0): None}
    assert got[2, 0][1] == "long"


# Pipeline.


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    now, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    out = corpus_pipeline.run(spark, sf).collect()
    assert all(r["parity"] and r["round_trip"] for r in out) and len(out) == counts[4]


def _pipeline_of(spark, folder, rows, schema):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, very long texts, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, sketch long, node long, __near long, size int, link long"
    tail = (1, 2, 3, 4, 5)
    english = "the cat sat on the mat and the dog lay near the old door while the rain fell softly outside"
    assert _pipeline_of(spark, tmp_path / "empty", [], schema) == []
    assert _pipeline_of(spark, tmp_path / "nulls", [(None,) * 10] * 4, schema) == []
    rows = [
        (1, english, "en", "s", 5, *tail), (1, english, "en", "s", 5, *tail), (2, english, "en", "s", 5, *tail), (3, None, "en", "s", 5, *tail), (4, "", None, None, None, *(None,) * 5), (5, "12 34", "en", "s", 5, *tail),
        (6, "der hund und die katze liegen vor der alten tür und schlafen den ganzen tag", "de", "t", 5, *tail), (7, f"{english} again " * 3000, "en", None, 5, *tail), (None, english + " today", "en", "s", 5, *tail),
    ]
    got = _pipeline_of(spark, tmp_path / "odd", rows, schema)
    assert all(r["parity"] and r["round_trip"] for r in got)
    kept = {r["doc_id"] for r in got}
    assert {2, 3, 4, 5}.isdisjoint(kept) and kept <= {None, 1, 6, 7}


def test_stages_keep_columns_with_any_names(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"word{i * 50 + k}" for k in range(40)), "en", f"s{i % 3}", 5, i, "x", 1.0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class long, digest string, target double")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    by_id = {r[0]: r for r in rows}
    assert all(tuple(r) == by_id[r["doc_id"]] for r in now.collect())
