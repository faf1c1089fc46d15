"""Centroid clusters, source audit and the n-gram join against plain versions."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from insightframe.llm import bisector_clusters as bc
from insightframe.llm import combination_join as cj
from insightframe.llm import source_audit as sa

from .helpers import EDGES, prose, table
from .test_sets import groups, near_corpus, shingles


# ---- centroid clusters


def plain_clusters(rows, clusters, rounds, size):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    names = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [list(v) for _, v in names[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        for j, vs in by.items():
            cents[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept] if cents else []
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for i, j, d in out), key=str)


VECTORS = "vec_id long, embedding array<double>, cluster int, row string, distance long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 9, "clash", None) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("wild", [False, True])
def test_clusters_equal_plain_rounds(spark, wild):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) + 3 * (i % 5) for _ in range(6)]) for i in range(200)]
    rows += [(i, list(rows[3][1])) for i in range(300, 320)] + [(3, list(rows[3][1]))]  # ties and a repeated row
    rows += [(400 + i, [float(i % 2)] * 6) for i in range(30)]
    rows += [(None, [0.5] * 6), (500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6),
             (504, [float("inf")] + [0.0] * 5), (505, [])]
    if wild:  # beyond what 64-bit products of a pass hold
        rows += [(600, [1e7, -1e7, 3e6, 0.0, 0.1, -0.1]), (601, [1e7] * 6)]
    got = bc.cluster(vectors(spark, rows), clusters=4, rounds=3, dimensions=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_clusters(rows, 4, 3, 6)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0])]
    got = bc.cluster(vectors(spark, rows), clusters=16, dimensions=2)
    assert sorted(tuple(x) for x in got.collect()) == plain_clusters(rows, 16, 3, 2)
    assert bc.cluster(vectors(spark, rows).where("vec_id = 7"), dimensions=2).count() == 0
    assert bc.cluster(vectors(spark, [(None, [1.0, 2.0])]), dimensions=2).count() == 0


def test_tournament_names_the_nearest_centroid():
    r = np.random.default_rng(2)
    cents = r.integers(-3, 4, (16, 3)).tolist()  # small grid: many ties and equal centroids
    rows = r.integers(-4, 5, (500, 3))
    field = bc.Bisectors(cents)
    apart = ((rows[:, None, :] - field.centroids[None]) ** 2).sum(axis=2)
    assert (field.winners(rows) == apart.argmin(axis=1)).all()
    assert (field.distances(rows, field.winners(rows)) == apart.min(axis=1)).all()


# ---- source audit


def plain_audit(rows, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for _, text, lang, source in rows]
    docs = [(a, b, [t.translate({c: c + 32 for c in range(65, 91)}) for t in ts]) for a, b, ts in docs]
    langs = defaultdict(set)
    for a, b, _ in docs:
        langs[a].add(b)
    out = []
    for lang, sources in langs.items():
        df = Counter(t for a, _, ts in docs if a == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= 3]
        n = {s: Counter(t for a, b, ts in docs if (a, b) == (lang, s) for t in ts if df[t] >= 3) for s in sources}
        whole = sum(n.values(), Counter())

        def p(count, term):
            return 1 + 10**9 * (count[term] + 1) // (sum(count.values()) + len(kept))

        for s in sources:
            pair = [(o, sum((p(n[s], t) - p(n[o], t)) ** 2 // p(n[o], t) for t in kept)) for o in sources if o != s]
            term = [(t, (p(n[s], t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if n[s][t] and p(n[s], t) > p(whole, t)]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def audit_rows():
    r = random.Random(8)
    rows = []
    for i in range(120):
        words = [r.choice(["the", "The,", "(the)", "über", "naïve-the", "a1b", "x_y", "http://u%d/x" % i, "w%d" % r.randrange(9), "中文", "a b"])
                 for _ in range(r.randrange(1, 25))]
        rows.append((i, r.choice([" ", "\n", "\t"]).join(words), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "ü"])))
    rows += [(200, "rare-only once", "en", "s1"), (200, "twice! twice? twice", "en", "s2"), (201, "(twice) [once", "en", "s2"), (201, "(twice) [once", "en", "s2")]
    rows += [(300, None, "en", "empty"), (301, "123 ...", "fr", "only"), (302, "", "fr", None), (303, "x" * 20000 + " é" * 300, "en", "long")]
    return rows + [(d, t, "en" if i % 2 else None, "s%d" % (i % 3)) for i, (d, t) in enumerate(EDGES)]


@pytest.mark.parametrize("options", [{}, {"block_terms": 3, "block_sources": 1}])
def test_audit_equals_plain_counts(spark, options):
    rows = audit_rows()
    got = sorted(tuple(x) for x in sa.divergence(table(spark, rows), **options).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows)


def test_audit_in_small_portions(spark):
    """Tasks that hold little at once: what they merge is the same."""
    rows = audit_rows()
    got = sorted(tuple(x) for x in sa.divergence(table(spark, rows), held_words=20, held_chunks=7).select(
        "lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows)


def test_merged_counts_keep_distinct_rows():
    r = np.random.default_rng(4)
    none = np.iinfo(np.int64).max
    key, n = r.integers(0, 40, 300), r.integers(1, 9, 300)
    many = r.integers(1, 4, 300)
    a, b = r.integers(0, 4, 300), r.integers(4, 7, 300)
    a, b = np.where(many < 3, a, none), np.where(many == 2, b, none)
    for k, total, m, x, y in zip(*sa.merged(key, n, many, a, b), strict=True):
        mine = key == k
        rows = set(a[mine & (many < 3)].tolist()) | set(b[mine & (many < 3)].tolist()) - {none}
        rows.discard(none)
        enough = (many[mine] == 3).any() or len(rows) >= 3
        assert total == n[mine].sum() and m == (3 if enough else len(rows))
        assert enough or sorted(v for v in (x, y) if v != none) == sorted(rows)


def test_audit_limits_and_nothing(spark):
    rows = audit_rows()
    got = sorted(tuple(x) for x in sa.divergence(table(spark, rows), top_terms=2).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 2)
    assert sa.divergence(table(spark, rows).where("doc_id = -1")).count() == 0


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([0, 7, 10**15, 3 * 10**15]), np.array([4 * 10**15] * 4)
    want = [1 + 10**9 * (int(a) + 1) // (int(b) + 12345) for a, b in zip(n, total, strict=True)]
    assert sa.shares(n, total, 12345).tolist() == want


# ---- n-gram join


def linked_groups(docs, words):
    sets = {d: shingles(t, words) for d, t in docs if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, groups(pairs, ids)


def template_corpus():
    """A hot template: all share most of their text, few are linked; and pairs right at the threshold."""
    r, docs, base = random.Random(6), [], prose(7, 140, 10**6).split()
    for i in range(150):
        tail = prose(5000 + i, 10 + i % 30, 10**6).split()
        docs.append((len(docs), " ".join(base + tail)))
        if i % 10 == 0:
            docs.append((len(docs), " ".join(base + tail[:-2])))
    for i in range(60):
        a = prose(9000 + i, 40, 10**6).split()
        b = list(a)
        for _ in range(r.randrange(3)):
            b[r.randrange(40)] = "z%d" % r.randrange(10**6)
        docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    return docs


@pytest.mark.parametrize("corpus,options", [
    (near_corpus, {}), (near_corpus, {"rare": 1, "cell": 4, "range_tokens": 500}), (template_corpus, {"rare": 2, "cell": 16}),
    (template_corpus, {}), (near_corpus, {"words": 3, "rare": 0})])
def test_join_equals_all_pairs(spark, corpus, options):
    docs = corpus()
    sets, want = linked_groups(docs, options.get("words", 5))
    rows = cj.jaccard_groups(table(spark, docs), **options).collect()
    assert len(rows) == len(docs)
    for x in rows:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.component_id, x.n_shingles) == (want[x.doc_id], len(sets[x.doc_id])), x


def test_join_with_hot_tokens_outside_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(cj, "HOT_SHARE", 1 << 9)  # nearly all shared tokens bypass the ranges
    docs = near_corpus()
    _, want = linked_groups(docs, 5)
    rows = cj.jaccard_groups(table(spark, docs), rare=2, range_tokens=300).collect()
    assert all(x.doc_id is None or x.component_id == want[x.doc_id] for x in rows)


def test_join_of_nothing_and_its_threshold(spark):
    empty = table(spark, EDGES).where("doc_id = -1")
    assert cj.jaccard_groups(empty).count() == 0
    with pytest.raises(ValueError):
        cj.jaccard_groups(empty, per_cent=50)


def test_linked_sets_share_a_signature():
    """Every linked pair of random sets has a signature in common, at any rarity bound."""
    r = random.Random(3)
    universe = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64))
    often = {int(t): r.choice([2, 3, 5, 17, 40, 900]) for t in universe}
    checked = 0
    for _ in range(3000):
        x = set(r.sample(universe.tolist(), r.randrange(4, 60)))
        y = set(x)
        for _ in range(r.randrange(1, 8)):
            (y.discard if r.random() < 0.5 else y.add)(r.choice(universe.tolist()))
        if x == y or 100 * len(x & y) < 80 * len(x | y):
            continue
        checked += 1
        for rare in (0, 4, 16, 1000):
            s = []
            for one in (x, y):
                token = np.array(sorted(one, key=lambda t: (often[t], t)), np.uint64)
                count = np.array([often[int(t)] for t in token])
                s.append(set(cj.signatures(len(one), token, count, 80, rare).tolist()))
            assert s[0] & s[1]
    assert checked > 300


def test_blocks_send_few_unlinked_pairs_and_every_linked_one(spark):
    r = np.random.default_rng(11)
    common = r.integers(0, 1 << 63, 75).astype(np.uint64)
    sets = [np.concatenate([common, r.integers(0, 1 << 63, 25).astype(np.uint64)]) for _ in range(120)]
    # partners that share 85 to 95 of 100 tokens: some linked, some not
    sets += [np.concatenate([x[:85 + i % 11], r.integers(0, 1 << 63, 15 - i % 11).astype(np.uint64)]) for i, x in enumerate(sets[:40])]
    sets = [np.unique(x) for x in sets]
    rows = [(7, i, len(x), len(x), i, bytearray(cj.sketch(x))) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "sig long, cls long, n long, k long, label long, sketch binary")
    for cell in (50, 512):
        out = [(p.a, p.b) for p in cj._cells(df.drop("sketch"), df.select("cls", "sketch"), 80, cell).collect()]
        linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                  if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)}
        assert len(linked) > 20 and linked <= set(out) and len(out) == len(set(out))
        assert len(out) < 2 * len(sets)  # of 12,720 pairs


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    r = np.random.default_rng(3)
    for n in (1, 50, 3000, 40_000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)]))
        bits = np.frombuffer(cj.sketch(x), np.uint64) ^ np.frombuffer(cj.sketch(y), np.uint64)
        assert np.bitwise_count(bits).sum(dtype=np.int64) <= len(np.setxor1d(x, y))
