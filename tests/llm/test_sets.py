"""Operators over the whole corpus: near duplicates, repeats, decontamination, search, pipeline."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from insightframe.llm import decontaminate, near_dedup, queries, suffix_dedup, topk_blocks
from insightframe.llm.components import components
from insightframe.llm.winnow import runs

from .helpers import EDGES, prose, table


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [
        (2000, 2001 + i) for i in range(200)] + [(5, 5)]
    got = {x.vertex: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- near duplicates


def shingles(text, k=4):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_corpus():
    r, docs = random.Random(4), []
    for b in range(30):
        base = prose(100 + b, 60).split()
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = f"v{r.randrange(999)}"
            docs.append((len(docs), " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    base = prose(999, 60).split()
    for _ in range(120):  # one large group of near copies
        w = list(base)
        w[r.randrange(60)], w[r.randrange(60)] = f"v{r.randrange(999)}", f"v{r.randrange(999)}"
        docs.append((len(docs), " ".join(w)))
    for k in range(120):  # a passage that many documents share
        docs.append((len(docs), prose(998, 30) + " " + prose(2000 + k, 3 + k % 30)))
    return docs + [(len(docs), "a b"), (len(docs) + 1, "A\tb"), (len(docs) + 2, "a b c"), (5, docs[5][1])] + EDGES


@pytest.mark.parametrize("options", [{}, {"small_node": 8, "max_depth": 4}, {"words": 5}])
def test_near_duplicates_match_all_pairs(spark, options, monkeypatch):
    if "small_node" in options:
        monkeypatch.setattr(near_dedup, "FEW_OTHERS", 3)
    docs = near_corpus()
    sets = {d: shingles(t, options.get("words", 4)) for d, t in docs if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(pairs, ids)
    rows = near_dedup.near_duplicates(table(spark, docs), **options).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id])), r


def test_near_duplicates_of_nothing(spark):
    empty = table(spark, EDGES).where("doc_id = -1")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one(empty).count() == 0


def test_keep_one_row_of_a_group(spark):
    docs = [(3, prose(1, 50)), (1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (None, "x"), (None, "x"), (7, None)]
    out = near_dedup.keep_one(table(spark, docs), words=5)
    assert out.columns == table(spark, docs).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "7", "None", "None"]


def test_linked_pairs_meet_in_a_tree():
    """Measured chance of meeting at depth 3 over 16 trees, for pairs right at the threshold."""
    r, met = np.random.default_rng(3), 0
    for _ in range(300):
        s = r.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = near_dedup.minhashes(s[:800 + 0]), near_dedup.minhashes(np.concatenate([s[:711], s[800:889]]))
        sketch = np.array([a, b])
        for tree in range(near_dedup.TREES):
            node, row = np.full(2, near_dedup.mix64(np.array([tree + 1], np.uint64))[0]), np.arange(2)
            for _ in range(near_dedup.DEPTH):
                node, row = near_dedup.branch(node, row, sketch)
            if set(node[row == 0].tolist()) & set(node[row == 1].tolist()):
                met += 1
                break
    assert met >= 299


# ---- repeats


def brute_repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(x for x in docs if x[0] is not None):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(raw[i:i + length])
        out[d] = (len(raw), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()),
                  hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeat_corpus(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé fg") for _ in range(r.randint(50, 400))) for _ in range(10)]
    docs = []
    for i in range(90):
        t = "".join(r.choice([r.choice(passages), "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 150)))])
                    for _ in range(r.randint(0, 5)))
        if t and r.random() < 0.5:
            at = r.randrange(len(t))
            t = t[:at] + "Z" + t[at + 1:]
        docs.append(((i * 7) % 97, "ab" * r.randint(0, 300) if r.random() < 0.1 else passages[0] if r.random() < 0.1 else t))
    return docs + [(1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 350), (1001, None), (1000, "")]


@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_match_a_set_of_strings(spark, group):
    docs = repeat_corpus(group)
    want = brute_repeats(docs, 100)
    rows = suffix_dedup.remove_repeats(table(spark, docs), 100, group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 5000
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_edges(spark):
    long = prose(1, 60)
    docs = [*EDGES, (None, long), (1, long), (2, long), (2, long)]
    rows = suffix_dedup.remove_repeats(table(spark, docs)).collect()
    assert len(rows) == len(docs)
    removed = sorted((r.doc_id, r.n_removed) for r in rows if r.doc_id is not None and r.doc_id < 9)
    assert removed == [(1, 0), (2, len(long)), (2, len(long))]  # the repeated row is one document
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert suffix_dedup.remove_repeats(table(spark, docs).where("doc_id = -1")).count() == 0


def test_deep_shallow_sorts_bytes():
    r = np.random.default_rng(6)
    rows = r.integers(0, 2, (700, 40)).astype(np.uint8)
    rows[:, :30] = rows[r.integers(0, 5, 700), :30]
    for shallow in (0, 1, 2, 5):
        order, lcp = suffix_dedup.deep_shallow(rows, shallow)
        text = [rows[i].tobytes() for i in order]
        assert text == sorted(x.tobytes() for x in rows)
        for a, b, n in zip(text, text[1:], lcp[1:], strict=False):
            assert n == next((i for i in range(40) if a[i] != b[i]), 40)


def test_every_string_owns_one_anchor():
    r = np.random.default_rng(8)
    docs = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in (0, 99, 100, 500, 70000)]
    raw = np.frombuffer(b"".join(docs), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    owned = np.zeros(len(raw), int)
    for start, count, _, _ in runs(raw, off, 100):
        for s, c in zip(start, count, strict=True):
            owned[s:s + c] += 1
    want = np.concatenate([np.arange(len(d)) + 100 <= len(d) for d in docs])
    assert (owned == want).all()


# ---- decontamination


def lcs_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_subsequence_length():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 40))] for _ in range(2))
        assert decontaminate.lcs_length(a, b) == lcs_table(a, b)


def test_planted_items_are_found(spark):
    items = [(i, prose(5000 + i, 12 + 3 * i, 3000).replace(" ", ". ", 1)) for i in range(25)] + [(90, None), (91, ""), (None, "x y z"), (92, "tiny item")]
    r, docs, want = random.Random(7), list(EDGES), set()
    for d in range(120):
        w = prose(d, r.randint(30, 400), 3000).split()
        if d % 3 == 0:
            i = r.randrange(25)
            words = items[i][1].split()
            if d % 2:  # a paraphrase: some words are others
                for at in range(0, len(words) // 2, 6):
                    words[at] = "other"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() for x in words]
            want.add((d, i))
        docs.append((d, " ".join(w)))
    docs.append((700, "the tiny item here"))
    want.add((700, 92))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(table(spark, docs), benchmark, fit_documents=100).collect()}
    exact = {(d, i) for d, i in want if d % 2 == 0}
    assert exact <= set(got) and len(set(got) & want) >= 0.9 * len(want)
    assert set(got) <= want  # nothing else
    split = decontaminate.contaminated(table(spark, docs), benchmark, item_block=7, fit_documents=100)
    assert {(x.doc_id, x.item_id) for x in split.collect()} == set(got)
    clean = decontaminate.keep_clean(table(spark, docs), benchmark, fit_documents=100)
    assert clean.columns == table(spark, docs).columns
    assert clean.count() == len(docs) - len({d for d, _ in got})


def test_latent_space_is_fitted_on_all_documents(spark):
    docs = [(d, " ".join(f"only{d}n{i}" for i in range(3))) for d in range(4300)]
    some = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    vectors, _ = decontaminate.latent_space(table(spark, docs), some, rank=4, power_steps=0)
    h = decontaminate._words(pa.array([t for _, t in docs]))[2]
    assert vectors[decontaminate._terms(h)].any(axis=1).all()


def planted_items():
    """Items of 3 to 110 words, each in a text of its own: verbatim, or with some words replaced."""
    r, items, texts, at = random.Random(3), [], [], []
    for m in (3, 4, 5, 6, 8, 10, 11, 12, 14, 16, 20, 26, 32, 40, 48, 70, 110):
        for kept in (1.0, 0.9, 0.8, 0.7, 0.65):
            i, host = len(items), prose(900 + len(items), 300, 4000).split()
            words = prose(7000 + i, m, 4000).split()
            items.append((i, " ".join(words[:-(m // 3)]) + ". " + " ".join(words[-(m // 3):])))
            for k in r.sample(range(m - m // 3), min(m - m // 3, int(m * (1 - kept)))):  # the answer stays
                words[k] = r.choice(host)
            at.append(r.randrange(len(host)))
            host[at[-1]:at[-1]] = words
            texts.append(" ".join(host))
    return items, texts, at


def test_latent_search_decides_and_finds(spark):
    """With the registered fit, at least nine in ten of the planted items that the checks accept, short
    and long, verbatim and paraphrased; with a space in which items lie elsewhere, no long one."""
    items, texts, at = planted_items()
    docs = table(spark, list(enumerate(texts)))
    vectors, _ = decontaminate.latent_space(docs, spark.createDataFrame(items, "item_id long, text string"))
    held = decontaminate.Items(items, vectors)
    _, _, h, first = decontaminate._words(pa.array(texts))
    want = {(d, d) for d in range(len(texts)) if held.check(d, h[first[d]:first[d + 1]], at[d], at[d] + 1)}
    got = {x[:2] for x in decontaminate._hits(pa.array(texts), held, vectors, decontaminate.LEAST_COSINE)}
    long = {p for p in want if len(held.words[p[1]]) >= decontaminate.WINDOW_WORDS}
    assert len(long) > 30 and len(want - long) > 20
    assert len(long & got) >= 0.9 * len(long) and want - long <= got
    elsewhere = decontaminate.Items(items, np.roll(vectors, 1, axis=0))
    lost = {x[:2] for x in decontaminate._hits(pa.array(texts), elsewhere, vectors, decontaminate.LEAST_COSINE)}
    assert len(long & lost) < 0.1 * len(long) and want - long <= lost


def test_no_items_and_no_documents(spark):
    docs = table(spark, EDGES)
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.keep_clean(docs, none).count() == len(EDGES)
    some = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert decontaminate.contaminated(docs.where("doc_id = -1"), some).count() == 0


def test_retrieval_against_brute_force(spark):
    """Recall of the latent search on the test tables: every item whose words stand in a document."""
    import re

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())) + " "
    texts = docs.text.map(norm)
    want = {(d, i) for i, t in zip(items.item_id, items.text, strict=True) for d in docs.doc_id[texts.str.contains(norm(t), regex=False)]}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, sf).collect()}
    assert want and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want) + 1


# ---- search


def brute_top(rows, ids, k):
    out = []
    for q, v in rows:
        if q in ids:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if c != q and len(w) == len(v) and w), )[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_matches_all_scores(spark):
    r = np.random.default_rng(4)
    raw = [(i, [float(x) for x in r.normal(size=6) * (1 + i % 3)]) for i in range(400)]
    raw += [(400 + i, raw[0][1]) for i in range(30)]  # ties
    raw += [(600, None), (601, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (602, [float("nan")] * 6), (603, [float("inf")] * 6),
            (None, [1.0] * 6), (604, []), (20, raw[20][1]), (700, [1.0, 2.0]), (720, [3.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in raw], "vec_id long, embedding array<double>, shard int, dim string").repartition(4)
    q = topk_blocks.quantised(df)
    clean = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in raw
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for options in ({}, {"shard_rows": 50, "batch_queries": 7}):
        got = sorted(tuple(x) for x in topk_blocks.top_k(q, q.where("vec_id % 20 = 0"), 20, **options).collect())
        assert got == brute_top(sorted(clean), {i for i, _ in clean if i % 20 == 0}, 20)
    assert topk_blocks.top_k(q.where("vec_id = -1"), q.where("vec_id = -1")).count() == 0


def test_blocks_are_skipped_but_nothing_is_lost():
    r = np.random.default_rng(9)
    rows = np.sort(r.integers(-50, 50, (1000, 4)), axis=0)
    ids, q = np.arange(1000), r.integers(-50, 50, (20, 4))
    who, at, score = topk_blocks.block_search(ids, rows, np.arange(20) + 5000, q, 7)
    for i in range(20):
        want = sorted(zip(-(rows @ q[i]), ids, strict=True))[:7]
        assert sorted(zip(-score[who == i], at[who == i], strict=True)) == [(s, c) for s, c in want]
    big = np.array([[1 << 40, 3], [1 << 41, -5]])
    _, at, score = topk_blocks.block_search(np.arange(2), big, np.array([9]), big[:1], 2)
    assert dict(zip(at.tolist(), map(int, score), strict=True)) == {0: (1 << 80) + 9, 1: (1 << 81) - 15}


# ---- pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    """Every stage on what the one before kept, against plain versions of the same rules."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held, kept = docs, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, sf)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        held = kept[name]
    texts = {name: {r.doc_id: r.text for r in kept[name].collect()} for name in ("quality", "near_dedup", "decontaminate", "secrets")}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.doc_id in texts["quality"]) for r in docs.collect() if r.doc_id in labels]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)
    sets = {d: shingles(t, 5) for d, t in texts["quality"].items()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(texts["near_dedup"]) == {d for d, g in groups(pairs, ids).items() if d == g}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(texts["decontaminate"]) <= set(texts["near_dedup"])
    assert not any(i in t for t in texts["decontaminate"].values() for i in items)
    assert set(texts["secrets"]) == set(texts["decontaminate"])
    from .test_rows import brute_base, check_packing

    assert not any(brute_base(t.replace("[SECRET]", " ")) for t in texts["secrets"].values())
    check_packing(kept["packing"].collect(), list(texts["secrets"].items()))
