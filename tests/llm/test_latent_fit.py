import numpy as np
import pyarrow as pa

from insightframe.llm import decontaminate

from .helpers import EDGES, prose, table


def documents():
    return EDGES + [(i, prose(i, 1 + i * 37 % 300)) for i in range(40)] + [(50, "one " * 400), (51, prose(51, 64)), (52, prose(52, 65))]


def test_fit_reads_the_texts_once(spark):
    """Words are told apart and hashed once, not in the frequencies' pass and in each of the products'."""
    read, rows = spark.sparkContext.accumulator(0), documents()

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = table(spark, rows)
    items = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    vectors, _ = decontaminate.latent_space(docs.mapInArrow(counted, docs.schema), items, rank=4)
    assert read.value == len(rows) and np.isfinite(vectors).all() and vectors.any()


def test_product_against_plain_vectors(spark):
    rows = documents()
    terms = decontaminate._word_terms(table(spark, rows).select("text"))
    df, n = decontaminate.document_frequencies(terms)
    words = [decontaminate._terms(decontaminate._words(pa.array([t], pa.string()))[2]) for _, t in rows]
    want = np.zeros_like(df)
    for w in words:
        want[np.unique(w)] += 1
    assert n == len(rows) and (df == want).all()
    r = np.random.default_rng(1)
    idf, x = r.uniform(0.1, 5, len(df)), r.standard_normal((len(df), 3))
    product = np.zeros((len(df), 3))
    for w in words:
        for lo in range(0, len(w), decontaminate.FIT_WINDOW):
            t, tf = np.unique(w[lo:lo + decontaminate.FIT_WINDOW], return_counts=True)
            a = tf * idf[t]
            a = a / np.sqrt((a * a).sum()) * np.sqrt(2.5)
            product[t] += a[:, None] * (a @ x[t])
    got = decontaminate._gram_product(terms.selectExpr("terms", "2.5D weight"), idf, x)
    assert np.allclose(got, product, rtol=1e-4, atol=1e-5)


def test_sums_of_runs_and_windows():
    r = np.random.default_rng(2)
    source, index, weight = r.standard_normal((50, 8)).astype(np.float32), r.integers(0, 50, 9000), r.random(9000).astype(np.float32)
    length = np.array([1, 2, 3, 63, 64, 65, 128, 4000, 4674])
    start = np.cumsum(length) - length
    want = [(source[index[s:s + n]] * weight[s:s + n, None]).sum(axis=0) for s, n in zip(start, length, strict=True)]
    assert np.allclose(decontaminate.run_sums(source, index, start, length, weight), want, rtol=1e-4, atol=1e-3)
    first = np.cumsum([0, 0, 1, 2, 7, 40, 0, 133, 24, 0])
    term = r.integers(0, 50, first[-1])
    sums = decontaminate._Prefix(term, first, source)
    for size in (8, 16, 24, 40):
        doc, lo, hi = decontaminate.windows(first, size)
        want = [source[term[a:b]].sum(axis=0) for a, b in zip(lo, hi, strict=True)]
        assert np.allclose(sums.between(doc, lo, hi), want, atol=1e-4)


def test_item_words_are_found_in_their_terms():
    items = decontaminate.Items([(i, prose(i, 5 + i, 4000)) for i in range(60)], np.ones((1 << decontaminate.TERM_BITS, 2), np.float32))
    h = np.append(np.random.default_rng(3).permutation(items.vocabulary), [np.uint64(0), np.uint64(2**64 - 1), items.vocabulary[5] + np.uint64(1)])
    want = [np.flatnonzero(items.vocabulary == x)[0] if x in items.vocabulary else len(items.vocabulary) for x in h]
    assert items.known(h, decontaminate._terms(h)).tolist() == want
    # words that share a term are told apart
    items.vocabulary = np.array([5, 6, 9], np.uint64)
    items.first = np.searchsorted(decontaminate._terms(items.vocabulary), np.arange((1 << decontaminate.TERM_BITS) + 1))
    h = np.array([9, 5, 7, 6, 10, 1], np.uint64)
    assert items.known(h, decontaminate._terms(h)).tolist() == [2, 0, 3, 1, 3, 3]
