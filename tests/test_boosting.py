"""Leaf-wise histogram boosting and local attributions against plain versions."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from insightframe.operators import attributions as at
from insightframe.operators import boosting as bo


def rows(n=2000, seed=3):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=n), r.integers(0, 4, n).astype(float), r.random(n) ** 3, (r.random(n) < 0.2).astype(float), r.normal(size=n)], axis=1)
    raw = 1.5 * x[:, 0] * (x[:, 1] > 1) - 2.0 * (x[:, 2] > 0.3) + x[:, 3]
    return x, (raw + r.normal(size=n) > 0).astype(float), raw + 0.1 * r.normal(size=n), 0.5 + r.random(n)


def frame(spark, x, y, w):
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y double, w double")
    return df.select(array_to_vector("x").alias("features"), "y", "w").repartition(3)


def plain_boosting(x, y, w, s, cuts):
    """One split at a time, by trying every cut of every leaf: [(feature, threshold) in split order], scores."""
    mean = (y * w).sum() / w.sum()
    score = np.full(len(y), mean if s.task == "regression" else math.log(mean / (1 - mean)))
    trees = []
    for _ in range(s.iterations):
        p = 1 / (1 + np.exp(-score))
        g, h = (w * (score - y), w) if s.task == "regression" else (w * (p - y), w * p * (1 - p))

        def best(rows_):
            found = (1e-12, None, None)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = x[rows_, f] <= c
                    a, b = rows_[left], rows_[~left]
                    if min(len(a), len(b)) < s.min_rows or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows_].sum() ** 2 / h[rows_].sum()
                    if gain > found[0] * (1 + 1e-9):
                        found = (gain, f, c)
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        splits = []
        while len(leaves) < s.leaves:
            i = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
            rows_, (_, f, c) = leaves.pop(i)
            if f is None:
                leaves.append((rows_, (0, None, None)))
                break
            splits.append((f, c))
            for side in (rows_[x[rows_, f] <= c], rows_[x[rows_, f] > c]):
                leaves.append((side, best(side)))
        for rows_, _ in leaves:
            score[rows_] += -s.rate * g[rows_].sum() / h[rows_].sum()
        trees.append(sorted(splits))
    return trees, score


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_splits_equal_plain_growth(spark, task):
    x, label, value, w = rows()
    y = label if task == "classification" else value
    s = bo.BoostSettings(task, iterations=3, leaves=8, max_bins=24)
    df = frame(spark, x, y, w)
    model = bo.HistogramBoosting(s, "y", "w").fit(df)
    cuts = bo.cut_points(df.select(vector_to_array("features").alias("x")), 5, s.max_bins)
    want, score = plain_boosting(x, y, w, s, cuts)
    got = [sorted((int(f), float(c)) for f, c, k in zip(t.feature, t.threshold, t.left, strict=True) if k >= 0) for t in model.trees]
    assert got == [[(f, float(c)) for f, c in t] for t in want]
    assert np.abs(model.raw(x) - score).max() < 1e-9
    told = model.score(df, "p").select("p", vector_to_array("features").alias("x")).collect()
    raw = model.raw(np.array([r.x for r in told]))
    assert np.abs(np.array([r.p for r in told]) - (raw if task == "regression" else 1 / (1 + np.exp(-raw)))).max() < 1e-12


def test_boosting_edges(spark):
    x, label, _, w = rows(60)
    same = frame(spark, np.ones((60, 2)), label, w)
    model = bo.HistogramBoosting(bo.BoostSettings(iterations=3), "y").fit(same)
    assert model.trees == [] and abs(model.raw(np.ones((1, 2)))[0] - math.log(label.mean() / (1 - label.mean()))) < 1e-12
    for y in (np.ones(60), np.zeros(60)):
        with pytest.raises(ValueError):
            bo.HistogramBoosting(bo.BoostSettings(), "y").fit(frame(spark, x, y, w))
    with pytest.raises(ValueError):
        bo.HistogramBoosting(bo.BoostSettings(), "y").fit(same.where("w < 0"))


def test_leaves_and_rows_are_bounded(spark):
    x, label, _, w = rows(3000, 5)
    model = bo.HistogramBoosting(bo.BoostSettings(iterations=4, leaves=31), "y", "w").fit(frame(spark, x, label, w))
    for t in model.trees:
        assert (t.left < 0).sum() <= 31
        assert np.bincount(t.leaf_of(x), minlength=len(t.left))[t.left < 0].min() >= 20
        assert abs(t.cover[0] - w.sum()) < 1e-6


def by_subsets(model, x):
    """Shapley values by all subsets of the features, unknown ones following both branches by cover."""
    d = len(x)

    def value(known):
        total = model.base
        for t in model.trees:
            def walk(n):
                if t.left[n] < 0:
                    return t.value[n]
                a, b = int(t.left[n]), int(t.right[n])
                if t.feature[n] in known:
                    return walk(a if x[t.feature[n]] <= t.threshold[n] else b)
                return (t.cover[a] * walk(a) + t.cover[b] * walk(b)) / t.cover[n]
            total += walk(0)
        return total

    out = np.zeros(d)
    for f in range(d):
        others = [g for g in range(d) if g != f]
        for k in range(d):
            for known in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                out[f] += weight * (value({*known, f}) - value(set(known)))
    return out, value(set())


def test_tree_attributions_equal_all_subsets(spark):
    x, label, _, w = rows()
    model = bo.HistogramBoosting(bo.BoostSettings(iterations=4, leaves=12), "y", "w").fit(frame(spark, x, label, w))
    got = at.tree_attributions(model, x)
    assert np.abs(got.sum(axis=1) + at.base_value(model) - model.raw(x)).max() < 1e-9
    for i in range(0, 2000, 250):
        want, base = by_subsets(model, x[i])
        assert np.abs(got[i] - want).max() < 1e-9 and abs(base - at.base_value(model)) < 1e-9


def test_attributions_of_a_table(spark):
    x, label, _, w = rows(300)
    df = frame(spark, x, label, w).withColumn("id", F.monotonically_increasing_id())
    model = bo.HistogramBoosting(bo.BoostSettings(iterations=3, leaves=6), "y", "w").fit(df)
    names = ["a", "b", "c", "b", "e"]  # columns 1 and 3 are parts of one original column
    got = at.attributions(model, df, names, ["id"])
    assert got.count() == 300 * 4
    told = {r.id: np.array(r.x) for r in df.select("id", vector_to_array("features").alias("x")).collect()}
    total = {r.id: r.s for r in got.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    for i, v in told.items():
        assert abs(total[i] + at.base_value(model) - model.raw(v[None])[0]) < 1e-9
    assert at.attributions(model, df.where("id < 0"), names, ["id"]).count() == 0


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, -3.0), (6.0, 0.5)], "a double, b double")
    parts = at.linear_attributions({"a": 2.0, "b": -1.5}, {"a": 3.0, "b": 0.5})
    for r in df.select("a", "b", *[c.alias(f"_{f}") for f, c in parts.items()]).collect():
        assert abs(r._a + r._b - (2.0 * r.a - 1.5 * r.b - (2.0 * 3.0 - 1.5 * 0.5))) < 1e-12
