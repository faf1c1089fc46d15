"""Random forest on histograms (ML4)."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from insightframe.operators import forest as rf
from insightframe.operators import models as md


def _rows(spark, task, n=600):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.random(n) < 0.01, rng.random(n)])
    signal = 2.0 * (x[:, 0] > 0.3) + (x[:, 1] == 2)
    y = np.round((signal + rng.normal(size=n)) * 4) / 4 if task == "regression" else (signal + rng.normal(size=n) > 1.5).astype(float)
    rows = [([float(v) for v in a], float(b), 1.0 + i % 2) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + rows[:50], "x array<double>, y double, w double")
    return df.select(array_to_vector("x").alias("features"), F.col("y").alias(md.Y), F.col("w").alias(md.W)), x, y


def test_a_forest_of_deep_trees_takes_few_jobs(spark):
    df, _, _ = _rows(spark, "classification")
    context = md.FitContext(md.ModelConfig(num_trees=100), 600.0, 1.0, 4)
    spark.sparkContext.setJobGroup("forest-jobs", "")
    try:
        model = md.estimator("RandomForest", "binary_classification", context).fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest-jobs")) <= 20
    assert len(model.trees) == 100 and max(len(t.left) for t in model.trees) > 100


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_levels_of_large_nodes_give_the_forest_grown_in_place(spark, monkeypatch, task):
    df, x, _ = _rows(spark, task)
    est = rf.HistogramForest(rf.ForestSettings(task, trees=4, depth=30), md.Y, md.W)
    whole = est.fit(df)
    monkeypatch.setattr(rf, "LOCAL_CELLS", 60)
    passes = est.fit(df.repartition(5))
    for a, b in zip(whole.trees, passes.trees, strict=True):
        assert (a.left == b.left).all() and (a.feature == b.feature).all() and (a.bin == b.bin).all()
    assert np.allclose(whole.raw(x), passes.raw(x), atol=1e-9)


def test_forest_fits_its_rows_and_splits_on_rare_values(spark):
    df, x, y = _rows(spark, "regression")
    one = rf.HistogramForest(rf.ForestSettings("regression", trees=40), md.Y, None).fit(df)
    assert np.corrcoef(one.raw(x), y)[0, 1] > 0.85
    rare = df.select("features", F.when(F.element_at(md.vector_to_array("features"), 3) > 0, 50.0).otherwise(0.0).alias(md.Y))
    model = rf.HistogramForest(rf.ForestSettings("regression", trees=60), md.Y).fit(rare)
    hit = x[:, 2] > 0
    assert hit.any() and model.raw(x[hit]).min() > model.raw(x[~hit]).max()
    shallow = rf.HistogramForest(rf.ForestSettings("classification", trees=3, depth=2), md.Y).fit(
        df.select("features", (F.col(md.Y) > 0).cast("double").alias(md.Y)))
    assert max(len(t.left) for t in shallow.trees) <= 7


def test_draws_of_merged_rows_are_poisson():
    n = np.repeat([1, 3, 40, 5000], 20_000)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, len(n)).astype(np.uint64)
    k = rf.drawn(rf.draw_tables(n), hashes, 42, 7)
    for m in (1, 3, 40, 5000):
        mine = k[n == m]
        assert abs(mine.mean() - m) < 5 * (m / 20_000) ** 0.5 and abs(mine.var() / m - 1) < 0.06
    assert abs((k[n == 1] == 0).mean() - np.exp(-1)) < 0.02
