"""Depth-wise boosting on merged rows (ML5) against MLlib's on all rows."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from insightframe.operators import depthwise as dw
from insightframe.operators import models as md


def _rows(spark, task, n=900):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 20, n), r.integers(0, 4, n), r.integers(0, 9, n), r.random(n) < 0.2]).astype(float)
    raw = 1.5 * (x[:, 0] > 9) * (x[:, 1] > 1) - 2.0 * (x[:, 2] > 3) + x[:, 3] + r.normal(size=n)
    y = raw + 100 if task == "regression" else (raw > 0).astype(float)
    w = np.where(raw > 0, 1.3, 0.8)
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y double, w double")
    return df.select(array_to_vector("x").alias("features"), F.col("y").alias(md.Y), F.col("w").alias(md.W)).repartition(3), x


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_cells_give_the_trees_of_all_rows_in_one_task_or_in_passes(spark, monkeypatch, task):
    df, x = _rows(spark, task)
    same = dict(maxIter=8, maxDepth=4, stepSize=0.1, seed=42, featuresCol="features", labelCol=md.Y)
    if task == "regression":
        plain = GBTRegressor(**same).fit(df).transform(df).withColumn("p", F.col("prediction"))
        est = dw.DepthwiseBoosting(dw.DepthwiseSettings(task, 8, 4), md.Y)
    else:
        plain = GBTClassifier(weightCol=md.W, **same).fit(df).transform(df).withColumn("p", vector_to_array("probability")[1])
        est = dw.DepthwiseBoosting(dw.DepthwiseSettings(task, 8, 4), md.Y, md.W)
    here = est.fit(df)
    gap = here.score(plain.select("features", "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-9
    monkeypatch.setattr(dw, "LOCAL_CELLS", 10)
    monkeypatch.setattr(dw, "BLOCK_CELLS", 200)
    monkeypatch.setattr(dw, "CHECKPOINT_EVERY", 3)
    passes = est.fit(df)
    assert len(passes.trees) == len(here.trees) == 8 and np.allclose(here.raw(x), passes.raw(x), atol=1e-9)


@pytest.mark.parametrize("task", ["binary_classification", "regression"])
def test_boosting_of_the_panel_takes_few_jobs(spark, task):
    df, _ = _rows(spark, md._kind(task), 300)
    context = md.FitContext(md.ModelConfig(), 300.0, 1.0, 4)
    spark.sparkContext.setJobGroup("boost-jobs", "")
    try:
        model = md.estimator("GradientBoosting", task, context).fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost-jobs")) <= 40
    assert len(model.trees) == 100


def test_constant_features_and_labels_of_no_two_classes(spark):
    df, _ = _rows(spark, "classification", 60)
    flat = df.withColumn("features", array_to_vector(F.array(F.lit(1.0))))
    model = dw.DepthwiseBoosting(dw.DepthwiseSettings(iterations=3), md.Y).fit(flat)
    share = df.agg(F.avg(md.Y)).first()[0]
    assert abs(model.raw(np.ones((1, 1)))[0] - (2 * share - 1)) < 0.5 and len(model.trees[0].left) == 1
    with pytest.raises(ValueError):
        dw.DepthwiseBoosting(dw.DepthwiseSettings(iterations=3), md.Y).fit(df.withColumn(md.Y, F.lit(2.0)))
