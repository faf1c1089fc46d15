"""The perceptron's search is MLlib's, and all folds are searched in the same passes (ML14)."""
import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from insightframe.operators import models as md
from insightframe.operators import network as nt


def _rows(spark, n, parts, seed=0):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(100 * seed + k)), F.lit(1009)) / 1009.0
    return spark.range(0, n, 1, parts).select(
        array_to_vector(F.array(u(1) * 4 - 2, u(2) * 4 - 2, (F.col("id") % 2).cast("double"))).alias("features"),
        ((u(1) * 4 - 2) * (u(2) * 4 - 2) + u(3) > 0.5).cast("double").alias("y")).cache()


def _mllib(rows, s):
    return MultilayerPerceptronClassifier(layers=s.layers, maxIter=s.iterations, tol=s.tolerance, seed=s.seed, featuresCol="features",
                                          labelCol="y").fit(rows)


@pytest.mark.parametrize("n,parts,iterations,tolerance", [(700, 3, 12, 1e-6), (2500, 1, 12, 1e-6), (700, 3, 400, 1e-2)])
def test_every_iteration_is_mllibs(spark, monkeypatch, n, parts, iterations, tolerance):
    monkeypatch.setattr(nt, "FEW_ROWS", 0)
    rows = _rows(spark, n, parts)  # parts that end inside a stack
    s = nt.NetworkSettings([3, 7, 2], iterations, 5, tolerance)
    want = _mllib(rows, s)
    (w, losses), = nt.searched([nt.SigmoidNetwork(s, "y").begin(rows)])
    history = list(want.summary().objectiveHistory)
    assert len(losses) == len(history) and (tolerance < 1e-2 or len(losses) < 100)
    np.testing.assert_allclose(losses, history, rtol=1e-8)
    np.testing.assert_allclose(w, want.weights.toArray(), rtol=1e-5, atol=1e-6)
    got = nt.SigmoidNetwork(s, "y").fit(rows)
    assert np.array_equal(got.weights.toArray(), w) and got.transform(rows).select("probability").count() == n


def test_fits_side_by_side_are_those_alone(spark, monkeypatch):
    monkeypatch.setattr(nt, "FEW_ROWS", 0)
    fits = []
    for seed, n, layers in ((1, 900, [3, 5, 2]), (2, 1500, [3, 8, 2])):
        fits.append(nt.SigmoidNetwork(nt.NetworkSettings(layers, 6 * seed, 3), "y").begin(_rows(spark, n, 2, seed)))
    both = nt.searched(fits)
    for fit, (w, losses) in zip(fits, both, strict=True):
        (alone, history), = nt.searched([fit])
        assert len(losses) == fit.network.settings.iterations + 1
        np.testing.assert_allclose(losses, history, rtol=1e-9)
        np.testing.assert_allclose(w, alone, rtol=1e-6, atol=1e-8)


def test_few_rows_are_mllibs_own_fit_and_labels_are_checked(spark, monkeypatch):
    rows = _rows(spark, 300, 2)
    s = nt.NetworkSettings([3, 4, 2], 5)
    assert np.array_equal(nt.SigmoidNetwork(s, "y").fit(rows).weights.toArray(), _mllib(rows, s).weights.toArray())
    monkeypatch.setattr(nt, "FEW_ROWS", 0)
    with pytest.raises(Exception, match="labels must be 0 to 1"):
        nt.SigmoidNetwork(s, "y").fit(rows.withColumn("y", F.col("y") * 2))


def test_panel_searches_all_folds_in_the_same_passes(spark, monkeypatch):
    monkeypatch.setattr(nt, "FEW_ROWS", 0)
    asked, searched = [], nt.searched

    def watched(begun):
        asked.append([b.n for b in begun])
        return searched(begun)

    monkeypatch.setattr(nt, "searched", watched)
    df = spark.range(600).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"),
                                 F.element_at(F.array(*map(F.lit, "ab")), (F.col("id") % 2 + 1).cast("int")).alias("c")) \
        .withColumn("target", (F.col("x") + 20 * (F.col("c") == "a").cast("int") > 60).cast("int"))
    lb = md.train_panel(df, "target", ["id"], ["x"], ["c"], "binary_classification", md.ModelConfig(mlp_iter=30),
                        user_technique="mlp", folds=3, only_user_technique=True)
    (sizes,) = asked
    assert len(sizes) == 4 and sizes[-1] == 480 and sum(sizes[:3]) == 960
    row = lb.table.first()
    assert row.cv_score > 0.95 and row.test_score > 0.95


def test_panel_fails_with_its_network(spark, monkeypatch):
    def lost(begun):
        raise ValueError("lost")

    monkeypatch.setattr(nt, "FEW_ROWS", 0)
    monkeypatch.setattr(nt, "searched", lost)
    df = spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x")).withColumn("t", (F.col("x") > 60).cast("int"))
    with pytest.raises(ValueError, match="lost"):
        md.train_panel(df, "t", ["id"], ["x"], [], "binary_classification", user_technique="mlp", folds=2, only_user_technique=True)
