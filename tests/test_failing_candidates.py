"""A candidate that cannot be fitted does not leave a smaller panel behind (ML7, ML20, ML23)."""
import pytest
from pyspark.sql import functions as F

from insightframe.operators import forest
from insightframe.operators import models as md
from insightframe.plans import queries_models as qm

CFG = md.ModelConfig(num_trees=3, max_depth=3, gbt_iter=3, gbt_depth=2, logistic_iter=5)


class Lost(Exception):
    pass


@pytest.fixture
def broken_forest(monkeypatch):
    fit = forest.HistogramForest.fit
    begun = []

    def lost(self, train):
        begun.append(0)
        if len(begun) == 2:  # one fold of several
            raise Lost("executor lost")
        return fit(self, train)

    monkeypatch.setattr(forest.HistogramForest, "fit", lost)
    monkeypatch.setattr(qm, "PANEL_CFG", CFG)
    return begun


def _documents(spark, n=300):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("n_chars"),
                                 (F.col("id") % 2).cast("int").alias("quality"), F.lit("en").alias("lang"), F.lit("web").alias("source")) \
        .withColumn("toxic", (F.col("n_chars") > 60).cast("int"))


def test_ensemble_is_not_scored_without_a_failed_member(spark, monkeypatch, broken_forest):
    monkeypatch.setattr(qm, "_doc_base", lambda s, d: _documents(s))
    with pytest.raises(Lost, match="executor lost"):
        qm.q_ensemble_scores(spark, "").collect()


def test_a_skipped_candidate_is_named(spark, broken_forest):
    lb = md.train_panel(_documents(spark), "toxic", ["doc_id"], ["n_chars"], ["lang"], "binary_classification", CFG,
                        folds=2, skip_failing=True)
    assert lb.failed == {"RandomForest": "Lost: executor lost"}
    rows = {r.name: r for r in lb.table.collect()}
    assert set(rows) == {"LogisticRegression", "GradientBoosting", "Ensemble"}
    assert rows["Ensemble"].notes == "soft-vote of the panel without RandomForest (failed)"


def test_regression_leaderboard_is_not_shown_without_a_failed_candidate(spark, monkeypatch):
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int").alias("p_size"),
                                    F.lit("b").alias("p_brand"), (F.col("id") % 13 + 900).cast("double").alias("p_retailprice"))
    monkeypatch.setattr(qm.bt, "read_table", lambda s, d, name: parts)
    monkeypatch.setattr(qm, "PANEL_CFG", CFG)
    fit = md.LinearRegression.fit
    begun = []

    def lost(self, train):
        begun.append(0)
        if len(begun) == 6:  # the last fit, on all training rows
            raise Lost("out of memory")
        return fit(self, train)

    monkeypatch.setattr(md.LinearRegression, "fit", lost)
    with pytest.raises(Lost, match="out of memory"):
        qm.q_leaderboard_regression(spark, "").collect()
