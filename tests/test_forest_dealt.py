import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from insightframe import session
from insightframe.operators import forest


def test_rows_of_one_part_are_packed_on_all_cores(spark, monkeypatch):
    """Training rows come back from disk as one part; their cells are counted by all cores, and the trees are the same."""
    rows = spark.range(0, 20_000, 1, 1).select(
        array_to_vector(F.array(*[(F.col("id") * k % 17).cast("double") for k in (3, 5, 7)])).alias("features"),
        ((F.col("id") * 11 % 29) % 2).cast("double").alias("y"))
    plans, written = [], session.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(session, "written", seen)
    estimator = forest.HistogramForest(forest.ForestSettings(trees=3), "y")
    dealt = estimator.fit(rows)
    monkeypatch.setattr(forest, "SPREAD_ROWS", 1 << 20)
    whole = estimator.fit(rows)
    assert ["RoundRobinPartitioning" in p for p in plans] == [True, False]
    for a, b in zip(dealt.trees, whole.trees, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(vars(a).values(), vars(b).values(), strict=True))
