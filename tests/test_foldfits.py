"""Fold fits from sums of products against row-wise least squares and MLlib."""
import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from insightframe.operators import foldfits as ff
from insightframe.operators.models import prepare, featurize


def rows(spark, n=600):
    r = np.random.default_rng(7)
    out = []
    for i in range(n):
        a, b, c = float(r.normal(5, 2)), float(r.normal()), "xyz"[r.integers(0, 3)]
        y = 3 * a - 2 * b + {"x": 0, "y": 4, "z": -1}[c] + float(r.normal(0, 0.5))
        out.append((None if r.random() < 0.1 else a, b, None if r.random() < 0.05 else c, None if i == 3 else y, i % 5, 1.0))
    out.append((1.0, 2.0, "only in fold 4", 1.5, 4, 1.0))
    return spark.createDataFrame(out, "a double, b double, c string, y double, fold int, same double")


def test_folds_equal_fits_on_rows(spark):
    df = rows(spark).cache()
    fits = ff.fold_fits(df, "y", ["a", "b", "same"], ["c"], "fold")
    assert len(fits) == 3 * 6
    for f in [0, 4, None]:
        train = df.where(F.col("y").isNotNull() & (F.lit(True) if f is None else F.col("fold") != f))
        prep = prepare(train, ["a", "b", "same"], ["c"])
        feat = featurize(prep, train, ["y"])
        mine = {x.kind: x for x in fits if x.fold == f}
        assert mine["linear"].names == prep.pre.feature_names()
        n = feat.count()
        sd = feat.agg(F.stddev_pop("y")).first()[0]
        models = {"linear": LinearRegression(solver="normal", featuresCol="features", labelCol="y"),
                  "ridge": LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=sd / n, featuresCol="features", labelCol="y"),
                  "lasso": LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False, maxIter=1000, tol=1e-12, featuresCol="features", labelCol="y")}
        # a category that training has not seen has no unique fit
        held = featurize(prep, df.where("y is not null and (c is null or c != 'only in fold 4')").where(F.col("fold") == (f or 0)), ["y"])
        for kind, est in models.items():
            model = est.fit(feat)
            x = np.array([np.array(r.features.toArray()) for r in held.collect()])
            ours = x @ mine[kind].coefficients + mine[kind].intercept
            theirs = x @ model.coefficients.toArray() + model.intercept
            assert np.abs(ours - theirs).max() < 1e-5, (f, kind)
            if f is not None:
                y = np.array([r.y for r in held.collect()])
                assert f == 4 or abs(mine[kind].rmse - np.sqrt(((ours - y) ** 2).mean())) < 1e-6
    df.unpersist()


def test_sums_take_one_scan_and_nothing_leaks(spark):
    df = rows(spark)
    sums = ff.fold_products(df.where("y is not null"), [F.lit(1.0), F.col("b"), F.col("y")], "fold")
    assert sorted(sums) == [0, 1, 2, 3, 4]
    assert sum(s[0, 0] for s in sums.values()) == 600
    table = ff.cv_table(spark, ff.fold_fits(df, "y", ["a"], [], "fold", {"path": ("ridge", 10.0)}))
    assert [r.kind for r in table.collect()] == ["path"]
    va = VectorAssembler(inputCols=["b"], outputCol="features")
    one = LinearRegression(labelCol="y", solver="normal").fit(va.transform(df.where("y is not null and fold != 2")))
    mine = next(x for x in ff.fold_fits(df, "y", ["b"], [], "fold", standardise=False) if x.fold == 2 and x.kind == "linear")
    assert abs(mine.coefficients[0] - one.coefficients[0]) < 1e-8 and abs(mine.intercept - one.intercept) < 1e-8
