"""Local attributions: how much each feature moved one row's prediction (spec extra).

Linear models: coefficient times the distance from the feature's mean, as Column expressions.
Boosted trees: Shapley values of the game in which an unknown feature sends a row down both
branches in proportion to the rows seen there (path-dependent). A leaf's part in the game is a
product over the features on its path, so its Shapley values are closed sums over the
coefficients of a product of linear terms; leaves add up. Values of a row add up to its raw
score less ``base_value``, the raw score's mean over the rows that built each tree.
"""
from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import HistogramBoostingModel, Tree


def linear_attributions(coefficients: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Feature -> attribution; they add up to the linear score less the score at the means."""
    return {f: F.lit(c) * (F.col(f).cast("double") - F.lit(means[f])) for f, c in coefficients.items()}


def _paths(t: Tree):
    """(value, {feature: (low, high, share)}) of every leaf: a row agrees with the path on a feature
    where low < x <= high, and without the feature it follows with chance ``share``."""
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        if t.left[node] < 0:
            yield t.value[node], path
            continue
        f, cut = int(t.feature[node]), float(t.threshold[node])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for kid, lo, hi in ((t.left[node], low, min(high, cut)), (t.right[node], max(low, cut), high)):
            stack.append((int(kid), path | {f: (lo, hi, share * t.cover[kid] / t.cover[node])}))


def tree_attributions(model: HistogramBoostingModel, x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values of the raw score of rows of plain features."""
    out = np.zeros(x.shape)
    for t in model.trees:
        for value, path in _paths(t):
            if value == 0 or not path:
                continue
            m = len(path)
            inside = {f: ((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, (lo, hi, _) in path.items()}
            weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
            for f, (_, _, share) in path.items():
                # coefficients of the product over the other features of (share + inside * z)
                poly = np.zeros((m, len(x)))
                poly[0] = 1.0
                for k, (g, (_, _, other)) in enumerate((g, p) for g, p in path.items() if g != f):
                    for d in range(k + 1, -1, -1):
                        poly[d] = poly[d] * other + (poly[d - 1] * inside[g] if d else 0.0)
                out[:, f] += value * (inside[f] - share) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out


def base_value(model: HistogramBoostingModel) -> float:
    """The raw score where no feature is known."""
    return model.base + sum(v * np.prod([share for _, _, share in path.values()]) for t in model.trees for v, path in _paths(t))


def attributions(model: HistogramBoostingModel, feat: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """(keep.., feature, attribution) of every row of ``feat`` (features vector) and feature; parts
    of one original column (one-hot categories) share a name in ``names`` and are added up."""
    shown = list(dict.fromkeys(names))
    part = np.array([shown.index(n) for n in names])

    @F.pandas_udf("array<double>")
    def explain(x):
        import pandas as pd
        if not len(x):
            return pd.Series([], dtype=object)
        each = tree_attributions(model, np.stack(x.to_numpy()))
        total = np.stack([each[:, part == i].sum(axis=1) for i in range(len(shown))], axis=1)
        return pd.Series(list(total))

    told = feat.select(*keep, explain(vector_to_array("features")).alias("_a"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in shown]).alias("feature"), F.col("_a").alias("attribution"))
    return told.select(*keep, F.explode(pairs).alias("_p")).select(*keep, F.col("_p.feature"), F.col("_p.attribution"))
