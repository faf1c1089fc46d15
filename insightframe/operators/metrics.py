"""Model metrics as aggregates (ML1, ML15-ML18, X3, X4).

Ranking metrics (ROC-AUC, average precision, cost-optimal threshold) need, for every distinct
score s, the positives and negatives with score >= s. A global window over all scores would
run in one task. Instead:

1. collapse to distinct scores (ties merge in a partial aggregate);
2. assign each distinct score to one of at most ``n_buckets`` contiguous score ranges using
   cut points from ``approx_percentile`` over the distinct scores (the cut list is bounded by
   ``n_buckets``, so collecting it is safe);
3. total each bucket (<= n_buckets rows), prefix-sum those totals (tiny window) and broadcast
   them (size bounded by n_buckets);
4. finish the cumulative sums inside each bucket: ``PARTITION BY bucket``, so the work is
   spread over buckets that each hold ~1/n_buckets of the distinct scores.

The result is exact; only the partitioning is approximate-quantile driven.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import IMBALANCE_HIGH, IMBALANCE_LOW

DEFAULT_BUCKETS = 256


def score_table(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """(group.., score, pos, neg) per distinct score; rows with a NULL score or label are ignored."""
    group = group or []
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*group, F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.col(label).cast("bigint")).alias("pos"),
                 F.sum((1 - F.col(label)).cast("bigint")).alias("neg")))


def _raw(df: DataFrame, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score"))


def _splits(st: DataFrame, n_buckets: int) -> list[float]:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = st.agg(F.percentile_approx("score", probs, 10000).alias("c")).first()["c"] or []
    inner = sorted(set(float(c) for c in cuts)) or [0.0]
    return [float("-inf")] + inner + [float("inf")]


def cumulative_from_top(st: DataFrame, n_buckets: int = DEFAULT_BUCKETS,
                        group: list[str] | None = None, cut_source: DataFrame | None = None) -> DataFrame:
    """Adds tp/fp = positives/negatives with score >= this score (descending cumulative),
    per group. Cut points are sketched from ``cut_source`` (raw scores: one map-side pass, no
    shuffle) when given, else from the distinct-score table."""
    group = group or []
    b = Bucketizer(splits=_splits(cut_source if cut_source is not None else st, n_buckets),
                   inputCol="score", outputCol="bucket", handleInvalid="keep").transform(st)
    totals = b.groupBy(*group, "bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    above = Window.partitionBy(*group).orderBy(F.desc("bucket")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "bucket", F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("bneg").over(above), F.lit(0)).alias("neg_before"))
    inner = Window.partitionBy(*group, "bucket").orderBy(F.desc("score")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offsets has (groups x buckets) rows: bounded by n_buckets per group
    return (b.join(F.broadcast(offsets), [*group, "bucket"])
            .withColumn("tp", F.col("pos_before") + F.sum("pos").over(inner))
            .withColumn("fp", F.col("neg_before") + F.sum("neg").over(inner))
            .drop("pos_before", "neg_before"))


def roc_auc(df: DataFrame, score: str, label: str, n_buckets: int = DEFAULT_BUCKETS,
            group: list[str] | None = None) -> DataFrame:
    """ML15: tie-aware ROC-AUC = sum_s neg_s * (pos above s + pos_s / 2) / (P * N)."""
    group = group or []
    c = cumulative_from_top(score_table(df, score, label, group), n_buckets, group, _raw(df, score))
    return c.groupBy(*group).agg(F.try_divide(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)),
        F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str,
                      n_buckets: int = DEFAULT_BUCKETS, group: list[str] | None = None) -> DataFrame:
    """ML16: average precision as a step sum: sum_s (pos_s / P) * tp_s / (tp_s + fp_s)."""
    group = group or []
    c = cumulative_from_top(score_table(df, score, label, group), n_buckets, group, _raw(df, score))
    return c.groupBy(*group).agg(F.try_divide(
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
        F.sum("pos").cast("double")).alias("average_precision"))


def ranking_metrics(df: DataFrame, score: str, label: str, n_buckets: int = DEFAULT_BUCKETS,
                    group: list[str] | None = None) -> DataFrame:
    """ROC-AUC and average precision from ONE cumulative pass (same formulas as above)."""
    group = group or []
    c = cumulative_from_top(score_table(df, score, label, group), n_buckets, group, _raw(df, score))
    return c.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.sum("pos").cast("double")).alias("average_precision"))


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                           group: list[str] | None = None) -> DataFrame:
    """ML17: F1 of the positive class (0 when undefined), accuracy, Brier; predicted class is
    ``score > threshold``. One aggregate, optionally per group (e.g. per fold)."""
    group = group or []
    y = F.col(label).cast("double")
    pred = (F.col(score) > threshold).cast("double")
    m = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group).agg(
        F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"),
        F.sum((1 - pred) * y).alias("fn"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(pred == y, 1.0).otherwise(0.0)).alias("correct"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return m.select(*group, "n", f1.alias("f1"), (F.col("correct") / F.col("n")).alias("accuracy"), "brier")


def regression_metrics(df: DataFrame, pred: str, label: str, group: list[str] | None = None) -> DataFrame:
    """ML18: RMSE, MAE and R^2 = 1 - SSE / SST (SST around the evaluated rows' mean)."""
    group = group or []
    e = F.col(pred) - F.col(label)
    m = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), F.var_pop(F.col(label)).alias("_vp"))
    r2 = 1 - F.try_divide(F.col("sse"), F.col("_vp") * F.col("n"))
    return m.select(*group, "n", "rmse", "mae", r2.alias("r2"))


def cost_threshold(df: DataFrame, score: str, label: str, cost_fp: float = 1.0,
                   cost_fn: float = 5.0, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Threshold (predict positive when score >= t) minimising cost_fp*FP + cost_fn*FN over
    every distinct score, plus "predict none". Ties go to the higher threshold."""
    c = cumulative_from_top(score_table(df, score, label), n_buckets, cut_source=_raw(df, score))
    tot = c.agg(F.struct(F.sum("pos").alias("P")).alias("s")).scalar()
    cand = c.select(F.col("score").alias("threshold"), F.col("fp"), (tot["P"] - F.col("tp")).alias("fn"))
    none = c.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fp"),
                                          tot["P"].alias("fn"))
    allc = cand.unionByName(none).withColumn(
        "cost", F.lit(cost_fp) * F.col("fp") + F.lit(cost_fn) * F.col("fn"))
    best = allc.agg(F.min_by(F.struct("threshold", "fp", "fn", "cost"),
                             F.struct(F.col("cost"), -F.col("threshold"))).alias("b"))
    return best.select("b.*")


def calibration_bins(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Deciles of the predicted probability with mean prediction vs observed rate."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"),
                                         F.avg(F.col(label).cast("double")).alias("observed_rate")))


# Fixed rationales by metric.
METRIC_RATIONALES = {
    "RMSE": "Regression task: selected by RMSE (lower is better); MAE and R2 also reported.",
    "PR-AUC": ("Imbalanced binary target ({:.2f}% positive): selected by PR-AUC "
               "(average precision), which focuses on the rare positive class. Raw accuracy "
               "and even ROC-AUC look deceptively high under this much imbalance."),
    "ROC-AUC": "Balanced binary target: selected by ROC-AUC; PR-AUC and F1 also reported.",
}


def metric_policy(task: str, pos_rate: float | None) -> tuple[str, str]:
    """ML1 for one target: (metric, rationale)."""
    skewed = pos_rate is not None and abs(pos_rate - 0.5) > 0.5 - IMBALANCE_LOW
    metric = {True: "RMSE"}.get(task == "regression", "PR-AUC" if skewed else "ROC-AUC")
    return metric, METRIC_RATIONALES[metric].format(100 * (pos_rate or 0))


def metric_policy_expr(task: F.Column, pos_rate: F.Column) -> F.Column:
    """ML1 as a Column (for tables of candidate targets)."""
    return (F.when(task == "regression", F.lit("RMSE"))
            .when((pos_rate < IMBALANCE_LOW) | (pos_rate > IMBALANCE_HIGH), F.lit("PR-AUC"))
            .otherwise(F.lit("ROC-AUC")))
