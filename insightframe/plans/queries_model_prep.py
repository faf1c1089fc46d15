"""Registered queries: metrics (ML1, ML15-18, X3, X4) and preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, stable_bucket_sql
from ..operators import metrics as mt
from ..operators import prep as pp
from . import basetables as bt
from .registry import register

# Deterministic score columns computed from the table itself: one with heavy ties
# (11 distinct values) and one nearly unique, so both the tie rule and the bucketed
# cumulative path are exercised.
SCORE_SQL = """SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS score_tied,
  l_extendedprice / 100000 AS score_fine, l_quantity * 1500 AS pred_price, l_extendedprice FROM lineitem"""


def score_base(spark, sf_dir):
    li = bt.lineitem_events(spark, sf_dir)
    return li.select("y", (F.col("l_discount") * 10).alias("score_tied"),
                     (F.col("l_extendedprice") / 100000).alias("score_fine"),
                     (F.col("l_quantity") * 1500).alias("pred_price"), "l_extendedprice")


def _cum_sql(score: str) -> str:
    return f"""st_{score} AS (SELECT {score} AS score, SUM(y) AS pos, SUM(1 - y) AS neg FROM b GROUP BY 1),
c_{score} AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                  SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM st_{score})"""


@register("metric_roc_auc", oracle=f"""
WITH b AS ({SCORE_SQL}), {_cum_sql('score_tied')}, {_cum_sql('score_fine')}
SELECT (SELECT ROUND(SUM(neg * (tp - pos + pos / 2.0)) / (SUM(pos)::DOUBLE * SUM(neg)), 6) FROM c_score_tied) AS roc_auc_tied,
       (SELECT ROUND(SUM(neg * (tp - pos + pos / 2.0)) / (SUM(pos)::DOUBLE * SUM(neg)), 6) FROM c_score_fine) AS roc_auc_fine""")
def q_metric_roc_auc(spark, sf_dir):
    """ML15 on a tied score and on a near-unique score (bucketed cumulative path)."""
    b = score_base(spark, sf_dir)
    t = mt.roc_auc(b, "score_tied", "y").select(rnd(F.col("roc_auc")).alias("roc_auc_tied"))
    f = mt.roc_auc(b, "score_fine", "y").select(rnd(F.col("roc_auc")).alias("roc_auc_fine"))
    return t.select("roc_auc_tied", f.select(F.struct("roc_auc_fine")).scalar()["roc_auc_fine"].alias("roc_auc_fine"))


@register("metric_average_precision", oracle=f"""
WITH b AS ({SCORE_SQL}), {_cum_sql('score_tied')}, {_cum_sql('score_fine')}
SELECT (SELECT ROUND(SUM(pos * tp / (tp + fp)) / SUM(pos)::DOUBLE, 6) FROM c_score_tied) AS ap_tied,
       (SELECT ROUND(SUM(pos * tp / (tp + fp)) / SUM(pos)::DOUBLE, 6) FROM c_score_fine) AS ap_fine""")
def q_metric_average_precision(spark, sf_dir):
    """ML16: average precision (step sum, not the interpolated PR area)."""
    b = score_base(spark, sf_dir)
    t = mt.average_precision(b, "score_tied", "y")
    f = mt.average_precision(b, "score_fine", "y").select(F.struct("average_precision")).scalar()
    return t.select(rnd(F.col("average_precision")).alias("ap_tied"),
                    rnd(f["average_precision"]).alias("ap_fine"))


@register("metric_f1_acc_brier", oracle=f"""
WITH b AS ({SCORE_SQL}), p AS (SELECT y::DOUBLE AS y, score_tied AS s, CASE WHEN score_tied > 0.5 THEN 1.0 ELSE 0.0 END AS pred FROM b)
SELECT COUNT(*) AS n,
  ROUND(COALESCE(2 * SUM(pred * y) / NULLIF(2 * SUM(pred * y) + SUM(pred * (1 - y)) + SUM((1 - pred) * y), 0), 0), 6) AS f1,
  ROUND(AVG(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, ROUND(AVG(power(s - y, 2)), 6) AS brier FROM p""")
def q_metric_f1_acc_brier(spark, sf_dir):
    m = mt.classification_metrics(score_base(spark, sf_dir), "score_tied", "y")
    return m.select("n", rnd(F.col("f1")).alias("f1"), rnd(F.col("accuracy")).alias("accuracy"),
                    rnd(F.col("brier")).alias("brier"))


@register("metric_regression", oracle=f"""
WITH b AS ({SCORE_SQL})
SELECT COUNT(*) AS n, ROUND(sqrt(AVG(power(pred_price - l_extendedprice, 2))), 4) AS rmse,
  ROUND(AVG(abs(pred_price - l_extendedprice)), 4) AS mae,
  ROUND(1 - SUM(power(pred_price - l_extendedprice, 2)) / (var_pop(l_extendedprice) * COUNT(*)), 6) AS r2 FROM b""")
def q_metric_regression(spark, sf_dir):
    """ML18: price predicted as quantity x 1500 against the actual extended price."""
    m = mt.regression_metrics(score_base(spark, sf_dir), "pred_price", "l_extendedprice")
    return m.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), rnd(F.col("r2")).alias("r2"))


@register("cost_threshold", oracle=f"""
WITH b AS ({SCORE_SQL}), {_cum_sql('score_tied')},
tot AS (SELECT SUM(pos) AS P FROM st_score_tied),
cand AS (SELECT score AS threshold, fp, (SELECT P FROM tot) - tp AS fn FROM c_score_tied
         UNION ALL SELECT 'inf'::DOUBLE, 0, (SELECT P FROM tot)),
cc AS (SELECT *, 1.0 * fp + 5.0 * fn AS cost FROM cand)
SELECT ROUND(threshold, 6) AS threshold, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, ROUND(cost, 6) AS cost
FROM cc ORDER BY cost, threshold DESC LIMIT 1""")
def q_cost_threshold(spark, sf_dir):
    """Threshold minimising 1 x FP + 5 x FN (a missed return costs five false alarms)."""
    c = mt.cost_threshold(score_base(spark, sf_dir), "score_tied", "y", 1.0, 5.0)
    return c.select(rnd(F.col("threshold")).alias("threshold"), F.col("fp").cast("bigint").alias("fp"),
                    F.col("fn").cast("bigint").alias("fn"), rnd(F.col("cost")).alias("cost"))


@register("calibration_bins", oracle=f"""
WITH b AS ({SCORE_SQL})
SELECT CAST(least(floor(score_fine * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, ROUND(AVG(score_fine), 6) AS mean_pred,
       ROUND(AVG(y::DOUBLE), 6) AS observed_rate FROM b GROUP BY 1""")
def q_calibration_bins(spark, sf_dir):
    c = mt.calibration_bins(score_base(spark, sf_dir), "score_fine", "y")
    return c.select("bin", "n", rnd(F.col("mean_pred")).alias("mean_pred"),
                    rnd(F.col("observed_rate")).alias("observed_rate"))


@register("metric_policy", oracle="""
WITH t2 AS (SELECT 'event_type=' || event_type AS target, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM events) AS pos_rate
            FROM events GROUP BY event_type
            UNION ALL SELECT 'toxic', AVG(toxic::DOUBLE) FROM labels
            UNION ALL SELECT 'quality', AVG(quality::DOUBLE) FROM labels)
SELECT target, ROUND(pos_rate, 6) AS pos_rate,
  CASE WHEN pos_rate < 0.05 OR pos_rate > 0.95 THEN 'PR-AUC' ELSE 'ROC-AUC' END AS metric FROM t2""")
def q_metric_policy(spark, sf_dir):
    """ML1: metric chosen for each candidate event target (one-vs-rest event types, label flags)."""
    ev = bt.read_table(spark, sf_dir, "events")
    # every event type as a one-vs-rest target: share of rows with that type
    per_type = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_t"))
    total = ev.agg(F.count(F.lit(1))).scalar()
    types = per_type.select(F.concat(F.lit("event_type="), F.col("event_type")).alias("target"),
                            (F.col("n_t") / total).alias("pos_rate"))
    lab = bt.read_table(spark, sf_dir, "labels")
    flags = lab.agg(F.avg(F.col("toxic").cast("double")).alias("toxic"),
                    F.avg(F.col("quality").cast("double")).alias("quality")) \
        .unpivot([], ["toxic", "quality"], "target", "pos_rate")
    allt = types.unionByName(flags)
    return allt.select("target", rnd(F.col("pos_rate")).alias("pos_rate"),
                       mt.metric_policy_expr(F.lit("binary_classification"), F.col("pos_rate")).alias("metric"))


# ---- preparation ------------------------------------------------------------------------
KEY = ["l_orderkey", "l_linenumber"]
SPLIT_SQL = f"CASE WHEN {stable_bucket_sql(KEY, 100, 42)} < 20 THEN 'test' ELSE 'train' END"
_Y = "CAST(l_returnflag = 'R' AS INTEGER)"


def _unit_sql(seed: int) -> str:
    return f"({stable_bucket_sql(KEY, 1000000007, seed)})::DOUBLE / 1000000007.0"


def _ranked_sql(source: str, seed: int) -> str:
    """Rank inside the class by the key's hash, and the size of the class."""
    return (f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_unit_sql(seed)}, l_orderkey, l_linenumber) - 1 AS r, "
            f"COUNT(*) OVER (PARTITION BY y) AS n_y FROM {source}")


_SPLIT_CTE = (f"b AS (SELECT l_orderkey, l_linenumber, {_Y} AS y FROM lineitem), "
              f"s AS (SELECT l_orderkey, l_linenumber, y, CASE WHEN r < round(n_y * 0.2) THEN 'test' ELSE 'train' END AS split "
              f"FROM ({_ranked_sql('b', 42)}))")


@register("train_test_split", oracle=f"""
WITH {_SPLIT_CTE} SELECT split, y, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM s GROUP BY 1, 2""")
def q_train_test_split(spark, sf_dir):
    """M4: 80/20 split inside each class by the line key's hash; counts and key sums."""
    li = pp.stratified_split(bt.lineitem_events(spark, sf_dir), "y", KEY)
    return li.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@register("cv_folds", oracle=f"""
WITH {_SPLIT_CTE}, t AS (SELECT l_orderkey, l_linenumber, y FROM s WHERE split = 'train')
SELECT CAST(r % 5 AS INTEGER) AS fold, y, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM ({_ranked_sql('t', 43)}) GROUP BY 1, 2""")
def q_cv_folds(spark, sf_dir):
    """M5: 5 folds over the training rows, each class dealt in turn; counts and key sums."""
    train = pp.stratified_split(bt.lineitem_events(spark, sf_dir), "y", KEY).where("split = 'train'")
    return pp.stratified_folds(train, "y", KEY).groupBy("fold", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@register("stratified_sample", oracle=f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_Y} AS y FROM lineitem), c AS (SELECT COUNT(*) AS n FROM b)
SELECT y, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM ({_ranked_sql('b', 42)}), c
WHERE r < round(n_y * least(1.0, 20000.0 / c.n)) GROUP BY 1""")
def q_stratified_sample(spark, sf_dir):
    """M3: prevalence-preserving sample of 20,000 rows (sampling is this operator's job)."""
    s = pp.stratified_sample(bt.lineitem_events(spark, sf_dir), "y", KEY, 20_000)
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@register("class_weights", oracle="""
WITH c AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, COUNT(*) AS n_c FROM lineitem GROUP BY 1)
SELECT y, n_c, ROUND((SELECT SUM(n_c) FROM c)::DOUBLE / ((SELECT COUNT(*) FROM c) * n_c), 6) AS weight FROM c""")
def q_class_weights(spark, sf_dir):
    w = pp.class_weights(bt.lineitem_events(spark, sf_dir))
    return w.select("y", "n_c", rnd(F.col("weight")).alias("weight"))


# Numeric columns with NULLs injected so the imputer has work to do.
IMPUTE_SQL = f"""SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  {SPLIT_SQL} AS split FROM lineitem"""


def impute_base(spark, sf_dir):
    li = bt.read_table(spark, sf_dir, "lineitem")

    def nul(c, m):
        return F.when(F.col("l_orderkey") % m == 0, F.lit(None)).otherwise(F.col(c)).alias(c)
    return li.select(nul("l_tax", 10), nul("l_quantity", 7), nul("l_linestatus", 9), nul("l_returnflag", 11),
                     pp.split_column(KEY).alias("split"))


@register("impute_median", oracle=f"""
WITH b AS ({IMPUTE_SQL}), t AS (SELECT * FROM b WHERE split = 'train')
SELECT 'l_tax' AS col_name, ROUND(quantile_cont(l_tax, 0.5), 6) AS median FROM t
UNION ALL SELECT 'l_quantity', ROUND(quantile_cont(l_quantity, 0.5), 6) FROM t""")
def q_impute_median(spark, sf_dir):
    """M6: medians fitted on training rows only."""
    t = impute_base(spark, sf_dir).where("split = 'train'")
    return pp.median_table(t, ["l_tax", "l_quantity"]).select("col_name", rnd(F.col("median")).alias("median"))


@register("impute_mode", oracle=f"""
WITH b AS ({IMPUTE_SQL}), t AS (SELECT * FROM b WHERE split = 'train'),
v AS (SELECT 'l_linestatus' AS col_name, l_linestatus AS value, COUNT(*) AS n FROM t WHERE l_linestatus IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'l_returnflag', l_returnflag, COUNT(*) FROM t WHERE l_returnflag IS NOT NULL GROUP BY 2)
SELECT col_name, arg_min(value, (-n, value)) AS mode, MAX(n) AS n FROM v GROUP BY col_name""")
def q_impute_mode(spark, sf_dir):
    """M7: most frequent training value per categorical column (ties -> smallest)."""
    t = impute_base(spark, sf_dir).where("split = 'train'")
    return pp.mode_table(t, ["l_linestatus", "l_returnflag"])


@register("standardize", oracle=f"""
WITH b AS ({IMPUTE_SQL}), t AS (SELECT * FROM b WHERE split = 'train'),
m AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM t),
s AS (SELECT AVG(COALESCE(l_quantity, m.med)) AS mu, stddev_pop(COALESCE(l_quantity, m.med)) AS sd FROM t, m)
SELECT ROUND(s.mu, 6) AS mean, ROUND(s.sd, 6) AS std,
  ROUND(AVG((COALESCE(b.l_quantity, m.med) - s.mu) / s.sd), 6) AS test_mean_z,
  COUNT(*) AS n_test FROM b, m, s WHERE b.split = 'test' GROUP BY s.mu, s.sd""")
def q_standardize(spark, sf_dir):
    """M6+M8: impute with the training median, scale by training mean / population std, apply
    to the held-out rows."""
    b = impute_base(spark, sf_dir)
    p = pp.fit_preprocessor(b.where("split = 'train'"), ["l_quantity"], [])
    z = p.transform(b.where("split = 'test'"), [])
    return z.agg(F.round(F.lit(p.means["l_quantity"]), 6).alias("mean"),
                 F.round(F.lit(p.stds["l_quantity"]), 6).alias("std"),
                 rnd(F.avg("num__l_quantity")).alias("test_mean_z"), F.count(F.lit(1)).alias("n_test"))


@register("one_hot", oracle=f"""
WITH b AS ({IMPUTE_SQL}), t AS (SELECT * FROM b WHERE split = 'train'),
mode AS (SELECT arg_min(l_returnflag, (-n, l_returnflag)) AS m FROM (SELECT l_returnflag, COUNT(*) AS n FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1)),
cats AS (SELECT DISTINCT l_returnflag AS cat FROM t WHERE l_returnflag IS NOT NULL)
SELECT 'cat__l_returnflag=' || cat AS feature, CAST(SUM(CASE WHEN COALESCE(b.l_returnflag, mode.m) = cat THEN 1 ELSE 0 END) AS DOUBLE) AS ones
FROM b, cats, mode WHERE b.split = 'test' GROUP BY cat""")
def q_one_hot(spark, sf_dir):
    """M7+M9: one-hot columns learnt on training rows (mode-imputed), counted on test rows."""
    b = impute_base(spark, sf_dir)
    p = pp.fit_preprocessor(b.where("split = 'train'"), [], ["l_returnflag"])
    z = p.transform(b.where("split = 'test'"), [])
    feats = [c for c in z.columns]
    return z.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in feats]) \
        .unpivot([], feats, "feature", "ones")
