"""Registered queries: model panel, leaderboard, ensemble, importance, NB and k-NN."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.columns import rnd, stable_bucket_sql
from ..operators import attributions as at
from ..operators import boosting as bo
from ..operators import foldfits as ff
from ..operators import models as md
from ..operators import neighbors as nb
from ..operators.prep import split_column
from ..session import written
from . import basetables as bt
from .registry import register

DOC_KEY = ["doc_id"]
DOC_NUM = ["n_chars", "quality"]
DOC_CAT = ["lang", "source"]
PANEL_CFG = md.ModelConfig()


def _doc_base(spark, sf_dir):
    return bt.labelled_documents(spark, sf_dir)


def doc_panel(spark, sf_dir, candidates=None):
    """The labelled-document panel, or the named members of it."""
    return md.train_panel(_doc_base(spark, sf_dir), "toxic", DOC_KEY, DOC_NUM, DOC_CAT,
                          "binary_classification", PANEL_CFG, candidates=candidates)


def _board_out(lb):
    return lb.table.select("name", "ord", "primary_metric", "cv_score", "test_score", "notes", "selected",
                           F.to_json("all_metrics").alias("all_metrics"))


@register("leaderboard")
def q_leaderboard(spark, sf_dir):
    """ML2-ML7, ML19-ML21, ML23: toxic flag on labelled documents; logistic / forest /
    boosting panel with k-fold CV, soft-vote ensemble, selection by CV ROC-AUC."""
    return _board_out(doc_panel(spark, sf_dir))


def _single(spark, sf_dir, technique, task="binary_classification", target="toxic", cfg=None):
    base = _doc_base(spark, sf_dir)
    lb = md.train_panel(base, target, DOC_KEY, DOC_NUM, DOC_CAT, task, cfg or PANEL_CFG,
                        user_technique=technique, only_user_technique=True)
    return lb.table.select("name", "primary_metric", "cv_score", "test_score",
                           F.to_json("all_metrics").alias("all_metrics"))


@register("model_tree")
def q_model_tree(spark, sf_dir):
    """ML10 requested as a user technique, trained alone with the panel's CV / held-out protocol."""
    return _single(spark, sf_dir, "Decision Tree")


@register("model_svm")
def q_model_svm(spark, sf_dir):
    """ML13: linear SVM requested as a user technique; the margin squashed to (0, 1) is the score."""
    return _single(spark, sf_dir, "svc")


@register("model_mlp")
def q_model_mlp(spark, sf_dir):
    """ML14: multi-layer perceptron classifier requested as a user technique."""
    return _single(spark, sf_dir, "mlp")


@register("model_naive_bayes")
def q_model_naive_bayes(spark, sf_dir):
    """ML11 through MLlib (gaussian naive Bayes) requested as a user technique."""
    return _single(spark, sf_dir, "naive bayes")


# ---- regression panel on parts: retail price from size, brand and type -------------------
PART_NUM = ["p_size"]
PART_CAT = ["p_brand"]


@register("leaderboard_regression")
def q_leaderboard_regression(spark, sf_dir):
    """Regression panel (linear / forest / boosting) selected by CV RMSE."""
    return _board_out(part_panel(spark, sf_dir))


@register("model_ridge_lasso")
def q_model_ridge_lasso(spark, sf_dir):
    """ML9: ridge and lasso, each requested as a user technique on the part-price regression and
    trained alone with the panel's CV / held-out protocol."""
    part = bt.read_table(spark, sf_dir, "part")
    out = []
    for tech in ("ridge", "lasso"):
        lb = md.train_panel(part, "p_retailprice", ["p_partkey"], PART_NUM, PART_CAT, "regression",
                            user_technique=tech, only_user_technique=True)
        out.append(lb.table.where(F.col("name").isin("Ridge Regression", "Lasso Regression"))
                   .select("name", "cv_score", "test_score", F.lit(lb.user_note).alias("user_note")))
    return out[0].unionByName(out[1])


@register("model_linear_single", oracle="""
SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, COUNT(*) AS n FROM lineitem""")
def q_model_linear_single(spark, sf_dir):
    """ML3 single-feature form: MLlib normal-equation fit equals the closed-form regr_* line."""
    li = bt.read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    va = VectorAssembler(inputCols=["l_quantity"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="l_extendedprice", solver="normal")
    m = Pipeline(stages=[va, lr]).fit(li).stages[-1]
    n = li.count()
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 4).alias("coefficient"),
                                 F.round(F.lit(float(m.intercept)), 4).alias("intercept"),
                                 F.lit(n).cast("bigint").alias("n"))


# sums per fold, training sums by subtraction, the two normal equations solved in closed form
FOLD_SQL = """
WITH d AS (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) * 100 AS b,
                  CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_orderkey IS NOT NULL),
s AS (SELECT fold, COUNT(*) AS n, SUM(a) AS sa, SUM(b) AS sb, SUM(y) AS sy, SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb,
             SUM(a * y) AS ay, SUM(b * y) AS by_ FROM d GROUP BY fold),
t AS (SELECT f.fold, SUM(s.n) AS n, SUM(sa) AS sa, SUM(sb) AS sb, SUM(sy) AS sy, SUM(aa) AS aa, SUM(ab) AS ab, SUM(bb) AS bb, SUM(ay) AS ay,
             SUM(by_) AS by_ FROM (SELECT DISTINCT fold FROM s UNION ALL SELECT -1) f(fold) JOIN s ON s.fold <> f.fold GROUP BY f.fold),
c AS (SELECT *, aa - sa * sa / n AS caa, ab - sa * sb / n AS cab, bb - sb * sb / n AS cbb, ay - sa * sy / n AS cay, by_ - sb * sy / n AS cby FROM t),
k AS (SELECT c.*, kind, p FROM c, (VALUES ('linear', 0.0), ('ridge 1', 1.0), ('ridge 10000', 10000.0)) v(kind, p)),
w AS (SELECT *, ((cbb + p) * cay - cab * cby) / ((caa + p) * (cbb + p) - cab * cab) AS wa,
             ((caa + p) * cby - cab * cay) / ((caa + p) * (cbb + p) - cab * cab) AS wb FROM k),
b AS (SELECT *, sy / n - wa * sa / n - wb * sb / n AS w0 FROM w)
"""


@register("model_folds_linear", oracle=FOLD_SQL + """
SELECT b.kind, b.fold, ROUND(wa, 6) AS quantity, ROUND(wb, 6) AS discount, ROUND(w0, 5) AS intercept,
       ROUND(sqrt(AVG(power(w0 + wa * d.a + wb * d.b - d.y, 2))), 5) AS rmse
FROM b LEFT JOIN d ON d.fold = b.fold GROUP BY ALL""")
def q_model_folds_linear(spark, sf_dir):
    """ML3, ML9, ML19: least squares and a ridge path on every fold and on all rows, with each held-out
    fold's RMSE, from one scan of the lines."""
    li = bt.read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_discount").cast("double") * 100).alias("discount"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"))
    kinds = {"linear": ("linear", 0.0), "ridge 1": ("ridge", 1.0), "ridge 10000": ("ridge", 10000.0)}
    fits = ff.fold_fits(li, "price", ["quantity", "discount"], [], "fold", kinds, standardise=False)
    return spark.createDataFrame(
        [(x.kind, -1 if x.fold is None else x.fold, *[round(float(c), 6) for c in x.coefficients], round(x.intercept, 5),
          None if x.rmse is None else round(x.rmse, 5)) for x in fits],
        "kind string, fold int, quantity double, discount double, intercept double, rmse double")


@register("model_logistic")
def q_model_logistic(spark, sf_dir):
    """ML2: balanced logistic regression scored on the held-out split (test metrics)."""
    lb = doc_panel(spark, sf_dir, ["LogisticRegression"])
    return lb.table.where(F.col("name") == "LogisticRegression").select(
        "name", "cv_score", "test_score", F.to_json("all_metrics").alias("all_metrics"))


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """ML22: importance of each original column for the selected model of the whole panel, over
    all held-out rows."""
    lb = doc_panel(spark, sf_dir)
    imp = md.permutation_importance(lb, _doc_base(spark, sf_dir), "toxic", DOC_KEY)
    return imp.select("feature", "col_ord", rnd(F.col("importance")).alias("importance"),
                      rnd(F.col("importance_std")).alias("importance_std"))


@register("ensemble_scores")
def q_ensemble_scores(spark, sf_dir):
    """ML7: ensemble row of the leaderboard (mean of the members' probabilities)."""
    lb = doc_panel(spark, sf_dir)
    return lb.table.where(F.col("name") == "Ensemble").select(
        "name", "cv_score", "test_score", F.to_json("all_metrics").alias("all_metrics"))


# ---- Gaussian NB in SQL form ---------------------------------------------------------------
_NB_SPLIT = f"CASE WHEN {stable_bucket_sql(['doc_id'], 100, 42)} < 20 THEN 'test' ELSE 'train' END"


@register("gaussian_nb", oracle=f"""
WITH b AS (SELECT l.doc_id, CAST(l.toxic AS DOUBLE) AS label, CAST(d.n_chars AS DOUBLE) AS n_chars,
                  CAST(l.quality AS DOUBLE) AS quality, {_NB_SPLIT.replace('doc_id', 'l.doc_id')} AS split
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
tr AS (SELECT * FROM b WHERE split = 'train'),
lg AS (SELECT label, 'n_chars' AS feature, n_chars AS x FROM tr UNION ALL SELECT label, 'quality', quality FROM tr),
eps AS (SELECT MAX(v) * 1e-9 AS e FROM (SELECT feature, var_pop(x) AS v FROM lg GROUP BY 1)),
st AS (SELECT label, feature, AVG(x) AS mean, var_pop(x) + (SELECT e FROM eps) AS var FROM lg GROUP BY 1, 2),
pr AS (SELECT label, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM tr) AS prior FROM tr GROUP BY 1),
te AS (SELECT doc_id, 'n_chars' AS feature, n_chars AS x FROM b WHERE split = 'test'
       UNION ALL SELECT doc_id, 'quality', quality FROM b WHERE split = 'test'),
ll AS (SELECT te.doc_id, st.label, SUM(-0.5 * ln(2 * pi() * st.var) - power(te.x - st.mean, 2) / (2 * st.var)) AS s
       FROM te JOIN st ON te.feature = st.feature GROUP BY 1, 2),
post AS (SELECT ll.doc_id, ll.label, ll.s + ln(pr.prior) AS lp FROM ll JOIN pr ON ll.label = pr.label),
pred AS (SELECT doc_id, arg_max(label, (lp, -label)) AS pred FROM post GROUP BY 1)
SELECT CAST(b.label AS INTEGER) AS label, CAST(pred.pred AS INTEGER) AS pred, COUNT(*) AS n
FROM pred JOIN b ON pred.doc_id = b.doc_id GROUP BY 1, 2""")
def q_gaussian_nb(spark, sf_dir):
    """ML11 in pure aggregate form: confusion counts on the held-out split."""
    base = _doc_base(spark, sf_dir).select(
        "doc_id", F.col("toxic").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
        F.col("quality").cast("double").alias("quality"), split_column(["doc_id"]).alias("split"))
    feats = ["n_chars", "quality"]
    model = nb.gaussian_nb_fit(base.where("split = 'train'"), feats)
    test = base.where("split = 'test'")
    pred = nb.gaussian_nb_predict(test, model, ["doc_id"], feats)
    return pred.join(test.select("doc_id", "label"), "doc_id").groupBy(
        F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


# ---- exact k-NN vote on embeddings --------------------------------------------------------
_EMB_SPLIT = f"CASE WHEN {stable_bucket_sql(['vec_id'], 100, 42)} < 20 THEN 'test' ELSE 'train' END"


@register("knn_vote", oracle=f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {_EMB_SPLIT} AS split FROM embeddings),
q AS (SELECT * FROM e WHERE split = 'test'), r AS (SELECT * FROM e WHERE split = 'train'),
d AS (SELECT q.vec_id AS qkey, r.vec_id AS rkey, r.label AS rlabel, list_distance(q.v, r.v) AS dist FROM q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY dist, rkey) AS rk FROM d),
v AS (SELECT qkey, rlabel, COUNT(*) AS votes FROM k WHERE rk <= 5 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY votes DESC, rlabel) AS r FROM v)
SELECT qkey AS vec_id, CAST(rlabel AS BIGINT) AS pred, votes FROM w WHERE r = 1""")
def q_knn_vote(spark, sf_dir):
    """ML12: each held-out embedding gets the majority label of its 5 nearest training rows."""
    e = bt.read_table(spark, sf_dir, "embeddings").withColumn("split", split_column(["vec_id"]))
    return nb.knn_vote(e.where("split = 'test'"), e.where("split = 'train'"), "vec_id", "embedding", "label")


@register("technique_resolution")
def q_technique_resolution(spark, sf_dir):
    """ML8: what a user's words name: the words of all texts of the conversations looked up as
    technique names and aliases, with the note a request for either kind of task would get."""
    words = bt.read_table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("request"))
    asked = words.where("request != ''").groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    found = md.technique_lookup(asked, "request").join(asked, "request")
    notes = spark.createDataFrame([(t, k, md.resolve_technique(t, k)[1] or "") for t in md.TECHNIQUE_CHOICES
                                   for k in ("binary_classification", "regression")], "resolved string, task string, note string")
    # the note table has one row per technique and task
    return found.join(F.broadcast(notes), "resolved", "left").select("request", "n", "resolved", "how", "task", "note")


@register("knn_regress", oracle=f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {_EMB_SPLIT} AS split FROM embeddings),
q AS (SELECT * FROM e WHERE split = 'test'), r AS (SELECT * FROM e WHERE split = 'train'),
d AS (SELECT q.vec_id AS qkey, r.vec_id AS rkey, r.label AS rlabel, list_distance(q.v, r.v) AS dist FROM q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY dist, rkey) AS rk FROM d)
SELECT qkey AS vec_id, ROUND(AVG(rlabel::DOUBLE), 6) AS pred FROM k WHERE rk <= 5 GROUP BY 1""")
def q_knn_regress(spark, sf_dir):
    """ML12, regression: each held-out embedding gets the mean label of its 5 nearest training rows."""
    e = bt.read_table(spark, sf_dir, "embeddings").withColumn("split", split_column(["vec_id"]))
    p = nb.knn_regress(e.where("split = 'test'"), e.where("split = 'train'"), "vec_id", "embedding", "label")
    return p.select("vec_id", rnd(F.col("pred")).alias("pred"))


@register("model_knn")
def q_model_knn(spark, sf_dir):
    """ML12 requested as a user technique, trained alone with the panel's CV / held-out protocol."""
    return _single(spark, sf_dir, "knn")


def _row(spark, sf_dir, name):
    lb = doc_panel(spark, sf_dir, [name])
    return lb.table.where(F.col("name") == name).select(
        "name", "cv_score", "test_score", "selected", F.to_json("all_metrics").alias("all_metrics"))


@register("model_forest")
def q_model_forest(spark, sf_dir):
    """ML4: random forest (200 trees, balanced weights) row of the panel."""
    return _row(spark, sf_dir, "RandomForest")


@register("model_gbt")
def q_model_gbt(spark, sf_dir):
    """ML5: gradient-boosted trees row of the panel."""
    return _row(spark, sf_dir, "GradientBoosting")


def part_panel(spark, sf_dir, candidates=None):
    return md.train_panel(bt.read_table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"], PART_NUM, PART_CAT,
                          "regression", PANEL_CFG, candidates=candidates)


@register("model_linear")
def q_model_linear(spark, sf_dir):
    """ML3: linear regression row of the regression panel (RMSE / MAE / R2 on held-out rows)."""
    lb = part_panel(spark, sf_dir, ["LinearRegression"])
    return lb.table.where(F.col("name") == "LinearRegression").select(
        "name", "cv_score", "test_score", F.to_json("all_metrics").alias("all_metrics"))


# ---- local attributions ---------------------------------------------------------------------
@register("attribution_linear", oracle="""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT regr_slope(o_totalprice::DOUBLE, n::DOUBLE) AS b, AVG(n::DOUBLE) AS m FROM o)
SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(b * (o.n - m)) / 1000, 3) AS attribution, ROUND(SUM(abs(b * (o.n - m))) / 1000, 3) AS moved
FROM o, f GROUP BY o_orderpriority""")
def q_attribution_linear(spark, sf_dir):
    """How much the number of lines moves each order's predicted price, by priority."""
    per = bt.read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = bt.read_table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    fit = o.agg(F.regr_slope(F.col("o_totalprice").cast("double"), F.col("n").cast("double")).alias("b"), F.avg("n").alias("m")).first()
    part = at.linear_attributions({"n": fit.b}, {"n": fit.m})["n"]
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(part) / 1000, 3).alias("attribution"),
                                            F.round(F.sum(F.abs(part)) / 1000, 3).alias("moved"))


@register("attribution_boosting")
def q_attribution_boosting(spark, sf_dir):
    """Shapley values of leaf-wise boosted trees for every held-out labelled document: per original column
    how far it moves scores, and whether each row's values add up to its score less the base."""
    table = written(md.model_table(_doc_base(spark, sf_dir), "toxic", DOC_KEY, DOC_NUM + DOC_CAT, "binary_classification", PANEL_CFG.seed),
                    "attribution-split")
    prep = md.prepare(table.where("_if_split = 'train'"), DOC_NUM, DOC_CAT)
    train = md.featurize(prep, table.where("_if_split = 'train'"), [md.Y]).cache()
    model = bo.HistogramBoosting(bo.BoostSettings(iterations=20), md.Y).fit(train)
    train.unpersist()
    pre = prep.pre
    names = list(pre.numeric) + [c for c in pre.categorical for _ in pre.categories.get(c, [])]
    feat = md.featurize(prep, table.where("_if_split = 'test'"), DOC_KEY)
    each = at.attributions(model, feat, names, DOC_KEY)
    score = model.score(feat, "p").select("doc_id", (F.log("p") - F.log1p(-F.col("p")) - F.lit(float(at.base_value(model)))).alias("gained"))
    rows = each.groupBy("doc_id").agg(F.sum("attribution").alias("total")).join(score, "doc_id")
    gap = rows.agg(F.max(F.abs(F.col("total") - F.col("gained")))).scalar()
    return each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.abs("attribution"))).alias("mean_moved")).withColumn(
        "adds_up", gap < F.lit(1e-6))
