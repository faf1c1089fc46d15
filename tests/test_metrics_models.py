"""Metrics against brute force (ML15-18), preparation (M*) and the model panel (ML*)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from insightframe.operators import metrics as mt
from insightframe.operators import models as md
from insightframe.operators import prep as pp


def _scores(seed=0, n=400, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = rng.random(n) * 0.6 + y * 0.3
    if ties:
        s = np.round(s, 1)
    return [(float(a), int(b)) for a, b in zip(s, y)]


def _brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(rows):
    P = sum(y for _, y in rows)
    ap = 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        pos_here = sum(1 for s, y in rows if s == t and y == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def test_auc_and_ap_match_brute_force_across_buckets(spark):
    for ties in (True, False):
        rows = _scores(ties=ties)
        df = spark.createDataFrame(rows, "p double, y int")
        for nb in (4, 256):   # few buckets: cumulative sums cross bucket boundaries
            auc = mt.roc_auc(df, "p", "y", n_buckets=nb).first()[0]
            ap = mt.average_precision(df, "p", "y", n_buckets=nb).first()[0]
            assert abs(auc - _brute_auc(rows)) < 1e-12
            assert abs(ap - _brute_ap(rows)) < 1e-12
        both = mt.ranking_metrics(df, "p", "y", n_buckets=8).first()
        assert abs(both.roc_auc - _brute_auc(rows)) < 1e-12


def test_grouped_auc(spark):
    rows = [(g,) + r for g in (0, 1) for r in _scores(seed=g)]
    df = spark.createDataFrame(rows, "g int, p double, y int")
    got = {r.g: r.roc_auc for r in mt.roc_auc(df, "p", "y", n_buckets=5, group=["g"]).collect()}
    for g in (0, 1):
        assert abs(got[g] - _brute_auc(_scores(seed=g))) < 1e-12


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    m = mt.classification_metrics(df, "p", "y").first()
    assert m.f1 == 0.0 and m.accuracy == 1.0


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert mt.roc_auc(df, "p", "y").first()[0] is None


def test_metric_policy_boundaries():
    assert mt.metric_policy("binary_classification", 0.0499)[0] == "PR-AUC"
    assert mt.metric_policy("binary_classification", 0.05)[0] == "ROC-AUC"
    assert mt.metric_policy("binary_classification", 0.95)[0] == "ROC-AUC"
    assert mt.metric_policy("binary_classification", 0.951)[0] == "PR-AUC"
    assert mt.metric_policy("regression", None)[0] == "RMSE"


def test_splits_are_deterministic_and_balanced(spark):
    df = spark.range(20000).withColumn("split", pp.split_column(["id"]))
    a = df.groupBy("split").count().collect()
    b = spark.range(20000).withColumn("split", pp.split_column(["id"])).groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    share = {r.split: r["count"] for r in a}["test"] / 20000
    assert 0.18 < share < 0.22


def test_preprocessor_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, "b"), (5.0, None)], "x double, c string")
    p = pp.fit_preprocessor(train, ["x"], ["c"])
    assert p.medians["x"] == 3.0 and p.modes["c"] == "a" and p.categories["c"] == ["a", "b"]
    test = spark.createDataFrame([(None, "z")], "x double, c string")
    row = p.transform(test, []).first().asDict()
    assert row["num__x"] == 0.0                       # imputed with the median = mean here
    assert row["cat__c=a"] == 0.0 and row["cat__c=b"] == 0.0   # unseen category -> all zeros


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 25 + [(0,)] * 75, "y int")
    w = {r.y: r.weight for r in pp.class_weights(df).collect()}
    assert abs(w[1] - 2.0) < 1e-12 and abs(w[0] - 100 / 150) < 1e-12


def test_technique_resolution():
    assert md.resolve_technique("rf", "binary_classification") == ("Random Forest", None)
    r, note = md.resolve_technique("Ridge Regression", "binary_classification")
    assert r == "Ridge Regression" and "regression technique" in note
    for task in ("binary_classification", "regression"):
        assert md.resolve_technique("knn", task) == ("K-Nearest Neighbors", None)
    assert "unavailable" in md.resolve_technique("svr", "regression")[1]
    assert md.resolve_technique("telepathy", "regression")[0] is None


def test_splits_and_folds_are_even_inside_classes(spark, monkeypatch):
    monkeypatch.setattr(pp, "RANK_ROWS", 70)  # several ranges, as in a large table
    df = spark.range(500).select("id", (F.col("id") % 25 == 0).cast("int").alias("y"))
    s = pp.stratified_split(df, "y", ["id"])
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(1, "test"): 4, (1, "train"): 16, (0, "test"): 96, (0, "train"): 384}
    folds = pp.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in folds if r.y == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    assert s.count() == 500 and sorted(s.columns) == ["id", "split", "y"]
    sample = {r.y: r["count"] for r in pp.stratified_sample(df, "y", ["id"], 100).groupBy("y").count().collect()}
    assert sample == {0: 96, 1: 4}


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    from insightframe.functions import quantiles as qt
    rng = np.random.default_rng(3)
    cols = {"fine": rng.normal(size=30000), "tied": rng.integers(0, 3, 30000).astype(float), "one": np.ones(30000)}
    df = spark.createDataFrame(__import__("pandas").DataFrame(cols)).withColumn("none", F.lit(None).cast("double")) \
        .withColumn("holes", F.when(F.col("fine") > 0, F.col("fine")).otherwise(F.lit(float("nan"))))
    monkeypatch.setattr(qt, "ACCURACY", 50)
    monkeypatch.setattr(qt, "LAST_ROWS", 20)  # many rounds of narrowing
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = qt.exact_quantiles(df, {c: F.col(c) for c in (*cols, "none", "holes")}, probs)
    for c, x in cols.items():
        assert np.allclose(got[c], np.quantile(x, probs), atol=1e-12), c
    assert got["none"] == [None] * 5
    assert np.allclose(got["holes"], np.quantile(cols["fine"][cols["fine"] > 0], probs), atol=1e-12)


def test_every_category_becomes_a_feature(spark):
    df = spark.range(600).select((F.col("id") % 60).cast("string").alias("c"))
    assert len(pp.fit_preprocessor(df, [], ["c"]).feature_names()) == 60


def test_panel_with_awkward_names_and_repeated_rows(spark):
    """A target named label, dotted columns and values, and rows that all occur three times."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1009)) / 1009.0
    base = spark.range(150).select(
        F.round(u(1), 3).alias("a.b"), F.when(u(2) < 0.5, "U.S.").otherwise("x=y `z`").alias("score"),
        (u(1) + 0.4 * u(3) > 0.7).cast("int").alias("label"))
    df = base.unionByName(base).unionByName(base)
    cfg = md.ModelConfig(num_trees=5, max_depth=3, gbt_iter=3, gbt_depth=2)
    lb = md.train_panel(df, "label", df.columns, ["a.b"], ["score"], "binary_classification", cfg)
    assert {r.name for r in lb.table.collect()} == {"LogisticRegression", "RandomForest", "GradientBoosting", "Ensemble"}
    table = md.model_table(df, "label", df.columns, ["a.b", "score"], "binary_classification", 42)
    held = table.where(F.col(md.SPLIT) == "test")
    feat = md.featurize(lb.prepared, held, [md.Y])
    scored = md.with_scores(list(lb.fits.values()), lb.task, feat, lb.members, [md.Y])
    per = {r.model: r["count"] for r in scored.groupBy("model").count().collect()}
    assert set(per.values()) == {held.count()} and "Ensemble" in per  # no row is lost in the vote


def test_nearest_neighbours_in_small_blocks(spark):
    from insightframe.operators import neighbors as nb
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(0, 4, 3)], int(rng.integers(0, 3))) for i in range(300)]
    ref, ask = (spark.createDataFrame(r, "id long, v array<double>, y int") for r in (rows[:220], rows[220:]))
    want_vote, want_mean = {}, {}
    for i, v, _ in rows[220:]:
        near = sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), j, y) for j, w, y in rows[:220])[:5]
        labels = [y for _, _, y in near]
        want_vote[i] = min(set(labels), key=lambda c: (-labels.count(c), c))  # noqa: B023
        want_mean[i] = np.mean(labels)
    for sizes in ({}, {"batch_rows": 9, "block_rows": 40}):
        assert {r.id: r.pred for r in nb.knn_vote(ask, ref, "id", "v", "y", **sizes).collect()} == want_vote
        got = {r.id: r.pred for r in nb.knn_regress(ask, ref, "id", "v", "y", **sizes).collect()}
        assert all(abs(got[i] - m) < 1e-12 for i, m in want_mean.items()) and len(got) == 80


def test_neighbours_are_met_in_few_blocks(spark):
    """Clustered rows with a hot cluster of a third: the same neighbours, in a fraction of the cells."""
    from insightframe.operators import neighbors as nb
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 100, (30, 4))
    which = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 30, 1500))
    rows = [(i, (centre[c] + rng.normal(0, 1, 4)).tolist(), float(c)) for i, c in enumerate(which.tolist())]
    rows += [(1500 + i, rows[7][1], 5.0) for i in range(60)]  # equal rows: ties at distance 0
    ref = spark.createDataFrame(rows[200:], "rkey long, rvec array<double>, rlabel double")
    ask = spark.createDataFrame([(k, v) for k, v, _ in rows[:200]] + [(9999, [1e4, 0.0, 0.0, 0.0])], "qkey long, qvec array<double>")
    x = np.array([v for _, v, _ in rows[200:]])
    want = {}
    for q in ask.collect():
        d = np.sqrt(((x - np.array(q.qvec)) ** 2).sum(axis=1))
        want[q.qkey] = sorted(zip(d.tolist(), [k for k, _, _ in rows[200:]], strict=True))[:5]
    got = {}
    for r in nb.nearest(ask, ref, 5, 64, 50).collect():
        got.setdefault(r.qkey, {})[r["rank"]] = (r.dist, r.rkey)
    assert {q: [k for _, k in v] for q, v in want.items()} == {q: [v[i + 1][1] for i in range(5)] for q, v in got.items()}
    sent, placed, _ = nb.routes(ask, ref, 5, 64, 50)
    blocks = placed.select("pivot", "ring", "part").distinct().count()
    assert blocks >= 20 and sent.count() < 0.4 * blocks * 201
    assert placed.groupBy("pivot", "ring", "part").count().agg(F.max("count")).first()[0] <= 100
    assert nb.nearest(ask, ref.where("rkey < 0"), 5).count() == 0 and nb.nearest(ask.where("qkey < 0"), ref, 5).count() == 0


def test_requested_knn_and_svm_train(spark, lending):
    small = lending.where("fico_score < 720")  # enough rows that chance does not decide
    for name in ("knn", "svc"):
        lb = md.train_panel(small, "default", ["loan_id"], ["fico_score"], ["grade"], "binary_classification",
                            user_technique=name, only_user_technique=True, folds=2)
        row = lb.table.first()
        assert row.test_score > 0.55 and 0 <= row.all_metrics["Brier"] < 0.3  # a probability, not a margin


def test_technique_lookup_batch(spark):
    req = spark.createDataFrame([("RF",), ("Naive Bayes",), ("xyz",)], "request string")
    got = {r.request: (r.resolved, r.how) for r in md.technique_lookup(req).collect()}
    assert got == {"RF": ("Random Forest", "alias"), "Naive Bayes": ("Naive Bayes", "name"), "xyz": (None, "unknown")}


def test_panel_on_planted_signal(spark, lending):
    cfg = md.ModelConfig(num_trees=20, max_depth=4, gbt_iter=10, gbt_depth=3)
    lb = md.train_panel(lending, "default", ["loan_id"], ["fico_score", "annual_income"],
                        ["grade", "home_ownership"], "binary_classification", cfg, user_technique="tree")
    rows = {r.name: r for r in lb.table.collect()}
    assert {"LogisticRegression", "RandomForest", "GradientBoosting", "Ensemble", "Decision Tree"} <= set(rows)
    assert lb.metric == "ROC-AUC" and rows[lb.selected].test_score > 0.6
    assert sum(r.selected for r in rows.values()) == 1
    imp = {r.feature: r.importance for r in md.permutation_importance(lb, lending, "default", ["loan_id"]).collect()}
    assert max(imp, key=imp.get) in ("grade", "fico_score")


def test_regression_panel_r2(spark):
    from pyspark.sql import functions as F
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(100003)) / 100003.0
    df = spark.range(1500).select("id", (u(1) * 4 - 2).alias("x1"), (u(2) * 4 - 2).alias("x2"),
                                  ((u(3) - 0.5) * 1.0).alias("e"))
    df = df.withColumn("target", 3 * F.col("x1") - 2 * F.col("x2") + F.col("e")).drop("e")
    lb = md.train_panel(df, "target", ["id"], ["x1", "x2"], [], "regression",
                        md.ModelConfig(num_trees=20, max_depth=5, gbt_iter=10, gbt_depth=3))
    rows = {r.name: r for r in lb.table.collect()}
    assert lb.metric == "RMSE"
    assert rows["LinearRegression"].all_metrics["R2"] > 0.8


def test_permutation_importance_explains_the_whole_panel(monkeypatch):
    from insightframe.plans import queries_models as qm
    asked = []

    class Asked(Exception):
        pass

    def train_panel(*args, candidates=None, **options):
        asked.append(candidates)
        raise Asked

    monkeypatch.setattr(qm, "_doc_base", lambda *a: None)
    monkeypatch.setattr(qm.md, "train_panel", train_panel)
    with pytest.raises(Asked):
        qm.q_permutation_importance(None, "")
    assert asked == [None]  # as the leaderboard: every candidate


def test_importance_chart_rows(spark):
    from insightframe.operators import artifacts as ar
    imp = spark.createDataFrame([("a", 0.1234567, 0.01, 0), ("b", -0.2, 0.0, 1), ("c", 0.5, 0.1, 2), ("d", 0.5, 0.1, 3), ("e", 0.0, 0.0, 4)],
                                "feature string, importance double, importance_std double, col_ord int")
    rows = ar.chart_importance(md.top_importances(imp)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("feature_importance", 0, "c", 0.5), ("feature_importance", 1, "d", 0.5), ("feature_importance", 2, "a", 0.12346)]
    assert ar.chart_importance(md.top_importances(imp.where("importance < 0"))).count() == 0


def test_knn_holds_few_queries_and_blocks_at_once():
    import tracemalloc

    import pandas as pd

    from insightframe.operators import neighbors as nb
    rng = np.random.default_rng(4)
    cells = nb.Partition(rng.normal(size=(64, 64)), [np.linspace(4, 14, 63)] * 64, np.full(64, 20.0), np.ones((64, 64), np.int64))
    cells.parts[3] = 3
    x = rng.normal(size=(2_000, 64))
    pdf = pd.DataFrame({"qkey": np.arange(len(x)), "qvec": list(x), "bound": 2.0})
    few = pdf[:20]
    row, pivot, ring = cells.reachable(cells.distances(x[:20]), np.full(20, 2.0))
    want = sorted((int(r), int(p), int(g), k) for r, p, g in zip(row, pivot, ring, strict=True) for k in range(cells.parts[p, g]))
    table = pd.concat(nb._sent_tables(few, cells, False))
    assert sorted(table[["qkey", "pivot", "ring", "part"]].itertuples(index=False, name=None)) == want and len(want) > nb.SENT_ROWS
    assert all((v == x[k]).all() for k, v in zip(table["qkey"], table["qvec"], strict=True))
    tracemalloc.start()
    largest = 0
    for t in nb._sent_tables(pdf, cells, False):
        largest = max(largest, len(t))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert largest <= nb.SENT_ROWS and peak < 100e6
