"""Profiling flags and role resolution (C*, P*) on edge-case fixtures (Appendix A quirks)."""
import bisect
import contextlib
import io
import math

from pyspark.sql import functions as F

from insightframe.functions import sketches as sk
from insightframe.operators import profile as pf
from insightframe.operators import roles as rl
from insightframe.sources.io import nan_to_null


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("\n(1) ")[0]


def _edges(spark):
    rows = []
    for i in range(100):
        rows.append((f"s{i}", i, float(i) + 0.5, 7, None if i % 4 == 0 else 1.0,
                     1000.0 if i < 5 else float(i % 10), i % 2 == 0, float("nan") if i == 3 else 1.5))
    return spark.createDataFrame(rows, "uid string, iid int, fid double, const int, miss double, "
                                       "outl double, flag boolean, nanc double")


def test_quality_flags(spark):
    p = {r.col_name: list(r.quality_flags) for r in pf.profile_columns(nan_to_null(_edges(spark))).collect()}
    assert p["uid"] == ["possible_id"]
    assert p["iid"] == ["possible_id"]
    assert "possible_id" not in p["fid"]            # all-unique floats are measurements
    assert p["const"] == ["constant"]
    assert p["miss"] == ["high_missing", "constant"]
    assert p["outl"] == ["outliers"]
    assert p["flag"] == []                          # booleans skip the outlier test
    assert p["nanc"] == ["constant"]                # NaN counted as missing (folded to NULL)


def test_profile_missing_and_distinct(spark):
    rows = {r.col_name: r for r in pf.profile_columns(nan_to_null(_edges(spark))).collect()}
    assert rows["miss"].missing_pct == 25.0 and rows["miss"].n_unique == 1
    assert rows["nanc"].missing_pct == 1.0


def test_exact_and_sketched_quartiles_agree_on_small_data(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    e = pf.quartiles(df, ["x"]).first()
    a = pf.quartiles_sketched(df, ["x"]).first()
    assert (e.q1, e.q3) == (250.0, 750.0)
    assert a.n == 1001 and abs(a.q1 - 250) <= 1 and abs(a.q3 - 750) <= 1


def test_sketches_keep_their_rank_error_when_merged(spark):
    """Skewed values with ties, NULL and NaN; sketches by day, merged to months and to the whole."""
    df = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), (F.col("id") % 30 % 2).alias("half"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan"))
        .otherwise(F.floor(F.pow(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0, 3))).cast("double").alias("x"),
        F.lit(None).cast("int").alias("nothing"))
    k = 128
    days = sk.quantile_sketches(df, {"x": F.col("x"), "nothing": F.col("nothing")}, ["day"], k).persist()
    assert days.where("col_name = 'nothing'").agg(F.max("n"), F.max(F.col("sketch").isNotNull().cast("int"))).first() == (0, 0)
    halves = sk.merge_sketches(days.withColumn("half", F.col("day") % 2), ["half"], k)
    whole = sk.merge_sketches(halves, None, k)
    rows = [(r.half, r.x) for r in df.select("half", "x").collect() if r.x is not None and r.x == r.x]
    probs = {f"p{i}": i / 20 for i in range(1, 20)}
    for found, part in ((sk.sketch_quantiles(halves, probs), lambda h: lambda x: x == h), (sk.sketch_quantiles(whole, probs), lambda h: lambda x: True)):
        for r in found.where("col_name = 'x'").collect():
            mine = sorted(x for h, x in rows if part(getattr(r, "half", None))(h))
            assert r.n == len(mine)
            for name, p in probs.items():
                lo, hi = bisect.bisect_left(mine, r[name]) / r.n, bisect.bisect_right(mine, r[name]) / r.n
                assert lo - 2 * sk.rank_error(k) <= p <= hi + 2 * sk.rank_error(k)
    days.unpersist()


def test_sketches_take_one_scan(spark):
    plan = plan_text(pf.quartiles_sketched(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), ["l_quantity", "l_tax"]))
    assert plan.count("Scan parquet") == 1


def test_binary_encodings(spark):
    def enc(rows, schema):
        df = spark.createDataFrame(rows, schema)
        lab = rl.positive_label(df, "v").first()
        ys = [r.y for r in rl.encode_binary(df, "v").collect()]
        return lab.positive, lab.rule, ys
    assert enc([(0,), (1,), (None,), (1,)], "v int") == ("1", "zero_one", [0, 1, 0, 1])
    assert enc([(1,), (2,), (2,), (None,)], "v int") == ("1", "token", [1, 0, 0, 0])  # "1" is a token
    assert enc([(3,), (2,), (2,), (None,)], "v int") == ("3", "minority", [1, 0, 0, 0])
    assert enc([("No",), (" Yes",), ("No",), (None,)], "v string") == (" Yes", "token", [0, 1, 0, 0])
    assert enc([("active",), ("churned",), ("active",)], "v string")[:2] == ("churned", "minority")
    # tie in frequency: the smaller value wins
    assert enc([("b",), ("a",)], "v string")[:2] == ("a", "minority")
    assert enc([(True,), (False,), (None,)], "v boolean") == ("1", "zero_one", [1, 0, 0])


def test_time_column_detection(spark):
    rows = [("2024-01-05", "2024-01-05", 123456, "1889-03-01", None, "12:30") for _ in range(5)]
    rows.append(("2024-02-01", "garbage", 99, "1889-04-01", None, "12:31"))
    df = spark.createDataFrame(rows, "good_date string, bad_date string, elapsed_time long, "
                                     "old_date string, empty_date string, clock_time string")
    t = {r.col_name: r for r in rl.time_column_scan(df).collect()}
    assert t["good_date"].is_time and t["good_date"].chosen
    assert not t["bad_date"].is_time          # one value fails -> rejected
    assert not t["elapsed_time"].is_time      # epoch-nanosecond reading lands in 1970
    assert not t["old_date"].is_time          # outside 1990..2100
    assert not t["empty_date"].is_time        # all NULL
    assert not t["clock_time"].is_time        # time-only strings never count as dates


def test_target_resolution_rules(spark):
    def chosen(explicit, candidates, n_unique):
        prof = spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(n_unique.items())], "col_name string, col_ord int, n_unique long")
        cands = spark.createDataFrame([(c, i + 1) for i, c in enumerate(candidates)], "col_name string, cand_ord int")
        return tuple(rl.choose_targets(prof, cands, explicit).first())

    assert chosen("x", ["default"], {"x": 900, "default": 2}) == ("x", None)
    assert chosen("default", ["flag", "default"], {"flag": 2, "default": 2}) == ("default", "default")
    assert chosen("gone", ["flag"], {"flag": 2}) == ("flag", None)
    assert chosen(None, ["flag", "Class"], {"flag": 2, "Class": 3}) == ("Class", "flag")
    assert chosen(None, ["flag"], {"a": 1, "flag": 2}) == ("flag", "flag")
    assert chosen(None, [], {"a": 1}) == (None, None)
    assert chosen(None, ["label", "flag"], {"label": 5, "flag": 2}) == ("label", "flag")


def test_candidates_and_features(spark, lending):
    prof = pf.profile_columns(lending)
    cands = [r.col_name for r in rl.target_candidates(prof).orderBy("cand_ord").collect()]
    assert cands[0] == "default"
    feats = {r.col_name for r in rl.feature_columns(prof, "default", "issue_date").collect()}
    assert feats == {"grade", "fico_score", "annual_income", "home_ownership"}
    assert "loan_id" not in rl.categorical_driver_columns(prof, "default", "issue_date")
    tt = {r.col_name: r.task_type for r in rl.task_types(prof).collect()}
    assert tt["default"] == "binary_classification" and tt["grade"] == "multiclass_classification"


def test_id_name_rule():
    from insightframe.functions.columns import id_like_name
    assert id_like_name("customer_id") and id_like_name("id") and not id_like_name("paid")
    assert id_like_name("paid", strict_reference=True)


def test_value_shares_sum_to_one(spark, lending):
    v = pf.value_counts(lending, "grade").agg(F.sum("share")).first()[0]
    assert math.isclose(v, 1.0)
