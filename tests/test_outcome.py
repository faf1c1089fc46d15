"""Outcome rate, segments and drivers (A1-A11) on planted and literal fixtures."""
from pyspark.sql import functions as F

from insightframe.operators import outcome as oc


def _planted(spark):
    # seg 'a' rate 0.2 (n=50), 'b' rate 0.6 (n=50), 'c' n=10 (below the minimum group), NULL seg (n=40)
    rows = []
    for i in range(50):
        rows.append(("a", "x", i % 5 == 0, float(i)))
    for i in range(50):
        rows.append(("b", "y", i % 5 < 3, float(i)))
    for i in range(10):
        rows.append(("c", "x", True, float(i)))
    for i in range(40):
        rows.append((None, "y", i % 2 == 0, float(i)))
    return spark.createDataFrame(rows, "seg string, other string, yb boolean, num double") \
        .withColumn("y", F.col("yb").cast("int"))


def test_segment_rates_drop_null_and_small_groups(spark):
    s = {r.value: (r.n, round(r.rate, 4)) for r in oc.segment_rates(_planted(spark), "seg").collect()}
    assert s == {"a": (50, 0.2), "b": (50, 0.6)}


def test_strongest_driver_and_tie_rule(spark):
    df = _planted(spark)
    segs = oc.segment_rates_all(df, ["other", "seg"])
    d = {r.col_name: r for r in oc.categorical_drivers(segs).collect()}
    assert d["seg"].driver_rank == 1 and abs(d["seg"].spread - 0.4) < 1e-12
    # equal spreads: the earlier column wins
    df2 = df.withColumn("seg2", F.col("seg"))
    d2 = {r.col_name: r.driver_rank for r in oc.categorical_drivers(oc.segment_rates_all(df2, ["seg2", "seg"])).collect()}
    assert d2["seg2"] == 1 and d2["seg"] == 2


def test_grouping_sets_equals_unpivot(spark):
    df = _planted(spark)
    a = sorted(oc.segment_rates_all(df, ["seg", "other"]).collect())
    b = sorted(oc.segment_rates_grouping_sets(df, ["seg", "other"]).collect())
    assert a == b


def test_confidence_tier_boundaries(spark):
    df = spark.createDataFrame([(29,), (30,), (499,), (500,)], "n int")
    got = [r.confidence for r in oc.with_confidence(df).orderBy("n").collect()]
    assert got == ["low", "medium", "medium", "high"]


def test_overall_rate_and_imbalance(spark):
    df = spark.range(1000).select((F.col("id") < 30).cast("int").alias("y"))
    r = oc.overall_rate(df).first()
    assert (r.n, r.positives, r.imbalanced, r.confidence) == (1000, 30, True, "high")


def test_numeric_drivers_constant_column_and_pairwise_nulls(spark):
    import numpy as np
    rows = [(float(i % 7), 1.0, None if i % 10 == 0 else float(i), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, const double, b double, y int")
    got = {r.col_name: r.r for r in oc.numeric_drivers(df, ["a", "const", "b"]).collect()}
    assert "const" not in got  # constant column dropped, no divide-by-zero error
    ys = np.array([r[3] for r in rows], float)
    bs = np.array([np.nan if r[2] is None else r[2] for r in rows])
    m = ~np.isnan(bs)
    assert abs(got["b"] - np.corrcoef(bs[m], ys[m])[0, 1]) < 1e-9


def test_star_plan_equals_flat_join(spark):
    fact = spark.createDataFrame([(k % 40, k % 3, int(k % 4 == 0)) for k in range(400)], "ok long, f int, y int")
    dim = spark.createDataFrame([(k, "g" + str(k % 2)) for k in range(40)], "dk long, g string")
    star = oc.star_segment_rates(fact, "ok", ["f"], dim, "dk", ["g"], min_n=1)
    flat = oc.segment_rates_all(fact.join(dim, F.col("ok") == F.col("dk")), ["f", "g"], min_n=1)
    assert sorted(star.collect()) == sorted(flat.collect())


def test_planted_lending_driver(lending):
    from insightframe.functions.columns import MIN_GROUP
    segs = oc.segment_rates_all(lending, ["grade", "home_ownership"], y="default", min_n=MIN_GROUP)
    d = oc.categorical_drivers(segs).where("driver_rank = 1").first()
    assert d.col_name == "grade" and d.top_value == "E"


def test_number_text_rounds_like_python(spark):
    from insightframe.functions.columns import fixed, pct_text, signed_pct_text
    vals = [0.3125, 0.125, 0.02675, -0.0001, 0.0, 0.99995, 12.345]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(pct_text(F.col("x"), 1).alias("p"), signed_pct_text(F.col("x"), 1).alias("s"),
                    fixed(F.col("x"), 2).alias("f")).collect()
    for v, r in zip(vals, got):
        assert (r.p, r.s, r.f) == (f"{v:.1%}", f"{v:+.1%}", f"{v:.2f}"), v


def test_star_pair_rates_equal_flat_join(spark):
    from insightframe.operators import adhoc as ah
    fact = spark.createDataFrame(
        [(k % 50, "s" + str(k % 2), None if k % 37 == 0 else int(k % 3 == 0), float(k % 11)) for k in range(600)]
        + [(999, "s0", 1, 5.0)],                       # orphan: no dimension row
        "ok long, f string, y int, amt double")
    dim = spark.createDataFrame([(k, None if k % 17 == 0 else "g" + str(k % 3)) for k in range(50)], "dk long, g string")
    star = ah.star_segment_pair_rates(fact, "ok", dim, "dk", "g", "f", amount="amt")
    flat = ah.segment_pair_rates(fact.join(dim, F.col("ok") == F.col("dk")), "g", "f", amount="amt")
    cols = ["g", "f", "positives", "n", "value_weighted_rate", "rate", "overall_rate", "lift"]
    a = sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in star.select(*cols).collect())
    b = sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in flat.select(*cols).collect())
    assert a == b
