"""Trend, forecast, backtest (W*) and rate/mix (A14-A16) against closed forms and invariants."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from insightframe.operators import rootcause as rc
from insightframe.operators import series as sr


def _series(spark, ys, start=dt.date(2020, 1, 1), gap_at=None):
    rows, m = [], 0
    for i, y in enumerate(ys):
        if gap_at is not None and i == gap_at:
            m += 1  # one empty month
        d = dt.date(start.year + (start.month - 1 + m) // 12, (start.month - 1 + m) % 12 + 1, 1)
        rows.append((d, 100, y * 100, y))
        m += 1
    return spark.createDataFrame(rows, "period date, n long, positives double, rate double")


def test_forecast_matches_closed_form(spark):
    ys = [0.20, 0.22, 0.21, 0.25, 0.24, 0.27, 0.26, 0.30, 0.29, 0.31]
    s = _series(spark, ys)
    fc = sr.forecast(s, clip=False).orderBy("step").collect()
    n = len(ys)
    t = np.arange(n)
    slope, icpt = np.polyfit(t, ys, 1)
    resid = np.array(ys) - (icpt + slope * t)
    s2 = (resid ** 2).sum() / (n - 2)
    sxx = ((t - t.mean()) ** 2).sum()
    tq = 1.396815  # Student t 0.9 quantile, 8 degrees of freedom
    for k, row in enumerate(fc, start=1):
        t0 = n - 1 + k
        point = icpt + slope * t0
        half = tq * np.sqrt(s2 * (1 + 1 / n + (t0 - t.mean()) ** 2 / sxx))
        assert abs(row.point - point) < 1e-9
        assert abs((row.upper - row.point) - half) < 1e-5 * half
        assert row.lower <= row.point <= row.upper
    assert fc[0].period == dt.date(2020, 11, 1)


def test_min_history_and_gap_index(spark):
    assert sr.forecast(_series(spark, [0.1] * 7)).count() == 0        # < 8 points: skipped
    s = _series(spark, [0.1 * i for i in range(9)], gap_at=4)         # gaps are not counted in t
    assert [r.t for r in sr.with_time_index(s).orderBy("period").collect()] == list(range(9))


def test_walk_forward_equals_refit_loop(spark):
    ys = [0.2, 0.25, 0.22, 0.3, 0.28, 0.35, 0.31, 0.4, 0.38, 0.45, 0.41, 0.5]
    wf = sr.walk_forward(_series(spark, ys)).orderBy("t").collect()
    n_bt = min(6, len(ys) // 3)
    assert [r.t for r in wf] == list(range(len(ys) - n_bt, len(ys)))
    for r in wf:
        i = r.t
        sl, ic = np.polyfit(np.arange(i), ys[:i], 1)
        assert abs(r.pred - (ic + sl * i)) < 1e-9
        assert abs(r.naive - ys[i - 1]) < 1e-12
    m = sr.backtest_metrics(sr.walk_forward(_series(spark, ys))).first()
    assert m.beats_naive == (m.mae <= m.naive_mae) and m.n_backtest == n_bt


def test_trend_direction_equal_is_falling(spark):
    d = sr.trend_direction(_series(spark, [0.3, 0.1, 0.3])).first()
    assert d.direction == "falling" and d.points == 3
    assert sr.trend_direction(_series(spark, [0.3, 0.1])).count() == 0


def test_rate_mix_identity_and_hand_values(spark):
    rows = []
    # historical half (2020): X 100 rows @ .1, Y 100 rows @ .5, plus one NULL-segment event;
    # recent half (2021): X 50 @ .3, Y 150 @ .5. 401 rows: the median is the last 2020 row.
    def add(year, seg, n, rate):
        for i in range(n):
            rows.append((dt.datetime(year, 1 + i % 12, 1), seg, int(i < rate * n)))
    add(2020, "X", 100, 0.1)
    add(2020, "Y", 100, 0.5)
    rows.append((dt.datetime(2020, 6, 1), None, 1))       # NULL segment: only in the residual
    add(2021, "X", 50, 0.3)
    add(2021, "Y", 150, 0.5)
    df = spark.createDataFrame(rows, "ts timestamp, seg string, y int")
    s, contrib = rc.rate_mix(df, "ts", "seg")
    r = s.first()
    assert (r.n_a, r.n_b) == (201, 200)
    assert abs(r.rate_effect + r.mix_effect + r.interaction - r.delta) < 1e-12
    assert abs(r.rate_effect - 0.5 * 0.2) < 1e-12            # wa(X)=.5, rb-ra=.2 for X, 0 for Y
    assert abs(r.mix_effect - ((50 / 200 - 0.5) * 0.1 + (150 / 200 - 0.5) * 0.5)) < 1e-12
    assert abs(r.delta - (90 / 200 - 61 / 201)) < 1e-12             # (15 + 75) recent events
    assert r.top_segment == "Y"                               # contributions .075 (X) vs .125 (Y)
    j = rc.rate_mix_joined(df, "ts", "seg").first()
    assert abs(j.rate_effect - r.rate_effect) < 1e-12 and abs(j.mix_effect - r.mix_effect) < 1e-12


def test_rate_mix_over_a_star_equals_the_flat_join(spark):
    fact = spark.range(3000).select((F.col("id") % 400).alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"),
                                    (F.pmod(F.xxhash64("id"), F.lit(10)) < 3 + F.col("id") % 3).cast("int").alias("y"))
    dim = spark.range(400).select(F.col("id").alias("d"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("seg"))
    flat = rc.rate_mix(fact.join(dim, F.col("k") == F.col("d")), "ts", "seg")
    star = rc.star_rate_mix(fact, "k", dim, "d", "ts", "seg")

    def rounded(df):  # sums of doubles in any order
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)

    assert rounded(star[0]) == rounded(flat[0]) and len(rounded(star[0])) == 1
    assert rounded(star[1]) == rounded(flat[1]) and len(rounded(star[1])) == 4


def test_chart_forecast_rows(spark):
    s = _series(spark, [0.1 + 0.01 * i for i in range(10)])
    c = sr.chart_forecast(s, sr.forecast(s))
    got = {r.series: r.n for r in c.groupBy("series").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"history": 10, "forecast": 3, "lower": 3, "upper": 3}


def _plain_seasonal(ys, months, t0, m0):
    """Least squares on a trend and one column per month; (point, half width without t, dof)."""
    seen = sorted(set(months))
    x = np.array([[float(i)] + [float(m == s) for s in seen] for i, m in enumerate(months)])
    beta, *_ = np.linalg.lstsq(x, np.array(ys), rcond=None)
    resid = np.array(ys) - x @ beta
    dof = len(ys) - x.shape[1]
    at = np.array([float(t0)] + [float(m0 == s) for s in seen])
    se = np.sqrt(resid @ resid / dof * (1 + at @ np.linalg.inv(x.T @ x) @ at))
    return float(at @ beta), float(se), dof


def test_seasonal_forecast_matches_least_squares(spark):
    r = np.random.default_rng(4)
    parts, series = {}, []
    for name, n, start in (("a", 40, dt.date(2018, 3, 1)), ("b", 31, dt.date(2019, 1, 1)), ("short", 23, dt.date(2019, 1, 1))):
        ys = [0.2 + 0.004 * i + 0.05 * np.sin((start.month + i) / 2) + r.normal(0, 0.01) for i in range(n)]
        part = _series(spark, [float(y) for y in ys], start).withColumn("seg", F.lit(name))
        parts[name] = (ys, [(start.month - 1 + i) % 12 + 1 for i in range(n)])
        series.append(part)
    both = series[0].unionByName(series[1]).unionByName(series[2])
    got = sr.forecast_seasonal(both, ["seg"], horizon=14, clip=False).collect()
    assert {x.seg for x in got} == {"a", "b"} and len(got) == 28  # under two seasons: refused
    for x in got:
        ys, months = parts[x.seg]
        t0 = len(ys) - 1 + x.step
        point, se, dof = _plain_seasonal(ys, months, t0, (months[0] - 1 + t0) % 12 + 1)
        assert x.period.month == (months[0] - 1 + t0) % 12 + 1
        assert abs(x.point - point) < 1e-9
        tq = spark.range(1).select(sr.t_quantile_090(F.lit(dof))).first()[0]
        assert abs((x.upper - x.point) - tq * se) < 1e-9
    wf = {(x.seg, x.t): x for x in sr.walk_forward_seasonal(both, ["seg"]).collect()}
    assert set(wf) == {(s, len(parts[s][0]) - 1 - k) for s in "ab" for k in range(6)}
    for (s, t), x in wf.items():
        ys, months = parts[s]
        assert abs(x.pred - _plain_seasonal(ys[:t], months[:t], t, months[t])[0]) < 1e-9
        assert abs(x.naive - ys[t - 1]) < 1e-12
    m = {x.seg: x for x in sr.seasonal_metrics(sr.walk_forward_seasonal(both, ["seg"]), ["seg"]).collect()}
    assert m["a"].n_backtest == 6 and m["a"].beats_linear and m["a"].mae < m["a"].linear_mae


def test_seasonal_forecast_of_gaps_and_nothing(spark):
    ys = [0.1 + 0.01 * (i % 12) for i in range(30)]
    s = _series(spark, ys, gap_at=20)
    got = sr.forecast_seasonal(s).collect()
    assert len(got) == 12 and all(0 <= x.lower <= x.upper <= 1 for x in got)
    assert sr.forecast_seasonal(s.where("rate > 9")).count() == 0
    assert sr.walk_forward_seasonal(s.where("rate > 9")).count() == 0
