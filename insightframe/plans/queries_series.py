"""Registered queries: outcome series, trend, forecast, backtest and rate/mix decomposition."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, t_quantile_090_sql
from ..operators import outcome as oc
from ..operators import rootcause as rc
from ..operators import series as sr
from . import basetables as bt
from .queries_outcome import LI_STAR_SQL
from .registry import iso, register

LI_SERIES_SQL = """
WITH base AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, COUNT(y) AS n,
             SUM(y)::DOUBLE AS positives, SUM(y)::DOUBLE / COUNT(y) AS rate
      FROM base WHERE l_shipdate IS NOT NULL AND y IS NOT NULL GROUP BY 1),
ti AS (SELECT *, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS t FROM s),
fit AS (SELECT regr_count(rate, t::DOUBLE) AS n_points, regr_slope(rate, t::DOUBLE) AS slope,
               regr_intercept(rate, t::DOUBLE) AS intercept, regr_sxx(rate, t::DOUBLE) AS sxx,
               regr_syy(rate, t::DOUBLE) AS syy, regr_sxy(rate, t::DOUBLE) AS sxy,
               AVG(t::DOUBLE) AS t_mean, MAX(period) AS last_period FROM ti),
fit2 AS (SELECT *, (syy - sxy * sxy / sxx) / (n_points - 2) AS s2 FROM fit),
fc AS (SELECT step, CAST(last_period + step * INTERVAL 1 MONTH AS DATE) AS period, n_points,
              intercept + slope * (n_points - 1 + step) AS point,
              sqrt(s2 * (1 + 1 / n_points + power(n_points - 1 + step - t_mean, 2) / sxx)) AS se,
              """ + t_quantile_090_sql("n_points - 2") + """ AS tq
       FROM fit2, range(1, 4) r(step) WHERE n_points >= 8),
fc2 AS (SELECT step, period, n_points, greatest(least(point, 1.0), 0.0) AS point,
               greatest(least(point - tq * se, 1.0), 0.0) AS lower,
               greatest(least(point + tq * se, 1.0), 0.0) AS upper FROM fc),
wf AS (SELECT t, period, rate,
              regr_intercept(rate, t::DOUBLE) OVER w + regr_slope(rate, t::DOUBLE) OVER w * t AS pred,
              lag(rate) OVER (ORDER BY t) AS naive, COUNT(*) OVER () AS n_points
       FROM ti WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wf2 AS (SELECT t, period, rate, pred, naive, abs(pred - rate) AS abs_err, abs(naive - rate) AS naive_err
        FROM wf WHERE n_points >= 8 AND t >= n_points - least(6, n_points // 3)),
bt AS (SELECT COUNT(*) AS n_backtest, AVG(abs_err) AS mae, AVG(naive_err) AS naive_mae,
              AVG(abs_err / greatest(abs(rate), 1e-9)) AS mape, AVG(abs_err) <= AVG(naive_err) AS beats_naive FROM wf2)
"""


def li_series(spark, sf_dir, seg=None):
    return sr.period_rates(bt.lineitem_events(spark, sf_dir), "l_shipdate", seg=seg)


@register("monthly_rate", oracle=LI_SERIES_SQL + """
SELECT strftime(period, '%Y-%m-%d') AS period, n, CAST(positives AS BIGINT) AS positives, ROUND(rate, 6) AS rate FROM s""")
def q_monthly_rate(spark, sf_dir):
    s = li_series(spark, sf_dir)
    return s.select(iso("period"), "n", F.col("positives").cast("bigint").alias("positives"),
                    rnd(F.col("rate")).alias("rate"))


@register("daily_rate", oracle="""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS period, COUNT(*) AS n, CAST(SUM(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS positives,
       ROUND(AVG(CAST(event_type = 'error' AS INTEGER)), 6) AS rate
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_daily_rate(spark, sf_dir):
    """A12 at daily grain: events span one month."""
    s = sr.period_rates(bt.events_errors(spark, sf_dir), "ts", grain="day")
    return s.select(iso("period"), "n", F.col("positives").cast("bigint").alias("positives"),
                    rnd(F.col("rate")).alias("rate"))


@register("trend_direction", oracle=LI_SERIES_SQL + """
SELECT COUNT(*) AS points, strftime(MIN(period), '%Y-%m-%d') AS first_period, strftime(MAX(period), '%Y-%m-%d') AS last_period,
       ROUND(arg_min(rate, period), 6) AS first_rate, ROUND(arg_max(rate, period), 6) AS last_rate,
       CASE WHEN arg_max(rate, period) > arg_min(rate, period) THEN 'rising' ELSE 'falling' END AS direction
FROM s HAVING COUNT(*) >= 3""")
def q_trend_direction(spark, sf_dir):
    d = sr.trend_direction(li_series(spark, sf_dir))
    return d.select("points", iso("first_period"), iso("last_period"), rnd(F.col("first_rate")).alias("first_rate"),
                    rnd(F.col("last_rate")).alias("last_rate"), "direction")


@register("trend_fit", oracle=LI_SERIES_SQL + """
SELECT n_points, ROUND(slope, 9) AS slope, ROUND(intercept, 6) AS intercept, ROUND(sxx, 4) AS sxx,
       ROUND(syy, 9) AS syy, ROUND(sxy, 6) AS sxy, ROUND(t_mean, 6) AS t_mean, strftime(last_period, '%Y-%m-%d') AS last_period,
       ROUND(s2, 12) AS s2 FROM fit2""")
def q_trend_fit(spark, sf_dir):
    f = sr.trend_fit(li_series(spark, sf_dir))
    return f.select("n_points", F.round("slope", 9).alias("slope"), rnd(F.col("intercept")).alias("intercept"),
                    F.round("sxx", 4).alias("sxx"), F.round("syy", 9).alias("syy"), rnd(F.col("sxy")).alias("sxy"),
                    rnd(F.col("t_mean")).alias("t_mean"), iso("last_period"), F.round("s2", 12).alias("s2"))


@register("forecast_monthly", oracle=LI_SERIES_SQL + """
SELECT CAST(step AS INTEGER) AS step, strftime(period, '%Y-%m-%d') AS period, n_points, ROUND(point, 6) AS point, ROUND(lower, 6) AS lower,
       ROUND(upper, 6) AS upper FROM fc2""")
def q_forecast_monthly(spark, sf_dir):
    f = sr.forecast(li_series(spark, sf_dir))
    return f.select("step", iso("period"), "n_points", rnd(F.col("point")).alias("point"),
                    rnd(F.col("lower")).alias("lower"), rnd(F.col("upper")).alias("upper"))


@register("walk_forward", oracle=LI_SERIES_SQL + """
SELECT t, strftime(period, '%Y-%m-%d') AS period, ROUND(rate, 6) AS rate, ROUND(pred, 6) AS pred, ROUND(naive, 6) AS naive,
       ROUND(abs_err, 6) AS abs_err, ROUND(naive_err, 6) AS naive_err FROM wf2""")
def q_walk_forward(spark, sf_dir):
    w = sr.walk_forward(li_series(spark, sf_dir))
    return w.select("t", iso("period"), *[rnd(F.col(c)).alias(c) for c in
                                     ("rate", "pred", "naive", "abs_err", "naive_err")])


@register("backtest_metrics", oracle=LI_SERIES_SQL + """
SELECT n_backtest, ROUND(mae, 6) AS mae, ROUND(naive_mae, 6) AS naive_mae, ROUND(mape, 6) AS mape,
       beats_naive FROM bt""")
def q_backtest_metrics(spark, sf_dir):
    m = sr.backtest_metrics(sr.walk_forward(li_series(spark, sf_dir)))
    return m.select("n_backtest", rnd(F.col("mae")).alias("mae"), rnd(F.col("naive_mae")).alias("naive_mae"),
                    rnd(F.col("mape")).alias("mape"), "beats_naive")


@register("projections", oracle=LI_SERIES_SQL + """
SELECT 'l_returnflag_R rate' AS metric, CAST(step AS INTEGER) AS step, strftime(period, '%b %Y') AS horizon,
  ROUND(point, 4) AS point, ROUND(lower, 4) AS lower, ROUND(upper, 4) AS upper,
  ROUND(mae, 4) AS bt_mae, ROUND(mape, 4) AS bt_mape, ROUND(naive_mae, 4) AS bt_naive_mae, beats_naive,
  'OLS linear trend; 80% prediction interval; walk-forward backtest' AS method,
  'Linear-trend baseline: no seasonality or regime-change modeling. | Short history (' || n_points ||
  ' months) -> intervals are wide and uncertain. | Recent months may be right-censored (immature outcomes), biasing the trend.'
  || CASE WHEN beats_naive THEN '' ELSE ' | Model does NOT beat a naive last-value forecast — treat as low-value.' END AS caveats
FROM fc2, bt""")
def q_projections(spark, sf_dir):
    s = li_series(spark, sf_dir)
    p = sr.projections(sr.forecast(s), sr.backtest_metrics(sr.walk_forward(s)), "l_returnflag_R rate")
    return p.select("metric", "step", "horizon", "point", "lower", "upper",
                    F.col("backtest_error.MAE").alias("bt_mae"), F.col("backtest_error.MAPE").alias("bt_mape"),
                    F.col("backtest_error.naive_MAE").alias("bt_naive_mae"),
                    F.col("backtest_error.beats_naive").alias("beats_naive"), "method",
                    F.array_join("caveats", " | ").alias("caveats"))


@register("chart_forecast", oracle=LI_SERIES_SQL + """
SELECT 'history' AS series, t AS ord, strftime(period, '%Y-%m-%d') AS x, ROUND(rate * 100, 2) AS y FROM ti
UNION ALL SELECT 'forecast', CAST(step - 1 AS INTEGER), strftime(period, '%Y-%m-%d'), ROUND(point * 100, 2) FROM fc2
UNION ALL SELECT 'lower', CAST(step - 1 AS INTEGER), strftime(period, '%Y-%m-%d'), ROUND(lower * 100, 2) FROM fc2
UNION ALL SELECT 'upper', CAST(step - 1 AS INTEGER), strftime(period, '%Y-%m-%d'), ROUND(upper * 100, 2) FROM fc2""")
def q_chart_forecast(spark, sf_dir):
    s = li_series(spark, sf_dir)
    return sr.chart_forecast(s, sr.forecast(s))


_SEG_SERIES_SQL = """
WITH base AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
s AS (SELECT l_linenumber, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, COUNT(y) AS n,
             SUM(y)::DOUBLE / COUNT(y) AS rate
      FROM base WHERE l_shipdate IS NOT NULL AND y IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2),
ti AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY period) - 1 AS t FROM s),
fit AS (SELECT l_linenumber, regr_count(rate, t::DOUBLE) AS n_points, regr_slope(rate, t::DOUBLE) AS slope,
               regr_intercept(rate, t::DOUBLE) AS intercept, regr_sxx(rate, t::DOUBLE) AS sxx,
               regr_syy(rate, t::DOUBLE) AS syy, regr_sxy(rate, t::DOUBLE) AS sxy,
               AVG(t::DOUBLE) AS t_mean, MAX(period) AS last_period FROM ti GROUP BY 1),
fc AS (SELECT l_linenumber, step, CAST(last_period + step * INTERVAL 1 MONTH AS DATE) AS period, n_points,
              intercept + slope * (n_points - 1 + step) AS point,
              sqrt((syy - sxy * sxy / sxx) / (n_points - 2) * (1 + 1 / n_points + power(n_points - 1 + step - t_mean, 2) / sxx)) AS se,
              """ + t_quantile_090_sql("n_points - 2") + """ AS tq
       FROM fit, range(1, 4) r(step) WHERE n_points >= 8)
SELECT l_linenumber, CAST(step AS INTEGER) AS step, strftime(period, '%Y-%m-%d') AS period, n_points,
       ROUND(greatest(least(point, 1.0), 0.0), 6) AS point,
       ROUND(greatest(least(point - tq * se, 1.0), 0.0), 6) AS lower,
       ROUND(greatest(least(point + tq * se, 1.0), 0.0), 6) AS upper FROM fc"""


@register("forecast_by_segment", oracle=_SEG_SERIES_SQL)
def q_forecast_by_segment(spark, sf_dir):
    """One forecast per line number, all segments in the same window passes."""
    f = sr.forecast(li_series(spark, sf_dir, ["l_linenumber"]), ["l_linenumber"])
    return f.select("l_linenumber", "step", iso("period"), "n_points", rnd(F.col("point")).alias("point"),
                    rnd(F.col("lower")).alias("lower"), rnd(F.col("upper")).alias("upper"))


# ---- root cause ------------------------------------------------------------------------
# Region with NULLs injected (every 13th order) so the residual interaction carries them.
RM_BASE_SQL = f"""SELECT l_shipdate, y, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE r_name END AS r_name,
  o_orderpriority FROM ({LI_STAR_SQL})"""


def rm_base(spark, sf_dir):
    b = bt.lineitem_star(spark, sf_dir)
    return b.withColumn("r_name", F.when(F.col("l_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("r_name")))


def _rm_sql(seg: str) -> str:
    return f"""
WITH base AS ({RM_BASE_SQL}),
b2 AS (SELECT * FROM base WHERE l_shipdate IS NOT NULL AND y IS NOT NULL),
cut AS (SELECT quantile_cont(epoch_us(l_shipdate)::DOUBLE, 0.5) AS c FROM b2),
p AS (SELECT b2.*, CASE WHEN epoch_us(l_shipdate)::DOUBLE <= cut.c THEN 'a' ELSE 'b' END AS period FROM b2, cut),
tot AS (SELECT COUNT(*) FILTER (WHERE period = 'a') AS n_a, COUNT(*) FILTER (WHERE period = 'b') AS n_b,
               SUM(y) FILTER (WHERE period = 'a')::DOUBLE AS pos_a, SUM(y) FILTER (WHERE period = 'b')::DOUBLE AS pos_b FROM p),
sg AS (SELECT CAST({seg} AS VARCHAR) AS segment,
              COUNT(*) FILTER (WHERE period = 'a') AS n_a, SUM(y) FILTER (WHERE period = 'a')::DOUBLE AS pos_a,
              COUNT(*) FILTER (WHERE period = 'b') AS n_b, SUM(y) FILTER (WHERE period = 'b')::DOUBLE AS pos_b
       FROM p WHERE {seg} IS NOT NULL GROUP BY 1),
ws AS (SELECT SUM(n_a) AS na, SUM(n_b) AS nb FROM sg),
c AS (SELECT sg.*, n_a::DOUBLE / na AS wa, n_b::DOUBLE / nb AS wb,
             CASE WHEN n_a > 0 THEN pos_a / n_a END AS ra, CASE WHEN n_b > 0 THEN pos_b / n_b END AS rb,
             n_a > 0 AND n_b > 0 AS in_both FROM sg, ws),
c2 AS (SELECT *, CASE WHEN in_both THEN wa * (rb - ra) END AS rate_part,
              CASE WHEN in_both THEN (wb - wa) * ra END AS mix_part FROM c),
c3 AS (SELECT *, rate_part + mix_part AS contribution,
              CASE WHEN in_both THEN CAST(row_number() OVER (ORDER BY abs(rate_part + mix_part) DESC NULLS LAST, segment) AS INTEGER) END AS contrib_rank FROM c2),
summ AS (SELECT '{seg}' AS segment_col, tot.n_a, tot.n_b, tot.pos_a / tot.n_a AS rate_a, tot.pos_b / tot.n_b AS rate_b,
                tot.pos_b / tot.n_b - tot.pos_a / tot.n_a AS delta,
                COALESCE((SELECT SUM(rate_part) FROM c3), 0) AS rate_effect,
                COALESCE((SELECT SUM(mix_part) FROM c3), 0) AS mix_effect,
                (SELECT MAX(segment) FROM c3 WHERE contrib_rank = 1) AS top_segment,
                COALESCE((SELECT SUM(n_a + n_b) FILTER (WHERE NOT in_both) FROM c3), 0)::DOUBLE / (tot.n_a + tot.n_b) AS unmatched_share
         FROM tot WHERE tot.n_a >= 30 AND tot.n_b >= 30)
"""


_RM_SUMMARY_SELECT = """
SELECT segment_col, n_a, n_b, ROUND(rate_a, 6) AS rate_a, ROUND(rate_b, 6) AS rate_b, ROUND(delta, 6) AS delta,
       ROUND(rate_effect, 6) AS rate_effect, ROUND(mix_effect, 6) AS mix_effect,
       ROUND(delta - rate_effect - mix_effect, 6) AS interaction,
       CASE WHEN abs(rate_effect) >= abs(mix_effect) THEN 'rate' ELSE 'mix' END AS dominant, top_segment,
       ROUND(unmatched_share, 6) AS unmatched_share FROM summ"""


def _rm_out(summary):
    return summary.select("segment_col", "n_a", "n_b", *[rnd(F.col(c)).alias(c) for c in
                          ("rate_a", "rate_b", "delta", "rate_effect", "mix_effect", "interaction")],
                          "dominant", "top_segment", rnd(F.col("unmatched_share")).alias("unmatched_share"))


def li_star_mix(spark, sf_dir, seg):
    """Rate/mix of returns by an order's attribute: lines are reduced to orders before the join."""
    # every 13th order without a region, so that a NULL segment takes part
    dims = bt.order_dims(spark, sf_dir).withColumn("r_name", F.when(F.col("o_orderkey") % 13 != 0, F.col("r_name")))
    return rc.star_rate_mix(bt.lineitem_events(spark, sf_dir), "l_orderkey", dims, "o_orderkey", "l_shipdate", seg)


@register("rate_mix", oracle=_rm_sql("r_name") + _RM_SUMMARY_SELECT)
def q_rate_mix(spark, sf_dir):
    """Returns rate change decomposed by region, recent vs historical half."""
    summary, _ = li_star_mix(spark, sf_dir, "r_name")
    return _rm_out(summary)


@register("rate_mix_contrib", oracle=_rm_sql("r_name") + """
SELECT segment, n_a, n_b, ROUND(wa, 6) AS wa, ROUND(wb, 6) AS wb, ROUND(ra, 6) AS ra, ROUND(rb, 6) AS rb,
       ROUND(contribution, 6) AS contribution, contrib_rank FROM c3""")
def q_rate_mix_contrib(spark, sf_dir):
    _, contrib = li_star_mix(spark, sf_dir, "r_name")
    return contrib.select("segment", "n_a", "n_b", *[rnd(F.col(c)).alias(c) for c in
                          ("wa", "wb", "ra", "rb", "contribution")], "contrib_rank")


@register("median_split", oracle=_rm_sql("r_name") + """
SELECT CAST(floor((SELECT c FROM cut)) AS BIGINT) AS cutoff_us, n_a, n_b FROM tot""")
def q_median_split(spark, sf_dir):
    """The time median (epoch microseconds) and the two period sizes."""
    base = rm_base(spark, sf_dir).where(F.col("l_shipdate").isNotNull() & F.col("y").isNotNull())
    cut = rc.median_cutoff(base, "l_shipdate")
    p = rc.with_period(base, "l_shipdate", cut)
    return p.agg(F.floor(F.first(cut)).cast("bigint").alias("cutoff_us"),
                 F.count_if(F.col("period") == "a").alias("n_a"),
                 F.count_if(F.col("period") == "b").alias("n_b"))


RM_CANDIDATES = ["l_linestatus", "c_mktsegment", "r_name", "o_orderpriority"]


@register("rate_mix_best", oracle=f"""
WITH base0 AS ({RM_BASE_SQL.replace('o_orderpriority FROM', 'o_orderpriority, l_linestatus, c_mktsegment FROM')}),
b AS (SELECT * FROM base0 WHERE l_shipdate IS NOT NULL AND y IS NOT NULL),
seg AS (SELECT col_name, col_ord, value, COUNT(y) AS n, SUM(y)::DOUBLE / COUNT(y) AS rate FROM (
  SELECT 'l_linestatus' AS col_name, 0 AS col_ord, CAST(l_linestatus AS VARCHAR) AS value, y FROM b
  UNION ALL SELECT 'c_mktsegment', 1, c_mktsegment, y FROM b
  UNION ALL SELECT 'r_name', 2, r_name, y FROM b
  UNION ALL SELECT 'o_orderpriority', 3, o_orderpriority, y FROM b) WHERE value IS NOT NULL
  GROUP BY 1, 2, 3 HAVING COUNT(y) >= 30),
per AS (SELECT col_name, col_ord, MAX(rate) - MIN(rate) AS spread FROM seg GROUP BY 1, 2 HAVING COUNT(*) >= 2 AND MAX(rate) - MIN(rate) > 0)
SELECT col_name AS segment_col, ROUND(spread, 6) AS spread FROM per ORDER BY spread DESC, col_ord LIMIT 1""")
def q_rate_mix_best(spark, sf_dir):
    """Segmentation column chosen for root cause (strict positive spread, time excluded)."""
    b = rm_base(spark, sf_dir).where(F.col("l_shipdate").isNotNull() & F.col("y").isNotNull())
    d = oc.categorical_drivers(oc.segment_rates_all(b, RM_CANDIDATES), require_positive_spread=True)
    return d.where("driver_rank = 1").select(F.col("col_name").alias("segment_col"),
                                             rnd(F.col("spread")).alias("spread"))


@register("rate_mix_joined", oracle=_rm_sql("o_orderpriority") + """
SELECT ROUND(SUM(wa * (rb - ra)), 6) AS rate_effect, ROUND(SUM((wb - wa) * ra), 6) AS mix_effect,
       COUNT(*) AS n_segments FROM c WHERE in_both""")
def q_rate_mix_joined(spark, sf_dir):
    """The per-period segment tables inner-joined; must equal the conditional aggregate."""
    j = rc.rate_mix_joined(rm_base(spark, sf_dir), "l_shipdate", "o_orderpriority")
    return j.select(rnd(F.col("rate_effect")).alias("rate_effect"), rnd(F.col("mix_effect")).alias("mix_effect"),
                    "n_segments")


@register("segment_intersect", oracle=_rm_sql("r_name") + """
SELECT segment FROM sg WHERE n_a > 0 AND n_b > 0""")
def q_segment_intersect(spark, sf_dir):
    return rc.segment_intersect(rm_base(spark, sf_dir), "l_shipdate", "r_name")


# trend + month effects: the normal equations of all line statuss and origins, centred inside months
SEASONAL_SQL = """
WITH s AS (SELECT l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, AVG(CAST(l_returnflag = 'R' AS DOUBLE)) AS rate
           FROM lineitem WHERE l_shipdate IS NOT NULL AND l_linestatus IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1, 2),
ti AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_linestatus ORDER BY period) - 1 AS INTEGER) AS t, month(period) AS season,
              COUNT(*) OVER (PARTITION BY l_linestatus) AS n_points FROM s),
i AS (SELECT * FROM ti WHERE n_points >= 24),
o AS (SELECT i.*, r.origin FROM i, range(18, 400) r(origin) WHERE r.origin > t AND r.origin <= n_points
        AND r.origin >= n_points - least(6, n_points // 3)),
m AS (SELECT l_linestatus, origin, season, AVG(t) AS tm, AVG(rate) AS ym, COUNT(*) AS k, MAX(period) AS last FROM o GROUP BY ALL),
f AS (SELECT l_linestatus, origin, SUM((t - tm) * (t - tm)) AS xx, SUM((t - tm) * (rate - ym)) AS xy, SUM((rate - ym) * (rate - ym)) AS yy,
             COUNT(*) - COUNT(DISTINCT season) - 1 AS dof, MAX(period) AS last_period FROM o JOIN m USING (l_linestatus, origin, season) GROUP BY ALL),
wf AS (SELECT l_linestatus, t, period, rate, ym + xy / xx * (t - tm) AS pred FROM i JOIN m USING (l_linestatus, season) JOIN f USING (l_linestatus, origin) WHERE origin = t),
lin AS (SELECT l_linestatus, t, lag(rate) OVER (PARTITION BY l_linestatus ORDER BY t) AS naive,
               regr_intercept(rate, t::DOUBLE) OVER w + regr_slope(rate, t::DOUBLE) OVER w * t AS linear
        FROM ti WINDOW w AS (PARTITION BY l_linestatus ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@register("forecast_seasonal", oracle=SEASONAL_SQL + """
, p AS (SELECT l_linestatus, step, CAST(last_period + step * INTERVAL 1 MONTH AS DATE) AS period, origin AS n_points, season, k, dof, tm,
             ym + xy / xx * (origin - 1 + step - tm) AS point,
             """ + t_quantile_090_sql("dof") + """ * sqrt(greatest(yy - xy * xy / xx, 0) / dof * (1 + 1.0 / k + power(origin - 1 + step - tm, 2) / xx)) AS half
      FROM f JOIN m USING (l_linestatus, origin), range(1, 13) r(step)
      WHERE origin = (SELECT MAX(n_points) FROM i WHERE i.l_linestatus = f.l_linestatus) AND dof > 0)
SELECT l_linestatus, CAST(step AS INTEGER) AS step, strftime(period, '%Y-%m-%d') AS period, CAST(n_points AS INTEGER) AS n_points,
       ROUND(least(greatest(point, 0), 1), 6) AS point, ROUND(least(greatest(point - half, 0), 1), 6) AS lower,
       ROUND(least(greatest(point + half, 0), 1), 6) AS upper
FROM p WHERE month(period) = season""")
def q_forecast_seasonal(spark, sf_dir):
    """A year ahead per line status, trend plus month effects, with the 80% interval."""
    f = sr.forecast_seasonal(li_series(spark, sf_dir, ["l_linestatus"]), ["l_linestatus"])
    return f.select("l_linestatus", "step", iso("period"), "n_points", *[rnd(F.col(c)).alias(c) for c in ("point", "lower", "upper")])


@register("seasonal_backtest", oracle=SEASONAL_SQL + """
SELECT l_linestatus, COUNT(*) AS n_backtest, ROUND(AVG(abs(pred - rate)), 6) AS mae, ROUND(AVG(abs(linear - rate)), 6) AS linear_mae,
       ROUND(AVG(abs(naive - rate)), 6) AS naive_mae, AVG(abs(pred - rate)) <= AVG(abs(linear - rate)) AS beats_linear
FROM wf JOIN lin USING (l_linestatus, t) GROUP BY l_linestatus""")
def q_seasonal_backtest(spark, sf_dir):
    """Walk-forward error of the seasonal fit beside the linear fit's and the last value's."""
    m = sr.seasonal_metrics(sr.walk_forward_seasonal(li_series(spark, sf_dir, ["l_linestatus"]), ["l_linestatus"]), ["l_linestatus"])
    return m.select("l_linestatus", "n_backtest", *[rnd(F.col(c)).alias(c) for c in ("mae", "linear_mae", "naive_mae")], "beats_linear")
