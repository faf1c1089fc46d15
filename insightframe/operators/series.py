"""Outcome series, trend, forecast and walk-forward backtest.

The raw table is touched once: a partial-aggregated group-by to (segment, period). Every
later step works on the aggregated series (periods x segments rows), so windows that order
a whole series stay small. All steps take an optional list of segment columns and then run
PARTITION BY segment, which gives per-segment forecasts (W9) in the same passes.

OLS uses the regr_* aggregates; the walk-forward backtest refits on every prefix with one
expanding window (ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) instead of a loop.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import (BACKTEST_MAX_POINTS, FORECAST_HORIZON, FORECAST_MIN_POINTS,
                                 clip01, t_quantile_090)


def _period(ts: Column, grain: str) -> Column:
    if grain == "month":
        return F.trunc(ts, "MM")
    if grain == "day":
        return F.to_date(ts)
    if grain == "week":
        return F.to_date(F.date_trunc("week", ts))
    if grain == "year":
        return F.trunc(ts, "year")
    raise ValueError(f"unknown grain {grain}")


def period_rates(df: DataFrame, time_col: str, y: str = "y", grain: str = "month",
                 seg: list[str] | None = None) -> DataFrame:
    """(seg.., period DATE, n, positives, rate) for non-empty periods only.

    Rows with a NULL time or NULL target are dropped (P8).
    """
    seg = seg or []
    base = df.where(F.col(time_col).isNotNull() & F.col(y).isNotNull())
    for s in seg:
        base = base.where(F.col(s).isNotNull())
    return (base.groupBy(*seg, _period(F.col(time_col), grain).alias("period"))
            .agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("positives"))
            .withColumn("rate", F.col("positives") / F.col("n")))


def with_time_index(series: DataFrame, seg: list[str] | None = None) -> DataFrame:
    """t = 0..n-1 over observed periods per segment (gaps are not counted)."""
    seg = seg or []
    w = Window.partitionBy(*seg).orderBy("period")
    return series.withColumn("t", (F.row_number().over(w) - 1).cast("int"))


def trend_direction(series: DataFrame, seg: list[str] | None = None, min_points: int = 3) -> DataFrame:
    """first/last rate, points and direction (rising iff last > first)."""
    seg = seg or []
    g = series.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.min_by("rate", "period").alias("first_rate"), F.max_by("rate", "period").alias("last_rate"))
    return g.where(F.col("points") >= min_points).withColumn(
        "direction", F.when(F.col("last_rate") > F.col("first_rate"), F.lit("rising"))
        .otherwise(F.lit("falling")))


def trend_fit(series: DataFrame, seg: list[str] | None = None) -> DataFrame:
    """OLS of rate on t per segment, with the pieces the interval needs."""
    seg = seg or []
    s = with_time_index(series, seg)
    y, t = F.col("rate"), F.col("t").cast("double")
    fit = s.groupBy(*seg).agg(
        F.regr_count(y, t).alias("n_points"), F.regr_slope(y, t).alias("slope"),
        F.regr_intercept(y, t).alias("intercept"), F.regr_sxx(y, t).alias("sxx"),
        F.regr_syy(y, t).alias("syy"), F.regr_sxy(y, t).alias("sxy"),
        F.avg(t).alias("t_mean"), F.max("period").alias("last_period"))
    resid = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return fit.withColumn("s2", F.try_divide(resid, (F.col("n_points") - 2).cast("double")))


def forecast(series: DataFrame, seg: list[str] | None = None, horizon: int = FORECAST_HORIZON,
             grain: str = "month", clip: bool = True,
             min_points: int = FORECAST_MIN_POINTS) -> DataFrame:
    """Point forecast and 80% prediction interval for ``horizon`` periods.

    Interval: yhat +/- t(0.9, n-2) * sqrt(s2 * (1 + 1/n + (t0 - tbar)^2 / Sxx)).
    Segments with fewer than ``min_points`` periods are skipped. ``clip`` bounds a rate
    to [0, 1] (use it for binary targets only).
    """
    seg = seg or []
    fit = trend_fit(series, seg).where(F.col("n_points") >= min_points)
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    n = F.col("n_points").cast("double")
    t0 = n - 1 + F.col("step")
    point = F.col("intercept") + F.col("slope") * t0
    se = F.sqrt(F.col("s2") * (1 + 1 / n + F.pow(t0 - F.col("t_mean"), 2) / F.col("sxx")))
    tq = t_quantile_090(F.col("n_points") - 2)
    if grain == "month":
        period = F.add_months("last_period", F.col("step"))
    elif grain == "day":
        period = F.date_add("last_period", F.col("step"))
    elif grain == "week":
        period = F.date_add("last_period", F.col("step") * 7)
    else:
        period = F.add_months("last_period", F.col("step") * 12)
    out = steps.select(*seg, "step", period.alias("period"), "n_points",
                       point.alias("point"), (point - tq * se).alias("lower"),
                       (point + tq * se).alias("upper"))
    if clip:
        out = out.select(*seg, "step", "period", "n_points", clip01(F.col("point")).alias("point"),
                         clip01(F.col("lower")).alias("lower"), clip01(F.col("upper")).alias("upper"))
    return out


def walk_forward(series: DataFrame, seg: list[str] | None = None,
                 max_points: int = BACKTEST_MAX_POINTS,
                 min_points: int = FORECAST_MIN_POINTS) -> DataFrame:
    """One-step-ahead predictions for the last min(6, n // 3) periods, each refit on
    all earlier periods; plus the naive last-value forecast. Rows: (seg.., t, period, rate,
    pred, naive, abs_err, naive_err)."""
    seg = seg or []
    s = with_time_index(series, seg)
    part = Window.partitionBy(*seg)
    prior = part.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    y, t = F.col("rate"), F.col("t").cast("double")
    s = (s.withColumn("n_points", F.count(F.lit(1)).over(part))
         .withColumn("pred", F.regr_intercept(y, t).over(prior) + F.regr_slope(y, t).over(prior) * t)
         .withColumn("naive", F.lag("rate").over(part.orderBy("t"))))
    n_bt = F.least(F.lit(max_points), F.floor(F.col("n_points") / 3))
    return (s.where((F.col("n_points") >= min_points) & (F.col("t") >= F.col("n_points") - n_bt))
            .select(*seg, "t", "period", "rate", "pred", "naive",
                    F.abs(F.col("pred") - F.col("rate")).alias("abs_err"),
                    F.abs(F.col("naive") - F.col("rate")).alias("naive_err")))


def backtest_metrics(wf: DataFrame, seg: list[str] | None = None) -> DataFrame:
    """MAE, naive MAE, MAPE (denominator floored at 1e-9) and beats_naive."""
    seg = seg or []
    m = wf.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("n_backtest"), F.avg("abs_err").alias("mae"),
        F.avg("naive_err").alias("naive_mae"),
        F.avg(F.col("abs_err") / F.greatest(F.abs("rate"), F.lit(1e-9))).alias("mape"))
    return m.withColumn("beats_naive", F.col("mae") <= F.col("naive_mae"))


# periods of one season, and a period's place in it
SEASONS = {"month": (12, F.month), "day": (7, F.dayofweek)}


def _seasonal_fits(indexed: DataFrame, seg: list[str], grain: str, max_points: int) -> DataFrame:
    """Trend and season effects of every segment, fitted on all periods before each of its last
    ``origin``s: rows (seg.., origin, season, k, t_mean, y_mean, slope, s2, dof, sxx, last_period).

    Least squares with one effect per season leaves closed sums: the slope is that of the values
    centred inside their season. So one grouped table holds the normal equations of all segments
    and origins; an origin repeats the segment's periods, of which there are few.
    """
    n_bt = F.least(F.lit(max_points), F.floor(F.col("n_points") / 3))
    first = F.greatest(F.col("n_points") - n_bt, F.col("t") + 1).cast("int")
    rows = indexed.withColumn("origin", F.explode(F.sequence(first, F.col("n_points").cast("int"))))
    y, t = F.col("rate"), F.col("t").cast("double")
    cells = rows.groupBy(*seg, "origin", "season").agg(
        F.count(y).alias("k"), F.avg(t).alias("t_mean"), F.avg(y).alias("y_mean"), F.regr_sxx(y, t).alias("xx"),
        F.regr_syy(y, t).alias("yy"), F.regr_sxy(y, t).alias("xy"), F.max("period").alias("last"))
    fit = Window.partitionBy(*seg, "origin")
    xx, yy, xy = (F.sum(c).over(fit) for c in ("xx", "yy", "xy"))
    slope = F.try_divide(xy, xx)
    dof = F.sum("k").over(fit) - F.count(F.lit(1)).over(fit) - 1
    return cells.select(*seg, "origin", "season", "k", "t_mean", "y_mean", slope.alias("slope"), dof.alias("dof"), xx.alias("sxx"),
                        F.when(dof > 0, F.greatest(yy - slope * xy, F.lit(0.0)) / dof).alias("s2"), F.max("last").over(fit).alias("last_period"))


def _seasonal_index(series: DataFrame, seg: list[str], grain: str) -> DataFrame:
    """The series of segments with two whole seasons or more, with t, season and n_points."""
    length, place = SEASONS[grain]
    s = with_time_index(series, seg).withColumn("season", place("period"))
    return s.withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy(*seg))).where(F.col("n_points") >= 2 * length)


def forecast_seasonal(series: DataFrame, seg: list[str] | None = None, horizon: int | None = None, grain: str = "month",
                      clip: bool = True, max_points: int = BACKTEST_MAX_POINTS) -> DataFrame:
    """Trend plus season effects per segment: (seg.., step, period, n_points, point, lower, upper).

    The 80% interval is yhat +/- t(0.9, dof) * sqrt(s2 * (1 + 1/k + (t0 - t_mean)^2 / Sxx)) with k and
    t_mean of the period's season. Segments under two whole seasons, or without a value at the
    season asked for, give no row. Default horizon: one season.
    """
    seg = seg or []
    length, place = SEASONS[grain]
    indexed = _seasonal_index(series, seg, grain)
    totals = indexed.groupBy(*seg).agg(F.max("n_points").alias("n_points"))
    fits = _seasonal_fits(indexed, seg, grain, 0)  # the one origin after the last period
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon or length))))
    period = F.add_months("last_period", F.col("step")) if grain == "month" else F.date_add("last_period", F.col("step"))
    t0 = F.col("origin") - 1 + F.col("step")
    point = F.col("y_mean") + F.col("slope") * (t0 - F.col("t_mean"))
    se = F.sqrt(F.col("s2") * (1 + 1 / F.col("k") + F.try_divide(F.pow(t0 - F.col("t_mean"), 2), F.col("sxx"))))
    half = t_quantile_090(F.col("dof")) * se
    out = steps.withColumn("period", period).where((place("period") == F.col("season")) & (F.col("dof") > 0))
    made = [point.alias("point"), (point - half).alias("lower"), (point + half).alias("upper")]
    out = out.select(*seg, "step", "period", F.col("origin").alias("n_points"), *made)
    if clip:
        out = out.select(*seg, "step", "period", "n_points", *[clip01(F.col(c)).alias(c) for c in ("point", "lower", "upper")])
    return out


def walk_forward_seasonal(series: DataFrame, seg: list[str] | None = None, grain: str = "month",
                          max_points: int = BACKTEST_MAX_POINTS) -> DataFrame:
    """One-step-ahead seasonal predictions beside the linear fit's and the last value's, each refit
    on all earlier periods: (seg.., t, period, rate, pred, linear, naive, abs_err, linear_err, naive_err).

    Periods whose season has not been seen before are left out.
    """
    seg = seg or []
    indexed = _seasonal_index(series, seg, grain)
    fits = _seasonal_fits(indexed, seg, grain, max_points).select(
        *seg, F.col("origin").alias("t"), "season", "t_mean", "y_mean", "slope")
    told = indexed.select(*seg, "t", "season", "period", "rate").join(fits, [*seg, "t", "season"]).withColumn(
        "pred", F.col("y_mean") + F.col("slope") * (F.col("t") - F.col("t_mean"))).where(F.col("pred").isNotNull())
    plain = walk_forward(series, seg, max_points).select(*seg, "t", F.col("pred").alias("linear"), "naive",
                                                         F.col("abs_err").alias("linear_err"), "naive_err")
    return told.join(plain, [*seg, "t"]).select(
        *seg, "t", "period", "rate", "pred", "linear", "naive", F.abs(F.col("pred") - F.col("rate")).alias("abs_err"), "linear_err", "naive_err")


def seasonal_metrics(wf: DataFrame, seg: list[str] | None = None) -> DataFrame:
    """Mean absolute errors of ``walk_forward_seasonal`` and whether the seasonal form wins."""
    m = wf.groupBy(*(seg or [])).agg(F.count(F.lit(1)).alias("n_backtest"), F.avg("abs_err").alias("mae"),
                                     F.avg("linear_err").alias("linear_mae"), F.avg("naive_err").alias("naive_mae"))
    return m.withColumn("beats_linear", F.col("mae") <= F.col("linear_mae"))


def projections(fc: DataFrame, metrics: DataFrame, metric_name: str,
                seg: list[str] | None = None) -> DataFrame:
    """Projection rows with horizon label, rounded numbers, backtest struct and caveats."""
    seg = seg or []
    base_caveats = F.array(
        F.lit("Linear-trend baseline: no seasonality or regime-change modeling."),
        F.concat(F.lit("Short history ("), F.col("n_points").cast("string"),
                 F.lit(" months) -> intervals are wide and uncertain.")),
        F.lit("Recent months may be right-censored (immature outcomes), biasing the trend."))
    lose = F.lit("Model does NOT beat a naive last-value forecast — treat as low-value.")
    caveats = F.when(F.col("beats_naive"), base_caveats).otherwise(F.array_append(base_caveats, lose))
    joined = fc.join(metrics, seg, "inner") if seg else fc.join(metrics, how="inner")
    return joined.select(
        *seg, F.lit(metric_name).alias("metric"), "step",
        F.date_format("period", "MMM yyyy").alias("horizon"),
        F.round("point", 4).alias("point"), F.round("lower", 4).alias("lower"),
        F.round("upper", 4).alias("upper"),
        F.struct(F.round("mae", 4).alias("MAE"), F.round("mape", 4).alias("MAPE"),
                 F.round("naive_mae", 4).alias("naive_MAE"),
                 F.col("beats_naive").alias("beats_naive")).alias("backtest_error"),
        F.lit("OLS linear trend; 80% prediction interval; walk-forward backtest").alias("method"),
        caveats.alias("caveats"))


def chart_forecast(series: DataFrame, fc: DataFrame) -> DataFrame:
    """(series, ord, x, y) chart rows: history, forecast and the band, in percent."""
    hist = with_time_index(series).select(
        F.lit("history").alias("series"), F.col("t").alias("ord"),
        F.date_format("period", "yyyy-MM-dd").alias("x"), F.round(F.col("rate") * 100, 2).alias("y"))
    parts = [hist]
    for name in ("point", "lower", "upper"):
        parts.append(fc.select(F.lit("forecast" if name == "point" else name).alias("series"),
                               (F.col("step") - 1).cast("int").alias("ord"),
                               F.date_format("period", "yyyy-MM-dd").alias("x"),
                               F.round(F.col(name) * 100, 2).alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
