"""Findings, guardrails, limitations, KPIs, digests and chart data (A17-A23, T6-T8, 2.13).

Artifacts are small tables (one row per finding / rule / chart point) derived lazily from the
operator outputs; claim text is assembled with ``format_string`` so numbers are never typed by
hand. Order is explicit (``ord`` columns), never implied by row order.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import (OVERCLAIM_PHRASES, RECOMPUTE_TOLERANCE, confidence_tier, fixed,
                                 pct_text, signed_pct_text)

FINDING_SCHEMA = ("ord INT, claim STRING, evidence MAP<STRING,STRING>, confidence STRING, "
                  "method STRING, limitations ARRAY<STRING>")


def title(name: str) -> str:
    """Title-case a column name as the briefing text does (capital after any non-letter)."""
    return name.title()


def _pct(x: Column, places: int) -> Column:
    return pct_text(x, places)


def _spct(x: Column, places: int) -> Column:
    return signed_pct_text(x, places)


def _lits(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _finding(df: DataFrame, ord_: int, claim: Column, evidence: Column, confidence: Column,
             method: str | Column, limitations: Column) -> DataFrame:
    m = method if isinstance(method, Column) else F.lit(method)
    return df.select(F.lit(ord_).cast("int").alias("ord"), claim.alias("claim"),
                     evidence.cast("map<string,string>").alias("evidence"), confidence.alias("confidence"),
                     m.alias("method"), limitations.alias("limitations"))


def finding_overall_rate(rate: DataFrame, target: str, positive: str | None, ord_: int = 0) -> DataFrame:
    """Headline outcome rate (``rate`` from ``overall_rate``)."""
    pos_txt = "" if positive in (None, "1", "True", "true") else f" (positive class = {positive})"
    claim = F.concat(F.lit(f"Overall {target} rate is "), _pct(F.col("rate"), 2), F.lit(pos_txt),
                     F.lit(" across "), F.format_number(F.col("n"), 0), F.lit(" records ("),
                     F.format_number(F.col("positives"), 0), F.lit(" positive cases)."))
    lim = F.when(F.col("imbalanced"), F.array(
        F.lit("Pooled rate hides segment variation (see driver breakdown)."),
        F.concat(F.lit("Severe class imbalance ("), _pct(F.col("rate"), 2),
                 F.lit(" positive) — raw accuracy will be misleading; modeling must use ROC-AUC / "
                       "PR-AUC and class-imbalance handling.")))
    ).otherwise(_lits(["Pooled rate hides segment variation (see driver breakdown)."]))
    ev = F.create_map(F.lit("rate"), F.round("rate", 5).cast("string"), F.lit("n"), F.col("n").cast("string"),
                      F.lit("positives"), F.col("positives").cast("string"),
                      F.lit("positive_class"), F.lit(str(positive if positive is not None else 1)))
    return _finding(rate, ord_, claim, ev, confidence_tier("n"), "mean of binary target", lim)


def finding_categorical_driver(top: DataFrame, target: str, ord_: int = 1) -> DataFrame:
    """A7/A22 from ``top_driver`` output (segment table of the winning column)."""
    g = top.groupBy("col_name").agg(
        F.min("rate").alias("lo"), F.max("rate").alias("hi"), F.min("n").alias("min_n"),
        F.max_by("value", F.struct(F.col("rate"), F.col("value"))).alias("top_value"),
        F.map_from_entries(F.collect_list(F.struct("value", F.round("rate", 4).cast("string")))).alias("ev"))
    claim = F.concat(F.lit("'"), F.col("col_name"), F.lit(f"' is the strongest categorical driver of {target}: "
                                                          "rate ranges "),
                     _pct(F.col("lo"), 1), F.lit("-"), _pct(F.col("hi"), 1), F.lit(" (highest for "),
                     F.col("col_name"), F.lit("="), F.col("top_value"), F.lit(" at "), _pct(F.col("hi"), 1),
                     F.lit(")."))
    return _finding(g, ord_, claim, F.col("ev"), confidence_tier("min_n"),
                    "group-by mean of target with min group size filter",
                    _lits(["Association, not proven causation.",
                           "Confounding with other variables not yet controlled."]))


def finding_numeric_drivers(top: DataFrame, target: str, n_rows: Column, ord_: int = 2) -> DataFrame:
    """A9-A11/A22 from ``numeric_drivers_top`` output (empty input -> no finding)."""
    parts = top.agg(
        F.min_by("col_name", "driver_rank").alias("name0"), F.min_by("r", "driver_rank").alias("r0"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("driver_rank", "col_name", "r"))), 1, 3),
                                 lambda s: F.concat(s["col_name"], F.lit(" ("),
                                                    fixed(s["r"], 2, sign=True), F.lit(")"))), ", ").alias("top3"),
        F.max(F.col("anonymised").cast("int")).alias("anon"), F.count(F.lit(1)).alias("k"),
        F.map_from_entries(F.collect_list(F.struct("col_name", F.round("r", 4).cast("string")))).alias("ev"))
    claim = F.concat(F.lit("Among numeric features, '"), F.col("name0"),
                     F.lit(f"' is most associated with {target} (r="), fixed(F.col("r0"), 2, sign=True),
                     F.lit("). Top drivers: "), F.col("top3"), F.lit("."))
    lim = F.when(F.col("anon") == 1, _lits([
        "Linear association only; non-linear effects need a model (Part 1).", "Correlation, not causation.",
        "V1..V28 are PCA-anonymized, so individual features aren't directly interpretable."])).otherwise(
        _lits(["Linear association only; non-linear effects need a model (Part 1).", "Correlation, not causation."]))
    return _finding(parts.where(F.col("k") > 0), ord_, claim, F.col("ev"), confidence_tier(n_rows),
                    "point-biserial correlation (feature vs binary target)", lim)


def finding_trend(trend: DataFrame, target: str, ord_: int = 3) -> DataFrame:
    """A13/A22 from ``trend_direction`` output."""
    claim = F.concat(F.lit(f"{title(target)} rate is "), F.col("direction"), F.lit(" over time: "),
                     _pct(F.col("first_rate"), 1), F.lit(" -> "), _pct(F.col("last_rate"), 1), F.lit(" from "),
                     F.date_format("first_period", "MMM yyyy"), F.lit(" to "),
                     F.date_format("last_period", "MMM yyyy"), F.lit("."))
    ev = F.create_map(F.lit("first"), F.round("first_rate", 4).cast("string"),
                      F.lit("last"), F.round("last_rate", 4).cast("string"),
                      F.lit("points"), F.col("points").cast("string"))
    return _finding(trend, ord_, claim, ev, F.lit("medium"), "monthly resample of target mean",
                    _lits(["Trend is descriptive; no seasonality adjustment yet.",
                           "Recent months may have immature outcomes (right-censoring)."]))


def finding_rate_mix(summary: DataFrame, target: str, ord_: int = 4) -> DataFrame:
    """A15/A16/A22 from the ``rate_mix`` summary."""
    dominant = F.when(F.col("dominant") == "rate", F.lit("within-segment rate deterioration")) \
        .otherwise(F.lit("a shift in portfolio mix toward riskier segments"))
    tail = F.when(F.col("top_segment").isNotNull(),
                  F.concat(F.lit(", concentrated in "), F.col("segment_col"), F.lit("="), F.col("top_segment"),
                           F.lit("."))).otherwise(F.lit("."))
    claim = F.concat(F.lit(f"{title(target)} rate moved "), _spct(F.col("delta"), 1), F.lit(" ("),
                     _pct(F.col("rate_a"), 1), F.lit("→"), _pct(F.col("rate_b"), 1),
                     F.lit(") from the earlier to the recent period. Decomposing by '"), F.col("segment_col"),
                     F.lit("': within-segment rate change contributes "), _spct(F.col("rate_effect"), 1),
                     F.lit(" and mix shift "), _spct(F.col("mix_effect"), 1), F.lit(" (interaction "),
                     _spct(F.col("interaction"), 1), F.lit(") — i.e. the move is driven mainly by "),
                     dominant, tail)
    ev = F.create_map(*[x for k in ("delta", "rate_effect", "mix_effect", "interaction")
                        for x in (F.lit(k), F.round(k, 4).cast("string"))])
    method = F.concat(F.lit("rate/mix decomposition by '"), F.col("segment_col"),
                      F.lit("', historical vs recent split at the time median"))
    return _finding(summary, ord_, claim, ev, F.lit("medium"), method, _lits([
        "Attribution, NOT proven causation — confounders are uncontrolled.",
        "Recent-period outcomes may be immature (right-censoring), biasing the change.",
        "Two-period split is coarse; sensitive to the cut point."]))


def finding_no_target(spark: SparkSession, explicit: str | None, ord_: int = 0) -> DataFrame:
    """Low-confidence fallback when no binary target applies (two wordings)."""
    if explicit:
        msg = (f"Target '{explicit}' isn't binary, so the baseline rate/segment analysis doesn't apply — "
               "see the model results below for the regression analysis and its drivers.")
        lim = ["Baseline rate analysis is for binary targets; the modeler handles this one."]
    else:
        msg = ("No target column was auto-detected, so I ran descriptive profiling only. To unlock "
               "modeling, driver analysis, and forecasting, pick the column you want to predict in the "
               "sidebar 'Target column' dropdown.")
        lim = ["Modeling and driver analysis need a target — choose one in the sidebar 'Target column' dropdown."]
    return spark.createDataFrame([(ord_, msg, {}, "low", "target detection", lim)], FINDING_SCHEMA)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- A17, A18, A19 --------------------------------------------------------------------------
def recompute_check(raw_y: DataFrame, findings: DataFrame, target: str,
                    tolerance: float = RECOMPUTE_TOLERANCE) -> DataFrame:
    """Recompute the headline rate from a pruned scan of the encoded target and compare
    with the reported one. Three states: confirmed / disagrees / not_reported."""
    recomputed = raw_y.agg(F.avg(F.col("y").cast("double")).alias("v")).scalar()
    reported = findings.where(F.col("claim").contains("Overall") & F.col("evidence").getItem("rate").isNotNull()) \
        .agg(F.min_by(F.col("evidence").getItem("rate").cast("double"), "ord")).scalar()
    row = raw_y.sparkSession.range(1).select(recomputed.alias("recomputed"), reported.alias("reported"))
    status = (F.when(F.col("reported").isNull(), F.lit("not_reported"))
              .when(F.abs(F.col("recomputed") - F.col("reported")) > tolerance, F.lit("disagrees"))
              .otherwise(F.lit("confirmed")))
    text = (F.when(status == "disagrees", F.concat(
        F.lit(f"WARNING: independent recompute of {target} rate ("), _pct(F.col("recomputed"), 2),
        F.lit(") disagrees with the reported "), _pct(F.col("reported"), 2),
        F.lit(" — investigate before sharing.")))
        .when(status == "confirmed", F.concat(F.lit(f"Independent recompute confirms the headline {target} rate ("),
                                              _pct(F.col("recomputed"), 2), F.lit(").")))
        .otherwise(F.concat(F.lit(f"Independent recompute of {target} rate is "), _pct(F.col("recomputed"), 2),
                            F.lit("; no headline rate was reported to compare."))))
    return row.select("recomputed", "reported", (F.col("recomputed") - F.col("reported")).alias("diff"),
                      status.alias("status"), text.alias("guardrail"))


def confidence_rollup(findings: DataFrame) -> DataFrame:
    """Any low -> medium if #high >= #low else low; no low -> high if >= 2 high else medium;
    no findings -> low."""
    c = findings.agg(F.count_if(F.col("confidence") == "low").alias("n_low"),
                     F.count_if(F.col("confidence") == "high").alias("n_high"),
                     F.count(F.lit(1)).alias("n"))
    overall = (F.when(F.col("n") == 0, F.lit("low"))
               .when(F.col("n_low") > 0, F.when(F.col("n_high") >= F.col("n_low"), F.lit("medium")).otherwise(F.lit("low")))
               .when(F.col("n_high") >= 2, F.lit("high")).otherwise(F.lit("medium")))
    return c.select("n", "n_high", "n_low", overall.alias("overall_confidence"))


def guardrails(spark: SparkSession, recompute: DataFrame | None, rollup: DataFrame,
               has_models: bool, projections: DataFrame | None, has_time_column: bool) -> DataFrame:
    """Ordered rule rows (ord, rule)."""
    parts = []
    if recompute is not None:
        parts.append(recompute.select(F.lit(0).alias("ord"), F.col("guardrail").alias("rule")))
    if has_models:
        parts.append(spark.range(1).select(F.lit(1).alias("ord"), F.lit(
            "Model results come from a single held-out split, not validated over time or on new data — "
            "avoid 'production-ready' claims.").alias("rule")))
    if projections is not None:
        lose = projections.agg(F.max((~F.col("backtest_error.beats_naive")).cast("int")).alias("l")).where("l = 1")
        parts.append(lose.select(F.lit(2).alias("ord"), F.lit(
            "At least one forecast does not beat a naive baseline — present projections as low-confidence.")
            .alias("rule")))
        parts.append(projections.limit(1).select(F.lit(3).alias("ord"), F.lit(
            "Forecasts assume a linear trend and may be biased by right-censoring.").alias("rule")))
    if has_time_column:
        parts.append(spark.range(1).select(F.lit(4).alias("ord"), F.lit(
            "Recent-period outcomes may be immature; do not over-read recent moves.").alias("rule")))
    banned = ", ".join(f"'{w}'" for w in OVERCLAIM_PHRASES)
    parts.append(spark.range(1).select(F.lit(5).alias("ord"), F.lit(
        f"Do NOT use overclaiming words: {banned}. Use calibrated language tied to the evidence.").alias("rule")))
    parts.append(rollup.select(F.lit(6).alias("ord"), F.concat(
        F.lit("State overall confidence as at most '"), F.col("overall_confidence"), F.lit("'.")).alias("rule")))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("ord").cast("int").alias("ord"), "rule")


def overclaim_scan(df: DataFrame, text_col: str, phrases: list[str] = OVERCLAIM_PHRASES) -> DataFrame:
    """Banned phrases found (case-insensitive substring) in each row's text."""
    low = F.lower(F.col(text_col))
    found = F.filter(_lits(phrases), lambda p: F.contains(low, p))
    return df.withColumn("overclaims", found).withColumn("n_overclaims", F.size("overclaims"))


# --- A20, A21, T6, T8 -------------------------------------------------------------------------
def limitations_list(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct limitations sorted, followed by the guardrails in their order."""
    lims = findings.select(F.explode("limitations").alias("text")).distinct()
    w = Window.orderBy("text")  # limitations are a handful of sentences
    a = lims.select(F.row_number().over(w).alias("ord"), "text")
    n = a.agg(F.count(F.lit(1))).scalar()
    b = rules.select((n + F.row_number().over(Window.orderBy("ord"))).alias("ord"), F.col("rule").alias("text"))
    return a.unionByName(b).select(F.col("ord").cast("int").alias("ord"), "text")


def kpis(n_rows: DataFrame, findings: DataFrame, rollup: DataFrame, label: str = "Outcome",
         best_model: DataFrame | None = None) -> DataFrame:
    """(ord, label, value) KPI cards."""
    parts = [n_rows.select(F.lit(0).alias("ord"), F.lit("Records analyzed").alias("label"),
                           F.format_number("n_rows", 0).alias("value"))]
    rate = findings.where(F.col("claim").contains("Overall") & F.col("evidence").getItem("rate").isNotNull()) \
        .select(F.lit(1).alias("ord"), F.lit(f"{label} rate").alias("label"),
                _pct(F.col("evidence").getItem("rate").cast("double"), 2).alias("value"))
    parts.append(rate)
    if best_model is not None:
        parts.append(best_model.select(F.lit(2).alias("ord"),
                                       F.concat(F.lit("Best model · "), F.col("primary_metric")).alias("label"),
                                       fixed(F.col("test_score"), 3).alias("value")))
    parts.append(rollup.select(F.lit(3).alias("ord"), F.lit("Overall confidence").alias("label"),
                               F.initcap("overall_confidence").alias("value")))
    return reduce(DataFrame.unionByName, parts).select(F.col("ord").cast("int").alias("ord"), "label", "value")


def bluf_summary(findings: DataFrame, rollup: DataFrame) -> DataFrame:
    """T8: "Executive summary (BLUF): <lead claim> <other claims> Overall confidence: x."."""
    claims = findings.agg(F.array_sort(F.collect_list(F.struct("ord", "claim"))).alias("c"))
    text = F.concat(F.lit("Executive summary (BLUF): "),
                    F.coalesce(F.col("c")[0]["claim"], F.lit("No findings generated.")), F.lit(" "),
                    F.array_join(F.transform(F.filter(F.col("c"), lambda s, i: i > 0), lambda s: s["claim"]), " "))
    conf = rollup.select(F.struct("overall_confidence")).scalar()["overall_confidence"]
    return claims.select(F.concat(text, F.lit(" Overall confidence: "), conf, F.lit(".")).alias("summary"))


def context_digest(quality_summary: DataFrame, findings: DataFrame, projections: DataFrame | None) -> DataFrame:
    """Grounded context text, sections DATASET / FINDINGS / PROJECTIONS in order."""
    sec = [quality_summary.select(F.lit(0).alias("section"), F.lit(0).alias("ord"),
                                  F.concat(F.lit("## DATASET\n"), F.col("quality_summary")).alias("line"))]
    sec.append(findings.select(F.lit(1).alias("section"), F.col("ord"),
                               F.concat(F.lit("- "), F.col("claim"), F.lit(" (confidence: "), F.col("confidence"),
                                        F.lit("; method: "), F.col("method"), F.lit(")")).alias("line")))
    if projections is not None:
        sec.append(projections.select(F.lit(2).alias("section"), F.col("step").alias("ord"), F.concat(
            F.lit("- "), F.col("metric"), F.lit(" ("), F.col("horizon"), F.lit("): "), F.col("point").cast("string"),
            F.lit(" ["), F.col("lower").cast("string"), F.lit(", "), F.col("upper").cast("string"), F.lit("]"))
            .alias("line")))
    lines = reduce(DataFrame.unionByName, sec)
    hdr = {1: "## FINDINGS", 2: "## PROJECTIONS"}
    agg = lines.groupBy("section").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n").alias("body"))
    body = F.when(F.col("section") == 0, F.col("body")).otherwise(
        F.concat(F.when(F.col("section") == 1, F.lit(hdr[1])).otherwise(F.lit(hdr[2])), F.lit("\n"), F.col("body")))
    return agg.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", body.alias("b")))),
                                            lambda s: s["b"]), "\n\n").alias("context"))


# --- 2.13 chart data --------------------------------------------------------------------------
def chart_driver(top: DataFrame) -> DataFrame:
    """Driver bar: (chart_id, ord, x, y) with y = rate x 100 rounded to 1 place, by rate desc."""
    return top.select(F.concat(F.lit("driver_"), F.col("col_name")).alias("chart_id"),
                      (F.col("seg_rank") - 1).cast("int").alias("ord"), F.col("value").alias("x"),
                      F.round(F.col("rate") * 100, 1).alias("y"))


def chart_trend(series: DataFrame) -> DataFrame:
    """Trend line: (chart_id, ord, x, y) with y = rate x 100 rounded to 2 places."""
    w = Window.orderBy("period")  # one row per period
    return series.select(F.lit("trend_over_time").alias("chart_id"), (F.row_number().over(w) - 1).cast("int").alias("ord"),
                         F.date_format("period", "yyyy-MM-dd").alias("x"), F.round(F.col("rate") * 100, 2).alias("y"))


def chart_importance(top: DataFrame) -> DataFrame:
    """Importance bar: (chart_id, ord, x, y) of the ranked importances (feature, importance, rank), rounded to
    5 places; no rows where no column matters."""
    return top.select(F.lit("feature_importance").alias("chart_id"), (F.col("rank") - 1).cast("int").alias("ord"),
                      F.col("feature").alias("x"), F.round("importance", 5).alias("y"))


def chart_numeric_drivers(top: DataFrame) -> DataFrame:
    return top.select(F.lit("numeric_drivers").alias("chart_id"), (F.col("driver_rank") - 1).cast("int").alias("ord"),
                      F.col("col_name").alias("x"), F.round(F.abs("r"), 3).alias("y"))
