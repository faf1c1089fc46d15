"""Outcome rate, segment rates and driver ranking (A1-A11, H1-H4 building blocks).

Every operator takes a DataFrame holding a 0/1 event column and returns a small DataFrame.
Shuffles are bounded by the number of distinct (column, value) pairs: segment aggregates are
partial-aggregated map-side, so a hot value (even a third of all rows) never reaches one
reducer as raw rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import (IMBALANCE_HIGH, IMBALANCE_LOW, MIN_GROUP,
                                 NUMERIC_DRIVER_MIN_ABS_R, NUMERIC_DRIVER_TOP,
                                 confidence_tier, safe_div)


def _ord_expr(name_col: Column, names: list[str]) -> Column:
    """Position (0-based) of a column name in ``names``, as INT."""
    return (F.array_position(F.array(*[F.lit(n) for n in names]), name_col) - 1).cast("int")


# --- A1, A2, A3 ------------------------------------------------------------------------
def overall_rate(df: DataFrame, y: str = "y") -> DataFrame:
    """One row: n, positives, rate, imbalance flag and confidence tier.

    ``y`` is the encoded 0/1 event (NULL already mapped per the encoding rule); rows are
    counted with ``count(*)`` so a NULL target stays in n, as in the analysed behaviour.
    """
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(F.col(y).cast("bigint")), F.lit(0)).cast("bigint")
                 .alias("positives"))
    rate = safe_div(F.col("positives").cast("double"), F.col("n").cast("double"))
    return (agg.withColumn("rate", rate)
            .withColumn("imbalanced", (F.col("rate") < IMBALANCE_LOW) | (F.col("rate") > IMBALANCE_HIGH))
            .withColumn("confidence", confidence_tier("n")))


# --- A4, A5, L1 ------------------------------------------------------------------------
def segment_rates(df: DataFrame, col: str, y: str = "y", min_n: int = MIN_GROUP) -> DataFrame:
    """Rate and count of ``y`` per value of ``col``; NULL values dropped, n >= min_n,
    ordered by rate descending (value breaks ties)."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("value"))
            .agg(F.count(y).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
            .where(F.col("n") >= min_n)
            .withColumn("rate", safe_div(F.col("positives").cast("double"), F.col("n").cast("double")))
            .orderBy(F.desc("rate"), F.asc("value")))


# --- A6 ---------------------------------------------------------------------------------
def segment_counts_long(df: DataFrame, cols: list[str], y: str = "y",
                        weight: str | None = None, positives: str | None = None) -> DataFrame:
    """(col_name, value, n, positives) for every column in ``cols`` with ONE shuffle.

    Columns are cast to STRING and unpivoted; the aggregate is partial-aggregated before the
    exchange, so shuffle volume is partitions x distinct (column, value) pairs.
    ``weight``/``positives`` allow pre-aggregated input (n and positives already summed).
    """
    ids = [y] if weight is None else [weight, positives]
    wide = df.select(*[F.col(c) for c in ids],
                     *[F.col(c).cast("string").alias(c) for c in cols])
    long = wide.unpivot(ids, cols, "col_name", "value").where(F.col("value").isNotNull())
    if weight is None:
        return long.groupBy("col_name", "value").agg(
            F.count(y).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    return long.groupBy("col_name", "value").agg(
        F.sum(weight).cast("bigint").alias("n"), F.sum(positives).cast("bigint").alias("positives"))


def _finish_segments(counts: DataFrame, cols: list[str], min_n: int) -> DataFrame:
    return (counts.where(F.col("n") >= min_n)
            .withColumn("rate", safe_div(F.col("positives").cast("double"), F.col("n").cast("double")))
            .withColumn("col_ord", _ord_expr(F.col("col_name"), cols))
            .select("col_name", "col_ord", "value", "n", "positives", "rate"))


def segment_rates_all(df: DataFrame, cols: list[str], y: str = "y",
                      min_n: int = MIN_GROUP) -> DataFrame:
    """Segment rate tables for many columns at once (unpivot form)."""
    return _finish_segments(segment_counts_long(df, cols, y), cols, min_n)


def segment_rates_grouping_sets(df: DataFrame, cols: list[str], y: str = "y",
                                min_n: int = MIN_GROUP) -> DataFrame:
    """Same result as :func:`segment_rates_all`, planned as GROUPING SETS ((c1),(c2),..)."""
    casted = df.select(F.col(y), *[F.col(c).cast("string").alias(c) for c in cols])
    g = casted.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_gid"),
        F.count(y).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    k = len(cols)
    # grouping_id has bit (k-1-i) cleared for the column that is grouped in set i
    name = reduce(lambda acc, i: acc.when(F.col("_gid") == ((1 << k) - 1 - (1 << (k - 1 - i))),
                                          F.lit(cols[i])),
                  range(1, k), F.when(F.col("_gid") == ((1 << k) - 1 - (1 << (k - 1))), F.lit(cols[0])))
    value = F.coalesce(*[F.col(c) for c in cols])
    counts = g.select(name.alias("col_name"), value.alias("value"), "n", "positives") \
        .where(F.col("value").isNotNull())
    return _finish_segments(counts, cols, min_n)


def star_segment_rates(fact: DataFrame, key: str, fact_cols: list[str], dim: DataFrame,
                       dim_key: str, dim_cols: list[str], y: str = "y",
                       min_n: int = MIN_GROUP) -> DataFrame:
    """Segment rates over fact columns and columns of a dimension reached through ``key``.

    Eager pre-aggregation: the fact side is reduced to (key, n, positives) before it meets the
    dimension, so the join moves one row per key instead of one per fact row. The fact-only
    columns are aggregated straight from the fact table (no join at all). Both halves are then
    a single unpivot aggregate each. Result equals the flat join + :func:`segment_rates_all`.
    """
    cols = fact_cols + dim_cols
    parts = []
    if fact_cols:
        parts.append(segment_counts_long(fact, fact_cols, y))
    if dim_cols:
        per_key = fact.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.count(y).alias("_n"), F.sum(F.col(y).cast("bigint")).alias("_pos"))
        joined = per_key.join(dim.select(dim_key, *dim_cols), F.col(key) == F.col(dim_key))
        parts.append(segment_counts_long(joined, dim_cols, weight="_n", positives="_pos"))
    counts = reduce(DataFrame.unionByName, parts)
    return _finish_segments(counts, cols, min_n)


# --- A7, A8 -----------------------------------------------------------------------------
def categorical_drivers(segments: DataFrame, require_positive_spread: bool = False) -> DataFrame:
    """Rank columns by rate spread (max - min) over their qualifying segments.

    Columns need >= 2 qualifying segments; ties go to the earlier column (``col_ord``).
    ``require_positive_spread`` gives the root-cause variant, which also needs spread > 0.
    """
    per_col = (segments.groupBy("col_name", "col_ord").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"), F.min("n").alias("min_n"),
        F.max_by("value", F.struct(F.col("rate"), F.col("value"))).alias("top_value"))
        .where(F.col("n_groups") >= 2)
        .withColumn("spread", F.col("max_rate") - F.col("min_rate")))
    if require_positive_spread:
        per_col = per_col.where(F.col("spread") > 0)
    w = Window.orderBy(F.desc("spread"), F.asc("col_ord"))  # one row per column: tiny
    return per_col.withColumn("driver_rank", F.row_number().over(w).cast("int")) \
        .withColumn("confidence", confidence_tier("min_n"))


def top_driver(segments: DataFrame, require_positive_spread: bool = False) -> DataFrame:
    """Segment table of the strongest driver column, sorted by rate descending."""
    best = categorical_drivers(segments, require_positive_spread) \
        .where(F.col("driver_rank") == 1).select("col_name")
    w = Window.partitionBy("col_name").orderBy(F.desc("rate"), F.asc("value"))
    return (segments.join(best, "col_name", "left_semi")
            .withColumn("seg_rank", F.row_number().over(w).cast("int")))


# --- A9, A10, A11 -----------------------------------------------------------------------
def numeric_drivers(df: DataFrame, cols: list[str], y: str = "y") -> DataFrame:
    """Pearson r of each numeric column with ``y`` on pairwise non-NULL rows.

    ONE aggregate over all columns (no shuffle beyond a single row). Written as
    covar_pop / (stddev_pop x stddev_pop), NULL for a constant column instead of the
    divide-by-zero error ``corr`` raises under ANSI mode.
    """
    if not cols:
        raise ValueError("numeric_drivers needs at least one column")
    aggs = []
    yv = F.col(y).cast("double")
    for c in cols:
        xv = F.col(c).cast("double")
        both = xv.isNotNull() & yv.isNotNull()
        aggs += [F.covar_pop(F.when(both, xv), F.when(both, yv)).alias(f"cov_{c}"),
                 F.stddev_pop(F.when(both, xv)).alias(f"sx_{c}"),
                 F.stddev_pop(F.when(both, yv)).alias(f"sy_{c}"),
                 F.count(F.when(both, F.lit(1))).alias(f"n_{c}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("col_ord"),
                     safe_div(F.col(f"cov_{c}"), F.nullif(F.col(f"sx_{c}") * F.col(f"sy_{c}"),
                                                          F.lit(0.0))).alias("r"),
                     F.col(f"n_{c}").alias("n_pairs"))
            for i, c in enumerate(cols)]
    return (wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
            .where(F.col("r").isNotNull() & ~F.isnan("r"))
            .withColumn("abs_r", F.abs("r")))


def numeric_drivers_top(drivers: DataFrame, min_abs_r: float = NUMERIC_DRIVER_MIN_ABS_R,
                        top: int = NUMERIC_DRIVER_TOP) -> DataFrame:
    """|r| >= threshold, strongest first (earlier column on ties), at most ``top`` rows."""
    w = Window.orderBy(F.desc("abs_r"), F.asc("col_ord"))
    ranked = drivers.where(F.col("abs_r") >= min_abs_r) \
        .withColumn("driver_rank", F.row_number().over(w).cast("int"))
    return ranked.where(F.col("driver_rank") <= top) \
        .withColumn("anonymised", F.col("col_name").rlike("(?i)^v[0-9]+$"))


# --- A3 as an operator ------------------------------------------------------------------
def with_confidence(df: DataFrame, n_col: str = "n") -> DataFrame:
    return df.withColumn("confidence", confidence_tier(n_col))


def confidence_rich(drivers: DataFrame, profile: DataFrame, min_spread: float = 0.01,
                    strong_spread: float = 0.05, max_missing_pct: float = 5.0) -> DataFrame:
    """Confidence from sample size, effect size and data quality together.

    high: smallest segment >= 500 rows, spread >= ``strong_spread`` and <= ``max_missing_pct``%
    missing; low: smallest segment < 30, spread < ``min_spread`` or > 20% missing; else medium.
    The profile has one row per column, so the join input is tiny (broadcast).
    """
    p = profile.select("col_name", "missing_pct")
    j = drivers.join(F.broadcast(p), "col_name", "left")
    miss = F.coalesce(F.col("missing_pct"), F.lit(0.0))
    conf = (F.when((F.col("min_n") < MIN_GROUP) | (F.col("spread") < min_spread) | (miss > 20.0), F.lit("low"))
            .when((F.col("min_n") >= 500) & (F.col("spread") >= strong_spread) & (miss <= max_missing_pct),
                  F.lit("high")).otherwise(F.lit("medium")))
    return j.withColumn("confidence_rich", conf)
