"""Rate/mix root-cause decomposition.

The two periods come from one CASE on the time column against the median cut point, which
arrives as a scalar subquery (no join). Per-segment period counts are one conditional
aggregate, so the whole decomposition is: one pass for the cut point, one partial-aggregated
group-by per segment value, then arithmetic over a table with one row per segment value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import MIN_GROUP, safe_div
from ..functions.quantiles import exact_quantiles


def _micros(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ / DATE / TIMESTAMP value without depending on the
    session time zone for wall-clock (NTZ) values."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")),
                      F.unix_micros(ts.cast("timestamp")))


def median_cutoff(df: DataFrame, time_col: str) -> Column:
    """The median of the time column in epoch microseconds as a literal (linear
    interpolation, exact at any size; NULL for a column without values)."""
    cut = exact_quantiles(df, {"t": _micros(F.col(time_col))}, [0.5])["t"][0]
    return F.lit(cut).cast("double")


def with_period(df: DataFrame, time_col: str, cutoff: Column) -> DataFrame:
    """Period 'a' (<= cut point, historical) or 'b' (> cut point, recent)."""
    return df.withColumn("period", F.when(_micros(F.col(time_col)).cast("double") <= cutoff, F.lit("a"))
                         .otherwise(F.lit("b")))


def rate_mix(df: DataFrame, time_col: str, seg: str, y: str = "y",
             min_rows: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """Returns (summary one-row DataFrame, per-segment contributions).

    Δ = rate_b − rate_a over ALL rows; rate effect Σ wa(rb − ra); mix effect Σ (wb − wa) ra over
    segments present in both periods; interaction is the residual. Weights are shares among
    non-NULL segments of each period. The summary is empty when a period has < ``min_rows``.
    """
    base = df.where(F.col(time_col).isNotNull() & F.col(y).isNotNull())
    cut = median_cutoff(base, time_col)
    p = with_period(base, time_col, cut)
    a, b = F.col("period") == "a", F.col("period") == "b"
    # ONE conditional aggregate per segment value; the NULL segment is kept as its own group so
    # the period totals (all rows) and the weights (non-NULL segments) both come from it
    seg_all = (p.groupBy(F.col(seg).cast("string").alias("segment"))
               .agg(F.count_if(a).alias("n_a"), F.sum(F.when(a, F.col(y))).cast("double").alias("pos_a"),
                    F.count_if(b).alias("n_b"), F.sum(F.when(b, F.col(y))).cast("double").alias("pos_b")))
    return _decompose(seg_all, cut, seg, min_rows)


def star_rate_mix(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, time_col: str, seg: str, y: str = "y",
                  min_rows: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """A15, A16 over a star: the results of :func:`rate_mix` where every fact row has its ``dim`` row.

    The fact rows are reduced to one row per key with the counts of both periods first, so that one
    row per key enters the join instead of one per fact row. Facts without a ``dim`` row count in
    the totals, in no segment. ``dim`` has one row per key.
    """
    base = fact.where(F.col(time_col).isNotNull() & F.col(y).isNotNull())
    cut = median_cutoff(base, time_col)
    a, b = F.col("period") == "a", F.col("period") == "b"
    per = with_period(base, time_col, cut).groupBy(key).agg(
        F.count_if(a).alias("n_a"), F.sum(F.when(a, F.col(y))).cast("double").alias("pos_a"),
        F.count_if(b).alias("n_b"), F.sum(F.when(b, F.col(y))).cast("double").alias("pos_b"))
    named = dim.select(F.col(dim_key).alias("_key"), F.col(seg).cast("string").alias("segment"))
    joined = per.join(named, F.col(key) == F.col("_key"), "left")
    seg_all = joined.groupBy("segment").agg(*[F.sum(c).alias(c) for c in ("n_a", "pos_a", "n_b", "pos_b")])
    return _decompose(seg_all, cut, seg, min_rows)


def _decompose(seg_all: DataFrame, cut: Column, seg: str, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Shared arithmetic: (segment, n_a, pos_a, n_b, pos_b) incl. a NULL segment -> summary and
    per-segment contributions."""
    tot = seg_all.agg(F.struct(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"),
        F.coalesce(F.sum("pos_a"), F.lit(0.0)).alias("pos_a"),
        F.coalesce(F.sum("pos_b"), F.lit(0.0)).alias("pos_b")).alias("s")).scalar()
    segs = seg_all.where(F.col("segment").isNotNull())
    wsum = segs.agg(F.struct(F.sum("n_a").alias("na"), F.sum("n_b").alias("nb")).alias("s")).scalar()
    contrib = (segs.withColumn("_w", wsum)
               .withColumn("wa", safe_div(F.col("n_a").cast("double"), F.col("_w.na").cast("double")))
               .withColumn("wb", safe_div(F.col("n_b").cast("double"), F.col("_w.nb").cast("double")))
               .drop("_w")
               .withColumn("ra", safe_div(F.col("pos_a"), F.col("n_a").cast("double")))
               .withColumn("rb", safe_div(F.col("pos_b"), F.col("n_b").cast("double")))
               .withColumn("in_both", (F.col("n_a") > 0) & (F.col("n_b") > 0))
               .withColumn("rate_part", F.when(F.col("in_both"), F.col("wa") * (F.col("rb") - F.col("ra"))))
               .withColumn("mix_part", F.when(F.col("in_both"), (F.col("wb") - F.col("wa")) * F.col("ra")))
               .withColumn("contribution", F.col("rate_part") + F.col("mix_part")))
    # largest |contribution| (smaller segment on ties) as an aggregate, not a global window
    agg = contrib.agg(
        F.sum("rate_part").alias("rate_effect"), F.sum("mix_part").alias("mix_effect"),
        F.min_by("segment", F.when(F.col("in_both"), F.struct(-F.abs("contribution"), F.col("segment"))))
        .alias("top_segment"),
        F.sum(F.when(~F.col("in_both"), F.col("n_a") + F.col("n_b"))).alias("_unmatched"))
    # per-segment table for display: rank within the (one row per value) contributions
    w = Window.orderBy(F.desc(F.abs("contribution")), F.asc("segment"))
    ranked = contrib.withColumn(
        "contrib_rank", F.when(F.col("in_both"), F.row_number().over(w)).cast("int"))
    agg = agg.withColumn("_tot", tot).withColumn("_cut", cut)
    tot = F.col("_tot")
    rate_a = safe_div(tot["pos_a"], tot["n_a"].cast("double"))
    rate_b = safe_div(tot["pos_b"], tot["n_b"].cast("double"))
    summary = (agg.select(
        F.lit(seg).alias("segment_col"),
        F.timestamp_micros(F.floor(F.col("_cut")).cast("bigint")).alias("cutoff"),
        tot["n_a"].alias("n_a"), tot["n_b"].alias("n_b"), rate_a.alias("rate_a"), rate_b.alias("rate_b"),
        (rate_b - rate_a).alias("delta"),
        F.coalesce("rate_effect", F.lit(0.0)).alias("rate_effect"),
        F.coalesce("mix_effect", F.lit(0.0)).alias("mix_effect"), "top_segment",
        safe_div(F.coalesce("_unmatched", F.lit(0)).cast("double"),
                 (tot["n_a"] + tot["n_b"]).cast("double")).alias("unmatched_share"))
        .withColumn("interaction", F.col("delta") - F.col("rate_effect") - F.col("mix_effect"))
        .withColumn("dominant", F.when(F.abs("rate_effect") >= F.abs("mix_effect"), F.lit("rate"))
                    .otherwise(F.lit("mix")))
        .where((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows)))
    return summary, ranked


def rate_mix_joined(df: DataFrame, time_col: str, seg: str, y: str = "y") -> DataFrame:
    """J1 cross-check: the same effects from an inner join of the per-period segment tables."""
    base = df.where(F.col(time_col).isNotNull() & F.col(y).isNotNull())
    p = with_period(base, time_col, median_cutoff(base, time_col))

    def side(tag: str) -> DataFrame:
        s = p.where((F.col("period") == tag) & F.col(seg).isNotNull()) \
            .groupBy(F.col(seg).cast("string").alias("segment")) \
            .agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.avg(F.col(y).cast("double")).alias(f"r{tag}"))
        tot = s.agg(F.sum(f"n_{tag}")).scalar()
        return s.withColumn(f"w{tag}", F.col(f"n_{tag}") / tot)

    j = side("a").join(side("b"), "segment", "inner")
    return j.agg(F.sum(F.col("wa") * (F.col("rb") - F.col("ra"))).alias("rate_effect"),
                 F.sum((F.col("wb") - F.col("wa")) * F.col("ra")).alias("mix_effect"),
                 F.count(F.lit(1)).alias("n_segments"))


def segment_intersect(df: DataFrame, time_col: str, seg: str) -> DataFrame:
    """Segment values present in both periods (INTERSECT)."""
    base = df.where(F.col(time_col).isNotNull())
    p = with_period(base, time_col, median_cutoff(base, time_col))
    a = p.where((F.col("period") == "a") & F.col(seg).isNotNull()).select(F.col(seg).cast("string").alias("segment"))
    b = p.where((F.col("period") == "b") & F.col(seg).isNotNull()).select(F.col(seg).cast("string").alias("segment"))
    return a.intersect(b)


def price_volume(df: DataFrame, period: Column, seg: str, revenue: str, volume: str,
                 a: str = "a", b: str = "b") -> DataFrame:
    """Revenue change between periods ``a`` and ``b`` per segment split into
    volume effect (dQ * P_a), price effect (dP * Q_a) and interaction (dQ * dP); one
    conditional aggregate per segment, so one shuffle of (segment) keys."""
    pa, pb = period == a, period == b
    g = (df.where(F.col(seg).isNotNull()).groupBy(F.col(seg).cast("string").alias("segment"))
         .agg(F.sum(F.when(pa, F.col(revenue))).alias("rev_a"), F.sum(F.when(pb, F.col(revenue))).alias("rev_b"),
              F.sum(F.when(pa, F.col(volume))).alias("vol_a"), F.sum(F.when(pb, F.col(volume))).alias("vol_b")))
    price_a = safe_div(F.col("rev_a"), F.col("vol_a"))
    price_b = safe_div(F.col("rev_b"), F.col("vol_b"))
    dq = F.col("vol_b") - F.col("vol_a")
    dp = price_b - price_a
    return g.select("segment", "rev_a", "rev_b", (F.col("rev_b") - F.col("rev_a")).alias("rev_change"),
                    (dq * price_a).alias("volume_effect"), (dp * F.col("vol_a")).alias("price_effect"),
                    (dq * dp).alias("interaction"))
