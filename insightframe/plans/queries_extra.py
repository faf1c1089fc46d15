"""Registered queries for the items the analysed system's spec promises."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import outcome as oc
from ..operators import profile as pf
from ..operators import rootcause as rc
from . import basetables as bt
from .queries_outcome import LI_FACT_COLS, LI_DIM_COLS, LI_SEG_COLS, LI_STAR_SQL, _seg_sql
from .registry import register


@register("describe_column", oracle="""
SELECT 'l_extendedprice' AS col_name, COUNT(l_extendedprice) AS count, ROUND(AVG(l_extendedprice), 4) AS mean,
  ROUND(stddev_samp(l_extendedprice), 4) AS std, MIN(l_extendedprice) AS min,
  ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS p25, ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  ROUND(quantile_cont(l_extendedprice, 0.75), 4) AS p75, MAX(l_extendedprice) AS max FROM lineitem""")
def q_describe_column(spark, sf_dir):
    """Quick statistics of one column."""
    d = pf.describe_column(bt.read_table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return d.select("col_name", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@register("price_volume", oracle=f"""
WITH star AS ({LI_STAR_SQL}),
g AS (SELECT r_name AS segment,
        SUM(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1999) AS rev_a,
        SUM(l_extendedprice) FILTER (WHERE year(l_shipdate) = 2000) AS rev_b,
        SUM(l_quantity) FILTER (WHERE year(l_shipdate) = 1999) AS vol_a,
        SUM(l_quantity) FILTER (WHERE year(l_shipdate) = 2000) AS vol_b FROM star WHERE r_name IS NOT NULL GROUP BY 1)
SELECT segment, ROUND(rev_a, 4) AS rev_a, ROUND(rev_b, 4) AS rev_b, ROUND(rev_b - rev_a, 4) AS rev_change,
  ROUND((vol_b - vol_a) * (rev_a / vol_a), 4) AS volume_effect,
  ROUND((rev_b / vol_b - rev_a / vol_a) * vol_a, 4) AS price_effect,
  ROUND((vol_b - vol_a) * (rev_b / vol_b - rev_a / vol_a), 4) AS interaction FROM g""")
def q_price_volume(spark, sf_dir):
    """Revenue change 1999 -> 2000 by region split into volume, price and interaction."""
    # the two years as a range on the raw column: pushed to the Parquet scan (row-group skipping);
    # rows outside it would contribute nothing to either period
    star = bt.lineitem_star(spark, sf_dir).where(
        (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")))
    yr = F.year("l_shipdate")
    period = F.when(yr == 1999, F.lit("a")).when(yr == 2000, F.lit("b"))
    pv = rc.price_volume(star, period, "r_name", "l_extendedprice", "l_quantity")
    return pv.select("segment", *[F.round(c, 4).alias(c) for c in
                                  ("rev_a", "rev_b", "rev_change", "volume_effect", "price_effect", "interaction")])


@register("confidence_rich", oracle=f"""
WITH seg AS ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}),
per AS (SELECT col_name, MIN(n) AS min_n, MAX(rate) - MIN(rate) AS spread FROM seg GROUP BY 1 HAVING COUNT(*) >= 2)
SELECT col_name, min_n, ROUND(spread, 6) AS spread,
  CASE WHEN min_n < 30 OR spread < 0.01 THEN 'low'
       WHEN min_n >= 500 AND spread >= 0.05 THEN 'high' ELSE 'medium' END AS confidence_rich FROM per""")
def q_confidence_rich(spark, sf_dir):
    """Driver confidence from group size, effect size and missingness (0% here)."""
    segs = oc.star_segment_rates(bt.lineitem_events(spark, sf_dir), "l_orderkey", LI_FACT_COLS,
                                 bt.order_dims(spark, sf_dir), "o_orderkey", LI_DIM_COLS)
    d = oc.categorical_drivers(segs)
    prof = pf.basic_stats(bt.lineitem_star(spark, sf_dir).select(*LI_SEG_COLS))
    r = oc.confidence_rich(d, prof)
    return r.select("col_name", "min_n", rnd(F.col("spread")).alias("spread"), "confidence_rich")
