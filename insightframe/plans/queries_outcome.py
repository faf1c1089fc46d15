"""Registered queries: outcome rates, segments, drivers, ad-hoc segment analyses."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import outcome as oc
from . import basetables as bt
from .registry import long_form_sql, register

LI_FACT_COLS = ["l_linestatus", "l_linenumber"]
LI_DIM_COLS = ["c_mktsegment", "r_name", "o_orderpriority"]
LI_SEG_COLS = LI_FACT_COLS + LI_DIM_COLS

# DuckDB twin of the lineitem star base table.
LI_STAR_SQL = """
SELECT l.*, CAST(l.l_returnflag = 'R' AS INTEGER) AS y,
       o.o_orderstatus, o.o_orderpriority, o.o_orderdate, c.c_mktsegment, n.n_name, r.r_name
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def _seg_sql(base_sql: str, cols: list[str], min_n: int = 30) -> str:
    return f"""
WITH base AS ({base_sql}),
long AS ({long_form_sql('base', cols)})
SELECT col_name, col_ord, value, COUNT(y) AS n, CAST(SUM(y) AS BIGINT) AS positives,
       SUM(y)::DOUBLE / COUNT(y) AS rate
FROM long WHERE value IS NOT NULL
GROUP BY col_name, col_ord, value HAVING COUNT(y) >= {min_n}"""


def _round_seg(df):
    return df.select("col_name", "col_ord", "value", "n", "positives", rnd(F.col("rate")).alias("rate"))


# ---- segment_rates (A4, A5, L1) --------------------------------------------------------
@register("segment_rates", oracle="""
SELECT o_orderpriority AS value, COUNT(y) AS n, CAST(SUM(y) AS BIGINT) AS positives,
       ROUND(SUM(y)::DOUBLE / COUNT(y), 6) AS rate
FROM (SELECT o.o_orderpriority, CAST(l.l_returnflag = 'R' AS INTEGER) AS y
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority HAVING COUNT(y) >= 30
""")
def q_segment_rates(spark, sf_dir):
    """A4/A5: return rate by order priority. The segment lives in orders, so lines are first
    reduced to (order key, n, positives) and only those rows meet the orders table."""
    s = oc.star_segment_rates(bt.lineitem_events(spark, sf_dir), "l_orderkey", [],
                              bt.read_table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderpriority"])
    return s.select("value", "n", "positives", rnd(F.col("rate")).alias("rate")) \
        .orderBy(F.desc("rate"), F.asc("value"))                      # L1


# ---- segment_rates_all / grouping sets (A6) --------------------------------------------
_SEG_ALL_SQL = f"""
SELECT col_name, col_ord, value, n, positives, ROUND(rate, 6) AS rate
FROM ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)})
"""


@register("segment_rates_all", oracle=_SEG_ALL_SQL)
def q_segment_rates_all(spark, sf_dir):
    return _round_seg(oc.segment_rates_all(bt.lineitem_star(spark, sf_dir), LI_SEG_COLS))


@register("segment_rates_grouping_sets", oracle=_SEG_ALL_SQL)
def q_segment_rates_grouping_sets(spark, sf_dir):
    return _round_seg(oc.segment_rates_grouping_sets(bt.lineitem_star(spark, sf_dir), LI_SEG_COLS))


@register("star_segment_rates", oracle=_SEG_ALL_SQL)
def q_star_segment_rates(spark, sf_dir):
    return _round_seg(_li_star_segments(spark, sf_dir))


def _li_star_segments(spark, sf_dir):
    return oc.star_segment_rates(
        bt.lineitem_events(spark, sf_dir), "l_orderkey", LI_FACT_COLS,
        bt.order_dims(spark, sf_dir), "o_orderkey", LI_DIM_COLS)


# ---- categorical_drivers / top_driver (A7) ---------------------------------------------
_DRIVERS_SQL = f"""
WITH seg AS ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}),
per AS (
  SELECT col_name, col_ord, COUNT(*) AS n_groups, MIN(rate) AS min_rate, MAX(rate) AS max_rate,
         MIN(n) AS min_n, first(value ORDER BY rate DESC, value DESC) AS top_value
  FROM seg GROUP BY col_name, col_ord HAVING COUNT(*) >= 2)
SELECT col_name, col_ord, n_groups, ROUND(min_rate, 6) AS min_rate, ROUND(max_rate, 6) AS max_rate,
       ROUND(max_rate - min_rate, 6) AS spread, min_n, top_value,
       CAST(row_number() OVER (ORDER BY max_rate - min_rate DESC, col_ord) AS INTEGER) AS driver_rank,
       CASE WHEN min_n >= 500 THEN 'high' WHEN min_n >= 30 THEN 'medium' ELSE 'low' END AS confidence
FROM per
"""


def _drivers_out(d):
    return d.select("col_name", "col_ord", "n_groups", rnd(F.col("min_rate")).alias("min_rate"),
                    rnd(F.col("max_rate")).alias("max_rate"), rnd(F.col("spread")).alias("spread"),
                    "min_n", "top_value", "driver_rank", "confidence")


@register("categorical_drivers", oracle=_DRIVERS_SQL)
def q_categorical_drivers(spark, sf_dir):
    """Flagship: strongest categorical driver of returns over lineitem + star columns."""
    return _drivers_out(oc.categorical_drivers(_li_star_segments(spark, sf_dir)))


@register("top_driver", oracle=f"""
WITH seg AS ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}),
per AS (SELECT col_name, col_ord, MAX(rate) - MIN(rate) AS spread FROM seg
        GROUP BY col_name, col_ord HAVING COUNT(*) >= 2),
best AS (SELECT col_name FROM per ORDER BY spread DESC, col_ord LIMIT 1)
SELECT s.col_name, s.value, s.n, s.positives, ROUND(s.rate, 6) AS rate,
       CAST(row_number() OVER (ORDER BY s.rate DESC, s.value) AS INTEGER) AS seg_rank
FROM seg s JOIN best b ON s.col_name = b.col_name
""")
def q_top_driver(spark, sf_dir):
    t = oc.top_driver(_li_star_segments(spark, sf_dir))
    return t.select("col_name", "value", "n", "positives", rnd(F.col("rate")).alias("rate"), "seg_rank")


# ---- overall_rate (A1, A2, A3) ---------------------------------------------------------
@register("overall_rate", oracle="""
SELECT COUNT(*) AS n, CAST(SUM(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS positives,
       ROUND(SUM(CAST(l_returnflag = 'R' AS INTEGER))::DOUBLE / COUNT(*), 6) AS rate,
       (SUM(CAST(l_returnflag = 'R' AS INTEGER))::DOUBLE / COUNT(*) < 0.05
        OR SUM(CAST(l_returnflag = 'R' AS INTEGER))::DOUBLE / COUNT(*) > 0.95) AS imbalanced,
       CASE WHEN COUNT(*) >= 500 THEN 'high' WHEN COUNT(*) >= 30 THEN 'medium' ELSE 'low' END AS confidence
FROM lineitem
""")
def q_overall_rate(spark, sf_dir):
    r = oc.overall_rate(bt.lineitem_events(spark, sf_dir))
    return r.select("n", "positives", rnd(F.col("rate")).alias("rate"), "imbalanced", "confidence")


# ---- confidence_tier (A3) --------------------------------------------------------------
@register("confidence_tier", oracle="""
SELECT c_mktsegment, COUNT(*) AS n,
       CASE WHEN COUNT(*) >= 500 THEN 'high' WHEN COUNT(*) >= 30 THEN 'medium' ELSE 'low' END AS confidence
FROM customer GROUP BY c_mktsegment
""")
def q_confidence_tier(spark, sf_dir):
    c = bt.read_table(spark, sf_dir, "customer")
    return oc.with_confidence(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))


# ---- numeric drivers (A9, A10) ---------------------------------------------------------
LI_NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


# stand-in columns that move with the outcome, so that the threshold and the top rule have rows
LI_TIED_COLS = {"v1": "l_quantity + 40.0 * y", "V2": "l_discount - 0.05 * y", "amount": "l_extendedprice + 20000.0 * y",
                "v3": "l_discount + 0.03 * y", "bulk": "l_quantity + 5.0 * y", "w1": "l_linenumber + 1.0 * y",
                "w2": "l_linenumber - 2.0 * y"}


def _num_sql(top: bool) -> str:
    parts = []
    for i, c in enumerate([*LI_NUM_COLS, *(LI_TIED_COLS if top else [])]):
        parts.append(f"""SELECT '{c}' AS col_name, {i} AS col_ord,
  covar_pop(CAST({c} AS DOUBLE), CAST(y AS DOUBLE)) / NULLIF(stddev_pop(CAST({c} AS DOUBLE)) * stddev_pop(CAST(y AS DOUBLE)), 0) AS r,
  COUNT(*) FILTER (WHERE {c} IS NOT NULL AND y IS NOT NULL) AS n_pairs
FROM base WHERE {c} IS NOT NULL AND y IS NOT NULL""")
    body = "\nUNION ALL\n".join(parts)
    tied = "".join(f", {x} AS {c}" for c, x in LI_TIED_COLS.items()) if top else ""
    sql = f"""
WITH base AS (SELECT * REPLACE (CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS l_tax),
                     CAST(l_returnflag = 'R' AS INTEGER) AS y{tied} FROM lineitem),
d AS ({body})
"""
    if not top:
        return sql + "SELECT col_name, col_ord, ROUND(r, 6) AS r, n_pairs, ROUND(abs(r), 6) AS abs_r FROM d WHERE r IS NOT NULL"
    return sql + """, k AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(r) DESC, col_ord) AS INTEGER) AS driver_rank
FROM d WHERE r IS NOT NULL AND abs(r) >= 0.02)
SELECT col_name, col_ord, ROUND(r, 6) AS r, n_pairs, ROUND(abs(r), 6) AS abs_r, driver_rank,
       regexp_matches(col_name, '^[vV][0-9]+$') AS anonymised
FROM k WHERE driver_rank <= 6"""


def _num_base(spark, sf_dir):
    # l_tax gets NULLs injected on every 10th order key so pairwise-NULL handling is exercised
    return bt.lineitem_events(spark, sf_dir).withColumn(
        "l_tax", F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("l_tax")))


def _num_out(d, top):
    cols = ["col_name", "col_ord", rnd(F.col("r")).alias("r"), "n_pairs", rnd(F.col("abs_r")).alias("abs_r")]
    if top:
        cols += ["driver_rank", "anonymised"]
    return d.select(*cols)


@register("numeric_drivers", oracle=_num_sql(False))
def q_numeric_drivers(spark, sf_dir):
    return _num_out(oc.numeric_drivers(_num_base(spark, sf_dir), LI_NUM_COLS), False)


@register("numeric_drivers_top", oracle=_num_sql(True))
def q_numeric_drivers_top(spark, sf_dir):
    """The six strongest of the line columns and stand-ins that move with the outcome."""
    base = _num_base(spark, sf_dir).withColumns({c: F.expr(x) for c, x in LI_TIED_COLS.items()})
    d = oc.numeric_drivers(base, [*LI_NUM_COLS, *LI_TIED_COLS])
    return _num_out(oc.numeric_drivers_top(d), True)
