"""Registered queries: profiling, role resolution and sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.sketches import merge_sketches, quantile_sketches, rank_error, sketch_quantiles
from ..operators import profile as pf
from ..operators import roles as rl
from ..sources import io
from . import basetables as bt
from .registry import register

# Stand-in inputs: the driver tables hold no NULLs, so NULLs are injected by key arithmetic
# to exercise missing-value handling. The operators see ordinary tables of this schema.
ORDERS_PROFILE_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders"""
ORDERS_COLS = [("o_orderkey", "bigint", True, False), ("o_custkey", "bigint", True, False),
               ("o_orderstatus", "string", False, False), ("o_totalprice", "double", True, True),
               ("o_orderdate", "timestamp_ntz", False, False), ("o_orderpriority", "string", False, False)]
DOCS_COLS = [("doc_id", "bigint", True, False), ("text", "string", False, False),
             ("lang", "string", False, False), ("source", "string", False, False),
             ("n_chars", "bigint", True, False)]


def orders_profile_base(spark, sf_dir):
    o = bt.read_table(spark, sf_dir, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None))
                        .otherwise(F.col("o_totalprice")))


def _profile_sql(base_sql: str, cols, base: str = "base", prof: str = "prof", with_kw: bool = True) -> str:
    parts = []
    for i, (c, dt, quant, frac) in enumerate(cols):
        if quant:
            qsub = (f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM base)")
            share = (f"AVG(CASE WHEN {c} < q.q1 - 3 * (q.q3 - q.q1) OR {c} > q.q3 + 3 * (q.q3 - q.q1) "
                     f"THEN 1.0 ELSE 0.0 END)::DOUBLE")
        else:
            qsub = "(SELECT NULL::DOUBLE AS q1, NULL::DOUBLE AS q3)"
            share = "NULL::DOUBLE"
        parts.append(f"""SELECT '{c}' AS col_name, {i} AS col_ord, '{dt}' AS dtype, COUNT(*) AS n_rows,
  COUNT({c}) AS n_nonnull,
  ROUND(100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*)::DOUBLE, 2) AS missing_pct,
  COUNT(DISTINCT {c}) AS n_unique, ANY_VALUE(q.q1) AS q1, ANY_VALUE(q.q3) AS q3,
  {share} AS outlier_share, {1 if frac else 0} AS frac
FROM {base}, {qsub.replace('FROM base', 'FROM ' + base)} q""")
    head = "WITH " if with_kw else ""
    return f"{head}{base} AS ({base_sql}), {prof} AS ({' UNION ALL '.join(parts)})"


_FLAGS_SQL = """concat_ws(',',
  CASE WHEN missing_pct / 100 > 0.2 THEN 'high_missing' END,
  CASE WHEN n_unique = n_rows AND n_rows > 0 AND frac = 0 THEN 'possible_id' END,
  CASE WHEN n_unique <= 1 THEN 'constant' END,
  CASE WHEN q1 IS NOT NULL AND n_nonnull > 10 AND q3 - q1 > 0 AND outlier_share > 0.01 THEN 'outliers' END)"""


def _profile_out(p):
    return p.select("col_name", "col_ord", "dtype", "n_rows", "n_nonnull", "missing_pct", "n_unique",
                    rnd(F.col("q1")).alias("q1"), rnd(F.col("q3")).alias("q3"),
                    rnd(F.col("outlier_share")).alias("outlier_share"),
                    F.array_join("quality_flags", ",").alias("quality_flags"))


_PROFILE_SELECT = f"""SELECT col_name, col_ord, dtype, n_rows, n_nonnull, missing_pct, n_unique,
  ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(outlier_share, 6) AS outlier_share,
  {_FLAGS_SQL} AS quality_flags FROM prof"""


@register("profile_columns", oracle=_profile_sql(ORDERS_PROFILE_SQL, ORDERS_COLS) + _PROFILE_SELECT)
def q_profile_columns(spark, sf_dir):
    """C1-C9 on orders (with injected NULLs): missing %, exact distinct, quartiles, flags."""
    return _profile_out(pf.profile_columns(orders_profile_base(spark, sf_dir)))


@register("quality_flags", oracle=_profile_sql("SELECT * FROM documents", DOCS_COLS)
          + f" SELECT col_name, col_ord, {_FLAGS_SQL} AS quality_flags FROM prof")
def q_quality_flags(spark, sf_dir):
    """C4-C9 on documents: the heavy-tailed length column carries the outlier flag."""
    p = pf.profile_columns(bt.read_table(spark, sf_dir, "documents"))
    return p.select("col_name", "col_ord", F.array_join("quality_flags", ",").alias("quality_flags"))


@register("iqr_outliers", oracle=_profile_sql(
    "SELECT doc_id, n_chars FROM documents", [DOCS_COLS[0], DOCS_COLS[4]]) + """
SELECT col_name, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q3 - q1, 6) AS iqr,
       ROUND(outlier_share, 6) AS outlier_share FROM prof""")
def q_iqr_outliers(spark, sf_dir):
    d = bt.read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cols = ["doc_id", "n_chars"]
    o = pf.outlier_shares(d, pf.quartiles(d, cols))
    return o.select("col_name", rnd(F.col("q1")).alias("q1"), rnd(F.col("q3")).alias("q3"),
                    rnd(F.col("iqr")).alias("iqr"), rnd(F.col("outlier_share")).alias("outlier_share"))


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("distinct_counts", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, COUNT(DISTINCT {c}) AS n_unique FROM lineitem" for c in LI_COLS))
def q_distinct_counts(spark, sf_dir):
    """C3 exact over every lineitem column via the value-count cube."""
    return pf.exact_distinct_counts(bt.read_table(spark, sf_dir, "lineitem"))


@register("distinct_counts_approx")
def q_distinct_counts_approx(spark, sf_dir):
    """C3 HLL estimate (same pass as the missing counts); rows-only check."""
    return pf.basic_stats(bt.read_table(spark, sf_dir, "lineitem")) \
        .select("col_name", "col_ord", "approx_distinct")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quartiles", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, {i} AS col_ord, ROUND(quantile_cont({c}, 0.25), 6) AS q1, "
    f"ROUND(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem" for i, c in enumerate(LI_NUM)))
def q_quartiles(spark, sf_dir):
    """C7 exact (linear interpolation) for every column whose distinct count is bounded."""
    li = bt.read_table(spark, sf_dir, "lineitem")
    q = pf.quartiles(li, LI_NUM)
    return q.select("col_name", "col_ord", rnd(F.col("q1")).alias("q1"), rnd(F.col("q3")).alias("q3"))


@register("quartiles_approx", oracle=" UNION ALL ".join(
    f"SELECT coalesce(l_returnflag, 'all') AS segment, '{c}' AS col_name, {i} AS col_ord, COUNT({c}) AS n, "
    f"TRUE AS q1_in_bracket, TRUE AS q3_in_bracket FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ROLLUP (l_returnflag)"
    for i, c in enumerate(LI_NUM)))
def q_quartiles_approx(spark, sf_dir):
    """C7 by mergeable sketches: one sketch per column and return flag, merged over the flags.

    The brackets are checked on the rows: a quartile is in its bracket where the exact quantiles at
    its rank less and plus twice the stated error enclose it.
    """
    li = bt.read_table(spark, sf_dir, "lineitem").where("l_returnflag is not null")
    parts = quantile_sketches(li, {c: F.col(c) for c in LI_NUM}, ["l_returnflag"])
    probs = {"q1": 0.25, "q3": 0.75}
    found = sketch_quantiles(parts.withColumnRenamed("l_returnflag", "segment").unionByName(
        merge_sketches(parts).withColumn("segment", F.lit("all"))), probs)
    # ranks of the answers, from one aggregate over the rows of every segment
    rows = li.select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("segment"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("x")) for c in LI_NUM])).alias("r"))
    error = F.lit(2 * rank_error())
    ranks = rows.select("segment", "r.*").join(F.broadcast(found), ["segment", "col_name"]).groupBy("segment", "col_name", "col_ord", "n").agg(
        *[F.count_if(F.col("x") < F.col(q)).alias(f"{q}_lo") for q in probs], *[F.count_if(F.col("x") <= F.col(q)).alias(f"{q}_hi") for q in probs])
    return ranks.select("segment", "col_name", "col_ord", "n", *[
        ((F.col(f"{q}_lo") <= (F.lit(p) + error) * F.col("n")) & (F.col(f"{q}_hi") >= (F.lit(p) - error) * F.col("n"))).alias(f"{q}_in_bracket")
        for q, p in probs.items()])


@register("value_shares", oracle="""
SELECT o_orderpriority AS value, COUNT(*) AS n, ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_value_shares(spark, sf_dir):
    v = pf.value_counts(bt.read_table(spark, sf_dir, "orders"), "o_orderpriority")
    return v.select("value", "n", rnd(F.col("share")).alias("share"))


@register("quality_summary", oracle=_profile_sql(ORDERS_PROFILE_SQL, ORDERS_COLS) + f"""
, fl AS (SELECT col_ord, col_name, {_FLAGS_SQL.replace("concat_ws(',',", "concat_ws(', ',")} AS f, n_rows FROM prof)
SELECT MAX(n_rows) AS n_rows, COUNT(*) AS n_cols,
  format('{{:,}}', MAX(n_rows)) || ' rows x ' || COUNT(*) || ' columns. ' ||
  COALESCE('Quality flags -> ' || string_agg(CASE WHEN f <> '' THEN col_name || ': ' || f END, '; ' ORDER BY col_ord) || '. ',
           'No major quality flags. ') ||
  'Detected time column: o_orderdate. ' AS quality_summary
FROM fl""")
def q_quality_summary(spark, sf_dir):
    """C10 for orders; the time column comes from the P6 scan."""
    base = orders_profile_base(spark, sf_dir)
    prof = pf.profile_columns(base)
    tcol = [r.col_name for r in rl.time_column_scan(base).where("chosen").collect()]
    cands = [r.col_name for r in rl.target_candidates(prof).orderBy("cand_ord").collect()]
    return pf.quality_summary(prof, tcol[0] if tcol else None, cands)


# Public column descriptions (TPC-H specification wording), the user-supplied dictionary.
ORDERS_DICTIONARY = [("O_ORDERKEY", "order key"), ("o_custkey", "customer key"),
                     ("o_orderstatus", "order status"), ("o_totalprice", "total price"),
                     ("o_orderdate", "order date")]


@register("column_dictionary", oracle="""
WITH d(name, meaning) AS (VALUES ('O_ORDERKEY', 'order key'), ('o_custkey', 'customer key'),
  ('o_orderstatus', 'order status'), ('o_totalprice', 'total price'), ('o_orderdate', 'order date')),
p AS (SELECT 'o_orderkey' AS col_name, 0 AS col_ord, COUNT(DISTINCT o_orderkey) AS n_unique FROM orders
  UNION ALL SELECT 'o_custkey', 1, COUNT(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 2, COUNT(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'o_totalprice', 3, COUNT(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', 4, COUNT(DISTINCT o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', 5, COUNT(DISTINCT o_orderpriority) FROM orders)
SELECT p.col_name, p.col_ord, p.n_unique, COALESCE(trim(d.meaning), '') AS inferred_meaning
FROM p LEFT JOIN d ON lower(p.col_name) = lower(trim(d.name))""")
def q_column_dictionary(spark, sf_dir):
    prof = pf.profile_columns(bt.read_table(spark, sf_dir, "orders"))
    d = spark.createDataFrame(ORDERS_DICTIONARY, "name string, meaning string")
    return pf.column_dictionary(prof, d).select("col_name", "col_ord", "n_unique", "inferred_meaning")


# ---- P6 time-column scan ----------------------------------------------------------------
TIME_SCAN_SQL = """SELECT o_orderkey AS elapsed_time, o_orderdate,
  CASE WHEN o_orderkey % 1000 = 7 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ship_date_text,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date_text FROM orders"""


def time_scan_base(spark, sf_dir):
    o = bt.read_table(spark, sf_dir, "orders")
    txt = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("elapsed_time"), "o_orderdate",
                    F.when(F.col("o_orderkey") % 1000 == 7, F.lit("not a date")).otherwise(txt)
                    .alias("ship_date_text"), txt.alias("order_date_text"))


@register("time_column_scan", oracle=f"""
WITH base AS ({TIME_SCAN_SQL}),
s AS (
 SELECT 'elapsed_time' AS col_name, 0 AS col_ord, COUNT(elapsed_time) AS n_values, 0::BIGINT AS n_failed,
   CAST(MIN(year(make_timestamp(CAST(floor(elapsed_time / 1000) AS BIGINT)))) AS INTEGER) AS min_year,
   CAST(MAX(year(make_timestamp(CAST(floor(elapsed_time / 1000) AS BIGINT)))) AS INTEGER) AS max_year FROM base
 UNION ALL SELECT 'o_orderdate', 1, COUNT(o_orderdate), 0, CAST(MIN(year(o_orderdate)) AS INTEGER),
   CAST(MAX(year(o_orderdate)) AS INTEGER) FROM base
 UNION ALL SELECT 'ship_date_text', 2, COUNT(ship_date_text),
   COUNT(*) FILTER (WHERE ship_date_text IS NOT NULL AND try_strptime(ship_date_text, '%Y-%m-%d') IS NULL),
   CAST(MIN(year(try_strptime(ship_date_text, '%Y-%m-%d'))) AS INTEGER),
   CAST(MAX(year(try_strptime(ship_date_text, '%Y-%m-%d'))) AS INTEGER) FROM base
 UNION ALL SELECT 'order_date_text', 3, COUNT(order_date_text),
   COUNT(*) FILTER (WHERE order_date_text IS NOT NULL AND try_strptime(order_date_text, '%Y-%m-%d') IS NULL),
   CAST(MIN(year(try_strptime(order_date_text, '%Y-%m-%d'))) AS INTEGER),
   CAST(MAX(year(try_strptime(order_date_text, '%Y-%m-%d'))) AS INTEGER) FROM base),
t AS (SELECT *, COALESCE(n_failed = 0 AND n_values > 0 AND min_year >= 1990 AND max_year <= 2100, false) AS is_time FROM s)
SELECT *, COALESCE(col_ord = (SELECT MIN(col_ord) FROM t WHERE is_time), false) AS chosen FROM t""")
def q_time_column_scan(spark, sf_dir):
    return rl.time_column_scan(time_scan_base(spark, sf_dir))


@register("coerce_dates", oracle=f"""
WITH base AS ({TIME_SCAN_SQL})
SELECT COUNT(*) AS n_rows, COUNT(try_strptime(ship_date_text, '%Y-%m-%d')) AS n_parsed,
       COUNT(*) - COUNT(try_strptime(ship_date_text, '%Y-%m-%d')) AS n_null,
       strftime(MIN(try_strptime(ship_date_text, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS min_ts,
       strftime(MAX(try_strptime(ship_date_text, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS max_ts
FROM base""")
def q_coerce_dates(spark, sf_dir):
    d = rl.coerce_dates(time_scan_base(spark, sf_dir), "ship_date_text", "parsed")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("parsed").alias("n_parsed"),
                 (F.count(F.lit(1)) - F.count("parsed")).alias("n_null"),
                 F.date_format(F.min("parsed"), "yyyy-MM-dd HH:mm:ss").alias("min_ts"),
                 F.date_format(F.max("parsed"), "yyyy-MM-dd HH:mm:ss").alias("max_ts"))


@register("date_autoparse", oracle=f"""
WITH base AS ({TIME_SCAN_SQL})
SELECT 'ship_date_text' AS col_name, 0 AS col_ord, COUNT(ship_date_text) AS n_values,
  COUNT(*) FILTER (WHERE ship_date_text IS NOT NULL AND try_strptime(ship_date_text, '%Y-%m-%d') IS NULL) AS n_failed
FROM base
UNION ALL SELECT 'order_date_text', 1, COUNT(order_date_text),
  COUNT(*) FILTER (WHERE order_date_text IS NOT NULL AND try_strptime(order_date_text, '%Y-%m-%d') IS NULL) FROM base""")
def q_date_autoparse(spark, sf_dir):
    """Which "date" text columns would be adopted as timestamps."""
    base = time_scan_base(spark, sf_dir).select("ship_date_text", "order_date_text")
    return io.date_autoparse_report(base).select("col_name", "col_ord", "n_values", "n_failed")


# ---- P3 target candidates, P1 encodings ------------------------------------------------
@register("target_candidates", oracle="""
WITH p AS (SELECT 'doc_id' AS col_name, 0 AS col_ord, COUNT(DISTINCT doc_id) AS n_unique FROM labels
  UNION ALL SELECT 'quality', 1, COUNT(DISTINCT quality) FROM labels
  UNION ALL SELECT 'toxic', 2, COUNT(DISTINCT toxic) FROM labels)
SELECT col_name, CAST(row_number() OVER (ORDER BY CASE WHEN lower(col_name) IN
  ('default','target','label','y','churn','fraud') THEN 0 ELSE 1 END, col_ord) AS INTEGER) AS cand_ord,
  CASE WHEN lower(col_name) IN ('default','target','label','y','churn','fraud') THEN 'named' ELSE 'binary' END AS reason
FROM p WHERE n_unique = 2 OR lower(col_name) IN ('default','target','label','y','churn','fraud')""")
def q_target_candidates(spark, sf_dir):
    prof = pf.profile_columns(bt.read_table(spark, sf_dir, "labels"))
    return rl.target_candidates(prof)


def _encoding_out(df, col):
    lab = rl.positive_label(df, col)
    stats = rl.encode_binary(df, col).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives")).alias("s")).scalar()
    return lab.select("all01", "positive", "rule", stats["n"].alias("n"),
                      stats["positives"].alias("positives"))


@register("encode_binary_minority", oracle="""
WITH c AS (SELECT o_orderstatus AS v, COUNT(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
pos AS (SELECT v FROM c ORDER BY n, v LIMIT 1)
SELECT false AS all01, (SELECT v FROM pos) AS positive, 'minority' AS rule, COUNT(*) AS n,
  CAST(SUM(CASE WHEN o_orderstatus = (SELECT v FROM pos) THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM orders""")
def q_encode_binary_minority(spark, sf_dir):
    """P1 rule (c): no event token among F/O/P, so the rarest status is the event."""
    return _encoding_out(bt.read_table(spark, sf_dir, "orders"), "o_orderstatus")


@register("encode_binary_token", oracle="""
WITH b AS (SELECT CASE WHEN o_orderkey % 7 = 3 THEN NULL WHEN o_orderstatus = 'F' THEN ' Yes' ELSE 'No' END AS churn FROM orders)
SELECT false AS all01, ' Yes' AS positive, 'token' AS rule, COUNT(*) AS n,
  CAST(SUM(CASE WHEN churn = ' Yes' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM b""")
def q_encode_binary_token(spark, sf_dir):
    """P1 rule (b): a text-coded churn flag (with NULLs); ' Yes' matches the token list."""
    o = bt.read_table(spark, sf_dir, "orders")
    churn = (F.when(F.col("o_orderkey") % 7 == 3, F.lit(None))
             .when(F.col("o_orderstatus") == "F", F.lit(" Yes")).otherwise(F.lit("No")))
    return _encoding_out(o.select(churn.alias("churn")), "churn")


@register("encode_binary_zero_one", oracle="""
SELECT true AS all01, '1' AS positive, 'zero_one' AS rule, COUNT(*) AS n,
  CAST(SUM(COALESCE(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END, 0)) AS BIGINT) AS positives FROM labels""")
def q_encode_binary_zero_one(spark, sf_dir):
    """P1 rule (a): a 0/1 column with NULLs, NULL counted as 0."""
    lab = bt.read_table(spark, sf_dir, "labels")
    t = lab.select(F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("toxic")).alias("toxic"))
    return _encoding_out(t, "toxic")


@register("drop_null_target", oracle="""
SELECT COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives FROM (
  SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_returnflag = 'R' AS INTEGER) END AS y,
         l_shipdate FROM lineitem) WHERE y IS NOT NULL AND l_shipdate IS NOT NULL""")
def q_drop_null_target(spark, sf_dir):
    """Rows with a NULL target or NULL time are dropped before modelling."""
    li = bt.lineitem_events(spark, sf_dir).withColumn(
        "y", F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("y")))
    d = rl.drop_null(li, ["y", "l_shipdate"])
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"))


@register("feature_columns", oracle="""
WITH p AS (SELECT 'o_orderkey' AS col_name, 0 AS col_ord, 'bigint' AS dtype, COUNT(DISTINCT o_orderkey) = COUNT(*) AS is_id, COUNT(DISTINCT o_orderkey) AS n_unique FROM orders
  UNION ALL SELECT 'o_custkey', 1, 'bigint', COUNT(DISTINCT o_custkey) = COUNT(*), COUNT(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 2, 'string', false, COUNT(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'o_totalprice', 3, 'double', false, COUNT(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', 4, 'timestamp_ntz', COUNT(DISTINCT o_orderdate) = COUNT(*), COUNT(DISTINCT o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', 5, 'string', COUNT(DISTINCT o_orderpriority) = COUNT(*), COUNT(DISTINCT o_orderpriority) FROM orders)
SELECT col_name, col_ord, CASE WHEN dtype IN ('string','date','timestamp','timestamp_ntz') THEN 'categorical' ELSE 'numeric' END AS kind
FROM p WHERE col_name <> 'o_orderstatus' AND NOT is_id AND lower(col_name) <> 'id' AND NOT lower(col_name) LIKE '%\\_id' ESCAPE '\\'
  AND col_name <> 'o_orderdate' AND dtype NOT IN ('date','timestamp','timestamp_ntz')
  AND NOT (dtype = 'string' AND n_unique > 50)""")
def q_feature_columns(spark, sf_dir):
    """Model features for target o_orderstatus with time column o_orderdate."""
    prof = pf.profile_columns(bt.read_table(spark, sf_dir, "orders"))
    return rl.feature_columns(prof, "o_orderstatus", "o_orderdate")


@register("task_types", oracle=" UNION ALL ".join(
    f"""SELECT '{c}' AS col_name, {i} AS col_ord, COUNT(DISTINCT {c}) AS n_unique,
  CASE WHEN COUNT(DISTINCT {c}) = 2 THEN 'binary_classification'
       WHEN {'true' if dt in ('string', 'timestamp_ntz') else 'false'} OR COUNT(DISTINCT {c}) <= 10 THEN 'multiclass_classification'
       ELSE 'regression' END AS task_type FROM lineitem"""
    for i, (c, dt) in enumerate([("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")])))
def q_task_types(spark, sf_dir):
    """M1: the task each lineitem column would pose as a target."""
    prof = pf.profile_columns(bt.read_table(spark, sf_dir, "lineitem"))
    return rl.task_types(prof)


@register("pruned_rate", oracle="""
SELECT COUNT(*) AS n, ROUND(AVG(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS rate FROM lineitem""")
def q_pruned_rate(spark, sf_dir):
    """S3: the recompute path reads only the target column (ReadSchema has one field)."""
    col = io.select_pruned(bt.read_table(spark, sf_dir, "lineitem"), ["l_returnflag"])
    enc = col.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return enc.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("y")).alias("rate"))
