"""Registered queries: findings, guardrails, report tables, text/question and ad-hoc operators.

The lineitem analysis (event = returned line, time = ship date, segments = line and star
columns) feeds the findings; the report tables are derived from those findings.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import adhoc as ah
from ..operators import artifacts as ar
from ..operators import outcome as oc
from ..operators import rootcause as rc
from ..operators import series as sr
from ..operators import textops as tx
from ..session import settled
from . import basetables as bt
from .queries_outcome import LI_FACT_COLS, LI_DIM_COLS, LI_SEG_COLS, LI_STAR_SQL, _seg_sql
from .queries_series import LI_SERIES_SQL
from .registry import register

TARGET = "l_returnflag"
POSITIVE = "R"


# ---- the lineitem analysis as findings -------------------------------------------------------
def li_findings(spark, sf_dir, series=None):
    """The findings; ``series``: the monthly rates, if they are at hand."""
    li = bt.lineitem_events(spark, sf_dir)
    f0 = ar.finding_overall_rate(oc.overall_rate(li), TARGET, POSITIVE, 0)
    segs = oc.star_segment_rates(li, "l_orderkey", LI_FACT_COLS, bt.order_dims(spark, sf_dir),
                                 "o_orderkey", LI_DIM_COLS)
    f1 = ar.finding_categorical_driver(oc.top_driver(segs), TARGET, 1)
    n_rows = li.agg(F.count(F.lit(1))).scalar()
    num = oc.numeric_drivers_top(oc.numeric_drivers(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    f2 = ar.finding_numeric_drivers(num, TARGET, n_rows, 2)
    f3 = ar.finding_trend(sr.trend_direction(sr.period_rates(li, "l_shipdate") if series is None else series), TARGET, 3)
    # A8 on rows with a time value, through the pre-aggregated star plan (no line-level join)
    timed = li.where(F.col("l_shipdate").isNotNull())
    best = oc.categorical_drivers(oc.star_segment_rates(
        timed, "l_orderkey", LI_FACT_COLS, bt.order_dims(spark, sf_dir), "o_orderkey", LI_DIM_COLS),
        require_positive_spread=True).where("driver_rank = 1").select("col_name").first()
    parts = [f0, f1, f2, f3]
    if best is not None:
        # a line's own column needs no join; an order's enters with one row per order
        if best.col_name in LI_FACT_COLS:
            summary, _ = rc.rate_mix(li, "l_shipdate", best.col_name)
        else:
            summary, _ = rc.star_rate_mix(li, "l_orderkey", bt.order_dims(spark, sf_dir), "o_orderkey", "l_shipdate", best.col_name)
        parts.append(ar.finding_rate_mix(summary, TARGET, 4))
    return ar.union_findings(parts)


_PCT = "printf('%.{p}f', ({x}) * 100) || '%'"
_SPCT = "printf('%+.{p}f', ({x}) * 100) || '%'"


def _pct(x, p):
    return _PCT.format(p=p, x=x)


def _spct(x, p):
    return _SPCT.format(p=p, x=x)


_BEST_SEG_SQL = f"""
best_seg AS (
  SELECT col_name FROM ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}) GROUP BY col_name, col_ord
  HAVING COUNT(*) >= 2 AND MAX(rate) - MIN(rate) > 0 ORDER BY MAX(rate) - MIN(rate) DESC, col_ord LIMIT 1)"""

_LONG_P = " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS segment, y, l_shipdate FROM star" for c in LI_SEG_COLS)

FINDINGS_SQL = LI_SERIES_SQL + f""",
star AS ({LI_STAR_SQL}),
ov AS (SELECT COUNT(*) AS n, SUM(y) AS pos, SUM(y)::DOUBLE / COUNT(*) AS rate FROM base),
seg AS ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}),
per AS (SELECT col_name, col_ord, MIN(rate) AS lo, MAX(rate) AS hi, MIN(n) AS min_n,
               first(value ORDER BY rate DESC, value DESC) AS top_value
        FROM seg GROUP BY 1, 2 HAVING COUNT(*) >= 2),
top AS (SELECT * FROM per ORDER BY hi - lo DESC, col_ord LIMIT 1),
tr AS (SELECT COUNT(*) AS points, MIN(period) AS p0, MAX(period) AS p1, arg_min(rate, period) AS r0,
              arg_max(rate, period) AS r1 FROM s HAVING COUNT(*) >= 3),
{_BEST_SEG_SQL},
lp AS (SELECT l.* FROM ({_LONG_P}) l JOIN best_seg b ON l.col_name = b.col_name),
cut AS (SELECT quantile_cont(epoch_us(l_shipdate)::DOUBLE, 0.5) AS c FROM star WHERE l_shipdate IS NOT NULL),
pp AS (SELECT lp.*, CASE WHEN epoch_us(l_shipdate)::DOUBLE <= cut.c THEN 'a' ELSE 'b' END AS period FROM lp, cut),
tot AS (SELECT SUM(y) FILTER (WHERE period = 'a')::DOUBLE / COUNT(*) FILTER (WHERE period = 'a') AS ra,
               SUM(y) FILTER (WHERE period = 'b')::DOUBLE / COUNT(*) FILTER (WHERE period = 'b') AS rb FROM pp),
sg AS (SELECT segment, COUNT(*) FILTER (WHERE period = 'a') AS n_a, SUM(y) FILTER (WHERE period = 'a')::DOUBLE AS pos_a,
              COUNT(*) FILTER (WHERE period = 'b') AS n_b, SUM(y) FILTER (WHERE period = 'b')::DOUBLE AS pos_b
       FROM pp WHERE segment IS NOT NULL GROUP BY 1),
ws AS (SELECT SUM(n_a) AS na, SUM(n_b) AS nb FROM sg),
c AS (SELECT segment, n_a::DOUBLE / na AS wa, n_b::DOUBLE / nb AS wb, pos_a / n_a AS ra, pos_b / n_b AS rb
      FROM sg, ws WHERE n_a > 0 AND n_b > 0),
c2 AS (SELECT *, wa * (rb - ra) + (wb - wa) * ra AS contrib FROM c),
rm AS (SELECT (SELECT col_name FROM best_seg) AS seg_col, tot.ra AS rate_a, tot.rb AS rate_b, tot.rb - tot.ra AS delta,
              (SELECT SUM(wa * (rb - ra)) FROM c2) AS re, (SELECT SUM((wb - wa) * ra) FROM c2) AS me,
              (SELECT segment FROM c2 ORDER BY abs(contrib) DESC, segment LIMIT 1) AS top_seg FROM tot),
findings AS (
  SELECT 0 AS ord, 'Overall {TARGET} rate is ' || {_pct('rate', 2)} || ' (positive class = {POSITIVE}) across ' ||
         format('{{:,}}', n) || ' records (' || format('{{:,}}', pos) || ' positive cases).' AS claim,
         CASE WHEN n >= 500 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS confidence,
         'mean of binary target' AS method,
         ['Pooled rate hides segment variation (see driver breakdown).'] AS limitations FROM ov
  UNION ALL
  SELECT 1, '''' || col_name || ''' is the strongest categorical driver of {TARGET}: rate ranges ' || {_pct('lo', 1)} ||
         '-' || {_pct('hi', 1)} || ' (highest for ' || col_name || '=' || top_value || ' at ' || {_pct('hi', 1)} || ').',
         CASE WHEN min_n >= 500 THEN 'high' WHEN min_n >= 30 THEN 'medium' ELSE 'low' END,
         'group-by mean of target with min group size filter',
         ['Association, not proven causation.', 'Confounding with other variables not yet controlled.'] FROM top
  UNION ALL
  SELECT 3, '{ar.title(TARGET)} rate is ' || CASE WHEN r1 > r0 THEN 'rising' ELSE 'falling' END || ' over time: ' ||
         {_pct('r0', 1)} || ' -> ' || {_pct('r1', 1)} || ' from ' || strftime(p0, '%b %Y') || ' to ' ||
         strftime(p1, '%b %Y') || '.', 'medium', 'monthly resample of target mean',
         ['Trend is descriptive; no seasonality adjustment yet.', 'Recent months may have immature outcomes (right-censoring).'] FROM tr
  UNION ALL
  SELECT 4, '{ar.title(TARGET)} rate moved ' || {_spct('delta', 1)} || ' (' || {_pct('rate_a', 1)} || '→' ||
         {_pct('rate_b', 1)} || ') from the earlier to the recent period. Decomposing by ''' || seg_col ||
         ''': within-segment rate change contributes ' || {_spct('re', 1)} || ' and mix shift ' || {_spct('me', 1)} ||
         ' (interaction ' || {_spct('delta - re - me', 1)} || ') — i.e. the move is driven mainly by ' ||
         CASE WHEN abs(re) >= abs(me) THEN 'within-segment rate deterioration'
              ELSE 'a shift in portfolio mix toward riskier segments' END ||
         CASE WHEN top_seg IS NOT NULL THEN ', concentrated in ' || seg_col || '=' || top_seg || '.' ELSE '.' END,
         'medium', 'rate/mix decomposition by ''' || seg_col || ''', historical vs recent split at the time median',
         ['Attribution, NOT proven causation — confounders are uncontrolled.',
          'Recent-period outcomes may be immature (right-censoring), biasing the change.',
          'Two-period split is coarse; sensitive to the cut point.'] FROM rm),
rollup AS (SELECT CASE WHEN COUNT(*) = 0 THEN 'low'
                       WHEN COUNT(*) FILTER (WHERE confidence = 'low') > 0 THEN
                         CASE WHEN COUNT(*) FILTER (WHERE confidence = 'high') >= COUNT(*) FILTER (WHERE confidence = 'low')
                              THEN 'medium' ELSE 'low' END
                       WHEN COUNT(*) FILTER (WHERE confidence = 'high') >= 2 THEN 'high' ELSE 'medium' END AS overall,
                  COUNT(*) AS n, COUNT(*) FILTER (WHERE confidence = 'high') AS n_high,
                  COUNT(*) FILTER (WHERE confidence = 'low') AS n_low FROM findings),
rules AS (
  SELECT 0 AS ord, 'Independent recompute confirms the headline {TARGET} rate (' || {_pct('rate', 2)} || ').' AS rule FROM ov
  UNION ALL SELECT 2, 'At least one forecast does not beat a naive baseline — present projections as low-confidence.'
            FROM bt WHERE NOT beats_naive
  UNION ALL SELECT 3, 'Forecasts assume a linear trend and may be biased by right-censoring.'
  UNION ALL SELECT 4, 'Recent-period outcomes may be immature; do not over-read recent moves.'
  UNION ALL SELECT 5, 'Do NOT use overclaiming words: ''production-ready'', ''guaranteed'', ''proven'', ''certain'', ''always'', ''will definitely'', ''100% accurate'', ''risk-free'', ''foolproof''. Use calibrated language tied to the evidence.'
  UNION ALL SELECT 6, 'State overall confidence as at most ''' || overall || '''.' FROM rollup)
"""


@register("findings", oracle=FINDINGS_SQL + "SELECT ord, claim, confidence, method FROM findings")
def q_findings(spark, sf_dir):
    """The ordered findings of the lineitem analysis (claim text, confidence, method)."""
    return li_findings(spark, sf_dir).select("ord", "claim", "confidence", "method")


def _rules(spark, sf_dir):
    li = bt.lineitem_events(spark, sf_dir)
    f = li_findings(spark, sf_dir)
    rec = ar.recompute_check(li.select("y"), f, TARGET)
    roll = ar.confidence_rollup(f)
    s = sr.period_rates(li, "l_shipdate")
    proj = sr.projections(sr.forecast(s), sr.backtest_metrics(sr.walk_forward(s)), f"{TARGET} rate")
    return f, ar.guardrails(spark, rec, roll, False, proj, True), roll


@register("guardrails", oracle=FINDINGS_SQL + "SELECT CAST(ord AS INTEGER) AS ord, rule FROM rules")
def q_guardrails(spark, sf_dir):
    """Ordered rule rows for the lineitem briefing (no model in this run)."""
    return _rules(spark, sf_dir)[1]


@register("confidence_rollup", oracle=FINDINGS_SQL + "SELECT n, n_high, n_low, overall AS overall_confidence FROM rollup")
def q_confidence_rollup(spark, sf_dir):
    return ar.confidence_rollup(li_findings(spark, sf_dir))


@register("recompute_check", oracle=FINDINGS_SQL + """
SELECT ROUND(rate, 6) AS recomputed, ROUND(ROUND(rate, 5), 6) AS reported,
  CASE WHEN abs(rate - ROUND(rate, 5)) > 0.005 THEN 'disagrees' ELSE 'confirmed' END AS status FROM ov""")
def q_recompute_check(spark, sf_dir):
    """Independent recompute from a pruned scan against the reported headline."""
    li = bt.read_table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    r = ar.recompute_check(li, li_findings(spark, sf_dir), TARGET)
    return r.select(rnd(F.col("recomputed")).alias("recomputed"), rnd(F.col("reported")).alias("reported"), "status")


@register("limitations_list", oracle=FINDINGS_SQL + """,
lims AS (SELECT DISTINCT unnest(limitations) AS text FROM findings),
a AS (SELECT row_number() OVER (ORDER BY text) AS ord, text FROM lims)
SELECT CAST(ord AS INTEGER) AS ord, text FROM a
UNION ALL SELECT CAST((SELECT COUNT(*) FROM a) + row_number() OVER (ORDER BY ord) AS INTEGER), rule FROM rules""")
def q_limitations_list(spark, sf_dir):
    """Distinct sorted limitations followed by the guardrails."""
    f, rules, _ = _rules(spark, sf_dir)
    return ar.limitations_list(li_findings(spark, sf_dir), rules)


@register("kpis", oracle=FINDINGS_SQL + f"""
SELECT 0 AS ord, 'Records analyzed' AS label, format('{{:,}}', n) AS value FROM ov
UNION ALL SELECT 1, 'Outcome rate', {_pct('ROUND(rate, 5)', 2)} FROM ov
UNION ALL SELECT 3, 'Overall confidence', upper(overall[1]) || overall[2:] FROM rollup""")
def q_kpis(spark, sf_dir):
    """KPI cards (records, headline rate, overall confidence)."""
    li = bt.lineitem_events(spark, sf_dir)
    f = li_findings(spark, sf_dir)
    n = li.agg(F.count(F.lit(1)).alias("n_rows"))
    return ar.kpis(n, f, ar.confidence_rollup(f), "Outcome")


@register("bluf_summary", oracle=FINDINGS_SQL + """
SELECT 'Executive summary (BLUF): ' || (SELECT claim FROM findings ORDER BY ord LIMIT 1) || ' ' ||
       COALESCE((SELECT string_agg(claim, ' ' ORDER BY ord) FROM findings WHERE ord > (SELECT MIN(ord) FROM findings)), '') ||
       ' Overall confidence: ' || (SELECT overall FROM rollup) || '.' AS summary""")
def q_bluf_summary(spark, sf_dir):
    """Bottom-line-up-front summary from the ordered claims."""
    f = li_findings(spark, sf_dir)
    return ar.bluf_summary(f, ar.confidence_rollup(f))


_LI_PROFILE_COLS = [("l_orderkey", "bigint", True, False), ("l_partkey", "bigint", True, False),
                    ("l_suppkey", "bigint", True, False), ("l_linenumber", "int", True, False),
                    ("l_quantity", "double", True, True), ("l_extendedprice", "double", True, True),
                    ("l_discount", "double", True, True), ("l_tax", "double", True, True),
                    ("l_returnflag", "string", False, False), ("l_linestatus", "string", False, False),
                    ("l_shipdate", "timestamp_ntz", False, False)]
_NL = "chr(10)"


def _context_sql() -> str:
    from .queries_profile import _FLAGS_SQL, _profile_sql
    prof = _profile_sql("SELECT * FROM lineitem", _LI_PROFILE_COLS, base="pb", prof="lprof", with_kw=False)
    named = "lower(col_name) IN ('default','target','label','y','churn','fraud')"
    return FINDINGS_SQL + f""", {prof},
fl AS (SELECT col_ord, col_name, n_rows, n_unique, {_FLAGS_SQL.replace("concat_ws(',',", "concat_ws(', ',")} AS f FROM lprof),
tc AS (SELECT COUNT(l_shipdate) > 0 AND MIN(year(l_shipdate)) >= 1990 AND MAX(year(l_shipdate)) <= 2100 AS ok FROM lineitem),
ds AS (SELECT format('{{:,}}', MAX(n_rows)) || ' rows x ' || COUNT(*) || ' columns. ' ||
         COALESCE('Quality flags -> ' || string_agg(CASE WHEN f <> '' THEN col_name || ': ' || f END, '; ' ORDER BY col_ord) || '. ',
                  'No major quality flags. ') ||
         CASE WHEN (SELECT ok FROM tc) THEN 'Detected time column: l_shipdate. ' ELSE '' END ||
         COALESCE('Likely target(s): ' || string_agg(CASE WHEN {named} OR n_unique = 2 THEN col_name END, ', '
                  ORDER BY CASE WHEN {named} THEN 0 ELSE 1 END, col_ord) || '.', '') AS txt FROM fl)
SELECT '## DATASET' || {_NL} || ds.txt || {_NL} || {_NL} || '## FINDINGS' || {_NL} ||
  (SELECT string_agg('- ' || claim || ' (confidence: ' || confidence || '; method: ' || method || ')', {_NL} ORDER BY ord) FROM findings)
  || {_NL} || {_NL} || '## PROJECTIONS' || {_NL} ||
  (SELECT string_agg('- {TARGET} rate (' || strftime(period, '%b %Y') || '): ' || CAST(ROUND(point, 4) AS VARCHAR) || ' [' ||
          CAST(ROUND(lower, 4) AS VARCHAR) || ', ' || CAST(ROUND(upper, 4) AS VARCHAR) || ']', {_NL} ORDER BY step) FROM fc2)
  AS context FROM ds"""


@register("context_digest", oracle=_context_sql())
def q_context_digest(spark, sf_dir):
    """Grounded context (dataset summary, findings, projections) as one text."""
    from ..operators import profile as pf
    from ..operators import roles as rl
    li = bt.read_table(spark, sf_dir, "lineitem")
    prof = settled(pf.profile_columns(li))  # a row per column
    tcol = [r.col_name for r in rl.time_column_scan(li).where("chosen").collect()]
    cands = [r.col_name for r in rl.target_candidates(prof).orderBy("cand_ord").collect()]
    qs = pf.quality_summary(prof, tcol[0] if tcol else None, cands)
    s = settled(sr.period_rates(bt.lineitem_events(spark, sf_dir), "l_shipdate"))  # a row per month
    proj = sr.projections(sr.forecast(s), sr.backtest_metrics(sr.walk_forward(s)), f"{TARGET} rate")
    return ar.context_digest(qs, li_findings(spark, sf_dir, s), proj)


@register("chart_driver", oracle=f"""
WITH seg AS ({_seg_sql(LI_STAR_SQL, LI_SEG_COLS)}),
per AS (SELECT col_name, col_ord, MAX(rate) - MIN(rate) AS spread FROM seg GROUP BY 1, 2 HAVING COUNT(*) >= 2),
best AS (SELECT col_name FROM per ORDER BY spread DESC, col_ord LIMIT 1)
SELECT 'driver_' || s.col_name AS chart_id, CAST(row_number() OVER (ORDER BY s.rate DESC, s.value) - 1 AS INTEGER) AS ord,
       s.value AS x, ROUND(s.rate * 100, 1) AS y FROM seg s JOIN best b ON s.col_name = b.col_name""")
def q_chart_driver(spark, sf_dir):
    segs = oc.star_segment_rates(bt.lineitem_events(spark, sf_dir), "l_orderkey", LI_FACT_COLS,
                                 bt.order_dims(spark, sf_dir), "o_orderkey", LI_DIM_COLS)
    return ar.chart_driver(oc.top_driver(segs))


@register("chart_trend", oracle=LI_SERIES_SQL + """
SELECT 'trend_over_time' AS chart_id, t AS ord, strftime(period, '%Y-%m-%d') AS x, ROUND(rate * 100, 2) AS y FROM ti""")
def q_chart_trend(spark, sf_dir):
    return ar.chart_trend(sr.period_rates(bt.lineitem_events(spark, sf_dir), "l_shipdate"))


# ---- text operators over documents / conversations -------------------------------------------
# The documents are prose, so stand-in responses give the operators something to read: every
# line of every document, marked up by key arithmetic as list items, headings or plain lines,
# whole texts inside fences or JSON, and banned phrases behind texts. Nothing of the operators'
# own work is done here.
def responses(spark, sf_dir):
    docs = bt.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    number = lambda i: (i % 9 + 1).cast("string")

    def mark(x, i):
        m = (F.col("doc_id") + i) % 8
        return (F.when(m == 0, F.concat(F.lit("- "), x)).when(m == 1, F.concat(F.lit("* **"), x, F.lit("**")))
                .when(m == 2, F.concat(F.lit("\u2022 "), x)).when(m == 3, F.concat(number(i), F.lit(". "), x))
                .when(m == 4, F.concat(number(i), F.lit(") "), x)).when(m == 5, F.concat(F.lit("# "), x))
                .when(m == 6, F.concat(F.lit("- "), x, F.lit(":"))).otherwise(x))

    marked = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 == 4, F.col("text")).otherwise(marked).alias("text"))


_MARK = """CASE (doc_id + i - 1) % 8 WHEN 0 THEN '- ' || x WHEN 1 THEN '* **' || x || '**' WHEN 2 THEN '• ' || x
  WHEN 3 THEN ((i - 1) % 9 + 1)::VARCHAR || '. ' || x WHEN 4 THEN ((i - 1) % 9 + 1)::VARCHAR || ') ' || x
  WHEN 5 THEN '# ' || x WHEN 6 THEN '- ' || x || ':' ELSE x END"""
_RESPONSES_SQL = f"""responses AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN text ELSE
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_MARK}), chr(10)) END AS text FROM documents)"""


def fenced_responses(spark, sf_dir):
    """Every third document inside a python fence, every other third inside a bare one."""
    text = F.col("text")
    return bt.read_table(spark, sf_dir, "documents").select("doc_id", F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("Code:\n```python\n"), text, F.lit("\n```\nand ```more```")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n "), text, F.lit(" ```"))).otherwise(text).alias("text"))


_FENCED_SQL = """responses AS (SELECT doc_id, CASE doc_id % 3
  WHEN 0 THEN 'Code:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and ```more```'
  WHEN 1 THEN '```' || chr(10) || ' ' || text || ' ```' ELSE text END AS text FROM documents)"""


def json_responses(spark, sf_dir):
    """Whole texts as the claim of a JSON object inside prose; some without a claim, some cut short,
    some plain."""
    d = bt.read_table(spark, sf_dir, "documents")
    conf = F.element_at(F.array(*[F.lit(c) for c in ("HIGH", "low", "certain", "medium")]), (F.floor(F.col("doc_id") / 5) % 4 + 1).cast("int"))
    limits = F.transform(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 5 + 1), lambda i: F.concat(F.lit("limit "), i.cast("string")))
    full = F.to_json(F.struct(F.col("text").alias("claim"), conf.alias("confidence"), F.col("source").alias("method"), limits.alias("limitations")))
    kind = F.col("doc_id") % 5
    return d.select("doc_id", F.when(kind == 0, F.concat(F.lit("Result: "), full, F.lit(" end.")))
                    .when(kind == 1, full).when(kind == 2, F.to_json(F.struct(F.col("text").alias("note"))))
                    .when(kind == 3, F.concat(F.lit("{"), full)).otherwise(F.col("text")).alias("text"))


def boasting_responses(spark, sf_dir):
    """Texts with a banned phrase (or two) behind them for ten documents of thirteen."""
    n = (F.col("doc_id") % 13).cast("int")
    phrases = F.array(*[F.lit(p.upper() if i % 2 else p) for i, p in enumerate(ar.OVERCLAIM_PHRASES)])
    tail = F.when(n < 9, F.concat(F.lit(" It is "), F.get(phrases, n))).when(n == 9, F.lit(" always PROVEN")).otherwise("")
    return bt.read_table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


_RE_SPLIT = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_RE_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_RE_WS}+|{_RE_WS}+$', '', 'g')"


_LINES_SQL = f"""
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS raw
          FROM (SELECT doc_id, regexp_split_to_array(text, '{_RE_SPLIT}') AS parts FROM responses)),
st AS (SELECT doc_id, line_no, {_strip_sql('raw')} AS s FROM lines),
it AS (SELECT doc_id, line_no,
         CASE WHEN left(s, 1) IN ('-', '*', '•') THEN {_strip_sql("regexp_replace(s, '^[-*• ]+', '')")}
              WHEN regexp_matches(left(s, 1), '^[0-9]$') AND length(s) > 2 AND substr(s, 2, 1) IN (')', '.')
              THEN {_strip_sql('substr(s, 3)')} END AS item0, s FROM st),
it2 AS (SELECT doc_id, line_no, {_strip_sql("regexp_replace(item0, '^[*]+|[*]+$', '', 'g')")} AS item, s FROM it),
items AS (SELECT doc_id, line_no, item FROM it2
          WHERE length(s) > 0 AND NOT starts_with(s, '#') AND item IS NOT NULL AND length(item) > 0 AND NOT ends_with(item, ':'))"""


@register("bullet_items", oracle=f"""
WITH {_RESPONSES_SQL},
{_LINES_SQL.strip()},
ls AS (SELECT doc_id, COUNT(*) FILTER (WHERE length(s) > 0) AS n_nonblank FROM st GROUP BY 1)
SELECT d.doc_id, ls.n_nonblank, (SELECT COUNT(*) FROM items i WHERE i.doc_id = d.doc_id) AS n_items
FROM responses d JOIN ls ON d.doc_id = ls.doc_id""")
def q_bullet_items(spark, sf_dir):
    """T1 over every document: non-blank lines and extracted list items per document."""
    docs = responses(spark, sf_dir)
    items = tx.bullet_items(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    stats = tx.line_stats(docs, "doc_id", "text")
    return stats.join(items, "doc_id", "left").select(
        "doc_id", F.col("n_nonblank").cast("bigint").alias("n_nonblank"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"))


@register("plan_rows", oracle=f"""
WITH {_RESPONSES_SQL},
{_LINES_SQL.strip()},
ranked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS step_ord, item FROM items),
plan AS (SELECT doc_id, step_ord, item AS step, false AS is_default FROM ranked WHERE step_ord <= 5),
dflt(step_ord, step) AS (VALUES (1, '{tx.DEFAULT_PLAN[0]}'), (2, '{tx.DEFAULT_PLAN[1]}'), (3, '{tx.DEFAULT_PLAN[2]}'), (4, '{tx.DEFAULT_PLAN[3]}'))
SELECT * FROM plan
UNION ALL SELECT d.doc_id, dflt.step_ord, dflt.step, true FROM responses d, dflt
WHERE d.doc_id NOT IN (SELECT doc_id FROM plan)""")
def q_plan_rows(spark, sf_dir):
    """Up to five plan steps per document, the default plan where none are found."""
    docs = responses(spark, sf_dir)
    return tx.plan_rows(docs, "doc_id", "text")


@register("fenced_block", oracle=f"""
WITH {_FENCED_SQL}, f AS (SELECT doc_id, regexp_matches(text, '(?s)```(?:python)?\\s*(.*?)```') AS has_fence,
                  CASE WHEN regexp_matches(text, '(?s)```(?:python)?\\s*(.*?)```')
                       THEN regexp_extract(text, '(?s)```(?:python)?\\s*(.*?)```', 1) ELSE text END AS body FROM responses)
SELECT doc_id, has_fence, length({_strip_sql('body')}) AS code_chars, md5({_strip_sql('body')}) AS code_md5 FROM f""")
def q_fenced_block(spark, sf_dir):
    """T3 over whole documents: the fenced body, else the stripped text (length + digest)."""
    docs = fenced_responses(spark, sf_dir)
    f = tx.fenced_block(docs, "text")
    return f.select("doc_id", "has_fence", F.length("code").alias("code_chars"), F.md5("code").alias("code_md5"))


@register("json_findings", oracle="""
SELECT doc_id, text AS claim, CASE CAST(floor(doc_id / 5) AS BIGINT) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence,
       source AS method, array_to_string(list_transform(range(1, least(doc_id % 5 + 1, 3) + 1), lambda i: 'limit ' || i), '; ') AS limitations
FROM documents WHERE doc_id % 5 < 2""")
def q_json_findings(spark, sf_dir):
    """T4 over whole responses: the first-'{' to last-'}' span as a finding, its confidence within
    the known words, at most three limitations; responses without a claim give none."""
    f = tx.json_findings(json_responses(spark, sf_dir), "text")
    return f.select("doc_id", "claim", "confidence", "method", F.array_join("limitations", "; ").alias("limitations"))


def _route_sql(has_models: bool, has_charts: bool) -> str:
    def any_(ws):
        return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
    return f"""
CASE WHEN {any_(tx.MODEL_WORDS)} THEN '{'model' if has_models else 'model_none'}'
     WHEN {any_(tx.CHART_WORDS)} THEN '{'chart' if has_charts else 'chart_none'}'
     WHEN {any_(tx.DRIVER_WORDS)} AND (SELECT COUNT(*) FROM findings WHERE contains(lower(claim), 'driver')) > 0 THEN 'driver'
     WHEN {any_(tx.TREND_WORDS)} AND (SELECT COUNT(*) FROM findings WHERE contains(lower(claim), 'over time')) > 0 THEN 'trend'
     ELSE 'lead' END"""


# stand-in questions: user turns with a closing question by key arithmetic, so that all routes occur
_ASKED = ["", " Which model won?", " Show me the chart.", " What is the strongest driver?", " How is the trend?", " Why?"]
_QUESTIONS_SQL = ("questions AS (SELECT conv_id, turn, text || ([" + ", ".join(f"'{q}'" for q in _ASKED)
                  + "])[(conv_id + turn) % 6 + 1] AS text FROM conversations WHERE role = 'user')")


def user_questions(spark, sf_dir):
    tail = F.get(F.array(*[F.lit(q) for q in _ASKED]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return bt.read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").withColumn("text", F.concat("text", tail))


def _routed(spark, sf_dir):
    conv = user_questions(spark, sf_dir)
    f = li_findings(spark, sf_dir)
    low = F.lower(F.col("claim"))
    flags = f.agg(F.max(low.contains("driver")).alias("d"), F.max(low.contains("over time")).alias("t"))
    s = flags.select(F.struct("d", "t")).scalar()
    return tx.question_routes(conv, "text", False, True, F.coalesce(s["d"], F.lit(False)),
                              F.coalesce(s["t"], F.lit(False))), f


@register("question_routes", oracle=FINDINGS_SQL + f""", {_QUESTIONS_SQL}
SELECT conv_id, turn, {_route_sql(False, True)} AS route FROM questions""")
def q_question_routes(spark, sf_dir):
    """T5 routing of every user question against the lineitem findings (charts exist, no model)."""
    r, _ = _routed(spark, sf_dir)
    return r.select("conv_id", "turn", "route")


@register("question_answers", oracle=FINDINGS_SQL + f""", {_QUESTIONS_SQL},
q AS (SELECT conv_id, turn, {_route_sql(False, True)} AS route FROM questions),
lead AS (SELECT claim, confidence FROM findings ORDER BY ord LIMIT 1),
drv AS (SELECT claim, confidence, array_to_string(limitations, '; ') AS lims FROM findings WHERE contains(lower(claim), 'driver') ORDER BY ord LIMIT 1),
trd AS (SELECT claim, confidence FROM findings WHERE contains(lower(claim), 'over time') ORDER BY ord LIMIT 1)
SELECT conv_id, turn, route, CASE route
  WHEN 'lead' THEN 'Based on the analysis: ' || (SELECT claim FROM lead) || ' (confidence: ' || (SELECT confidence FROM lead) || ')'
  WHEN 'driver' THEN (SELECT claim FROM drv) || ' (confidence: ' || (SELECT confidence FROM drv) || '). Caveat: ' || (SELECT lims FROM drv)
  WHEN 'trend' THEN (SELECT claim FROM trd) || ' (confidence: ' || (SELECT confidence FROM trd) || ')'
  WHEN 'model_none' THEN 'No model has been trained yet (Part 1 / Modeler runs in a later milestone).'
  WHEN 'chart' THEN 'Dashboard charts available.' END AS answer FROM q""")
def q_question_answers(spark, sf_dir):
    """T5 answers grounded in the findings table."""
    r, f = _routed(spark, sf_dir)
    a = tx.question_answers(r, f, None, "Dashboard charts available.")
    return a.select("conv_id", "turn", "route", "answer")


@register("chat_window", oracle="""
SELECT conv_id, turn, role, text, CAST(recent_rank AS INTEGER) AS recent_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recent_rank FROM conversations)
WHERE recent_rank <= 12""")
def q_chat_window(spark, sf_dir):
    """Last 12 turns of every conversation (two-stage, skew-safe)."""
    w = tx.chat_window(bt.read_table(spark, sf_dir, "conversations"))
    return w.select("conv_id", "turn", "role", "text", F.col("recent_rank").cast("int").alias("recent_rank"))


@register("chat_last_user", oracle="""
SELECT conv_id, MAX(turn) AS last_user_turn, arg_max(text, turn) AS last_user_text
FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def q_chat_last_user(spark, sf_dir):
    """Latest user turn per conversation."""
    return tx.chat_last_user(bt.read_table(spark, sf_dir, "conversations"))


@register("overclaim_scan", oracle="""
WITH p(phrase, i) AS (VALUES ('production-ready', 0), ('guaranteed', 1), ('proven', 2), ('certain', 3), ('always', 4),
   ('will definitely', 5), ('100% accurate', 6), ('risk-free', 7), ('foolproof', 8)),
r AS (SELECT doc_id, text || CASE WHEN doc_id % 13 < 9 THEN ' It is ' || (SELECT CASE WHEN i % 2 = 1 THEN upper(phrase) ELSE phrase END FROM p WHERE i = doc_id % 13)
        WHEN doc_id % 13 = 9 THEN ' always PROVEN' ELSE '' END AS text FROM documents),
m AS (SELECT d.doc_id, string_agg(p.phrase, ',' ORDER BY p.i) AS overclaims, COUNT(*) AS n_overclaims
      FROM r d JOIN p ON contains(lower(d.text), p.phrase) GROUP BY d.doc_id)
SELECT doc_id, CAST(n_overclaims AS INTEGER) AS n_overclaims, overclaims FROM m""")
def q_overclaim_scan(spark, sf_dir):
    """Banned overclaiming phrases found in each response (those with at least one)."""
    d = ar.overclaim_scan(boasting_responses(spark, sf_dir), "text")
    return d.where(F.col("n_overclaims") > 0).select("doc_id", "n_overclaims",
                                                     F.array_join("overclaims", ",").alias("overclaims"))


# ---- ad-hoc segment analyses -------------------------------------------------------------------
@register("segment_pair_rates", oracle=f"""
WITH star AS ({LI_STAR_SQL}), b AS (SELECT AVG(y::DOUBLE) AS r FROM star)
SELECT r_name, o_orderpriority, CAST(SUM(y) AS BIGINT) AS positives, COUNT(*) AS n,
  ROUND(SUM(y * l_extendedprice) / SUM(l_extendedprice), 6) AS value_weighted_rate,
  ROUND(SUM(y)::DOUBLE / COUNT(*), 6) AS rate, ROUND(ANY_VALUE(b.r), 6) AS overall_rate,
  ROUND(SUM(y)::DOUBLE / COUNT(*) - ANY_VALUE(b.r), 6) AS lift
FROM star, b GROUP BY 1, 2""")
def q_segment_pair_rates(spark, sf_dir):
    """H1: returns by region x priority with value-weighted rate and lift over baseline."""
    p = ah.star_segment_pair_rates(bt.lineitem_events(spark, sf_dir), "l_orderkey", bt.order_dims(spark, sf_dir),
                                   "o_orderkey", "r_name", "o_orderpriority", amount="l_extendedprice")
    return p.select("r_name", "o_orderpriority", "positives", "n",
                    *[rnd(F.col(c)).alias(c) for c in ("value_weighted_rate", "rate", "overall_rate", "lift")])


@register("bucket_rates", oracle="""
SELECT CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT AS INTEGER) AS band,
  COUNT(*) AS n, CAST(SUM(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS positives,
  ROUND(AVG(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS rate
FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1""")
def q_bucket_rates(spark, sf_dir):
    """H2: return rate by quantity band (<10, 10-20, 20-30, 30-40, >=40)."""
    b = ah.bucket_rates(bt.lineitem_events(spark, sf_dir), "l_quantity", [10, 20, 30, 40])
    return b.select("band", "n", "positives", rnd(F.col("rate")).alias("rate"))


@register("risky_segment", oracle="""
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_discount >= 0.08 AND l_quantity > 40) AS n_flagged,
  ROUND(AVG(CASE WHEN l_discount >= 0.08 AND l_quantity > 40 THEN 1.0 ELSE 0.0 END), 6) AS share,
  ROUND(AVG(CASE WHEN l_discount >= 0.08 AND l_quantity > 40 THEN CAST(l_returnflag = 'R' AS DOUBLE) END), 6) AS flagged_rate,
  ROUND(AVG(CAST(l_returnflag = 'R' AS DOUBLE)), 6) AS overall_rate FROM lineitem""")
def q_risky_segment(spark, sf_dir):
    """H3: high-discount bulk lines as a compound segment vs the overall rate."""
    r = ah.risky_segment(bt.lineitem_events(spark, sf_dir), (F.col("l_discount") >= 0.08) & (F.col("l_quantity") > 40))
    return r.select("n", "n_flagged", *[rnd(F.col(c)).alias(c) for c in ("share", "flagged_rate", "overall_rate")])


@register("segment_lift", oracle=f"""
WITH star AS ({LI_STAR_SQL}), b AS (SELECT AVG(y::DOUBLE) AS r FROM star)
SELECT c_mktsegment, l_linestatus, COUNT(*) AS n, ROUND((SUM(y)::DOUBLE / COUNT(*) - ANY_VALUE(b.r)) * 100, 6) AS lift_points
FROM star, b GROUP BY 1, 2 HAVING COUNT(*) >= 50""")
def q_segment_lift(spark, sf_dir):
    """H4: market segment x line status lift in points (n >= 50)."""
    s = ah.star_segment_lift(bt.lineitem_events(spark, sf_dir), "l_orderkey", bt.order_dims(spark, sf_dir),
                             "o_orderkey", "c_mktsegment", "l_linestatus")
    return s.select("c_mktsegment", "l_linestatus", "n", rnd(F.col("lift_points")).alias("lift_points"))


@register("sql_steps", oracle="""
SELECT 0 AS step, 1 AS attempts, 'ok' AS status, CAST(COUNT(DISTINCT l_returnflag || l_linestatus) AS BIGINT) AS n_rows FROM lineitem
UNION ALL SELECT 1, 2, 'ok', COUNT(DISTINCT l_returnflag) FROM lineitem WHERE l_discount > 0.05
UNION ALL SELECT 2, 1, 'error', -1
UNION ALL SELECT 3, 1, 'rejected', -1
UNION ALL SELECT 4, 1, 'limit', -1
UNION ALL SELECT 5, 1, 'ok', 1""")
def q_sql_steps(spark, sf_dir):
    """H5: steps over lineitem that succeed, succeed corrected, fail, are no query, run on for ever,
    and succeed after that."""
    steps = ["SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(l_discount) AS avg_discount "
             "FROM df GROUP BY l_returnflag, l_linestatus ORDER BY n DESC",
             "SELECT l_returnflag, COUNT(*) AS n FROM df WHERE l_discont > 0.05 GROUP BY l_returnflag",
             "SELECT COUNT(*) FROM no_such_table",
             "DROP TABLE df",
             "SELECT MAX(xxhash64(id)) FROM range(1000000000000000)",
             "SELECT COUNT(*) AS n FROM df"]
    done = ah.sql_steps(spark, bt.read_table(spark, sf_dir, "lineitem"), steps, max_steps=len(steps), limit_seconds=10)
    return done.select("step", "attempts", "status", F.coalesce("n_rows", F.lit(-1)).alias("n_rows"))
