"""Column-expression helpers shared by every operator.

Everything here builds native Spark expressions (no Python UDFs), so the work stays inside
whole-stage code generation. Where an oracle query needs the same formula, the SQL text is
produced by the same function so both sides cannot drift apart.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the analysed behaviour (thresholds, word lists).
# ---------------------------------------------------------------------------------------
MIN_GROUP = 30                 # minimum rows for a segment to count
HIGH_CONFIDENCE_N = 500        # n at or above which a finding is "high" confidence
IMBALANCE_LOW, IMBALANCE_HIGH = 0.05, 0.95
HIGH_MISSING_SHARE = 0.20
OUTLIER_IQR_MULT = 3.0
OUTLIER_SHARE = 0.01
OUTLIER_MIN_NONNULL = 10
CATEGORICAL_MAX_DISTINCT = 8
FEATURE_STRING_MAX_DISTINCT = 50
NUMERIC_DRIVER_MIN_ABS_R = 0.02
NUMERIC_DRIVER_TOP = 6
FORECAST_HORIZON = 3
FORECAST_MIN_POINTS = 8
BACKTEST_MAX_POINTS = 6
RECOMPUTE_TOLERANCE = 0.005
# Column names that mark a target during detection, and the wider list used when resolving.
TARGET_DETECT_NAMES = ["default", "target", "label", "y", "churn", "fraud"]
TARGET_RESOLVE_NAMES = ["default", "target", "label", "class", "fraud", "churn", "y", "outcome"]
# Text values that mark the positive (event) class of a text-coded binary target.
POSITIVE_TOKENS = ["yes", "true", "y", "t", "1", "positive", "pos", "default", "fraud",
                   "churn", "disease", "diabetic", "spam", "attrition", "bad", "success", "win"]
# Phrases a briefing must not use.
OVERCLAIM_PHRASES = ["production-ready", "guaranteed", "proven", "certain", "always",
                     "will definitely", "100% accurate", "risk-free", "foolproof"]
# z for the one-sided 0.9 normal quantile (80% two-sided interval).
Z_090 = 1.2815515655446004


def confidence_tier(n: Column | str) -> Column:
    """high if n >= 500, medium if n >= 30, else low."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n >= HIGH_CONFIDENCE_N, F.lit("high"))
            .when(n >= MIN_GROUP, F.lit("medium")).otherwise(F.lit("low")))


def confidence_tier_sql(n: str) -> str:
    return (f"CASE WHEN {n} >= {HIGH_CONFIDENCE_N} THEN 'high' "
            f"WHEN {n} >= {MIN_GROUP} THEN 'medium' ELSE 'low' END")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(num, den)


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def rnd(x: Column, places: int = 6) -> Column:
    return F.round(x.cast("double"), places)


def id_like_name(name: str, strict_reference: bool = False) -> bool:
    """True when a column name marks an identifier.

    The analysed behaviour tests the substring "id" (which also hits "paid", "width");
    by default we test the whole token instead.
    """
    low = name.lower()
    if strict_reference:
        return "id" in low
    import re
    return re.search(r"(^|_)id(_|$)", low) is not None


def t_quantile_090(df_col: Column) -> Column:
    """Student-t 0.9 quantile for ``df_col`` degrees of freedom (Cornish-Fisher, 4 terms).

    Error is 1e-5 at 6 degrees of freedom and falls quickly above; written with built-ins so
    it stays JVM-side and the oracle can use the identical formula.
    """
    z = Z_090
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    v = df_col.cast("double")
    return (F.lit(z) + F.lit(g1) / v + F.lit(g2) / F.pow(v, 2)
            + F.lit(g3) / F.pow(v, 3) + F.lit(g4) / F.pow(v, 4))


def t_quantile_090_sql(v: str) -> str:
    z = Z_090
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    v = f"CAST({v} AS DOUBLE)"
    return (f"({z!r} + {g1!r} / {v} + {g2!r} / power({v}, 2) + {g3!r} / power({v}, 3)"
            f" + {g4!r} / power({v}, 4))")


def stable_bucket(cols: list[Column | str], n: int, seed: int = 42) -> Column:
    """Deterministic bucket in [0, n) from the row's key columns.

    MD5 of ``seed|k1|k2..`` truncated to 60 bits: stable across runs, engines and executor
    retries (unlike ``rand()`` or ``monotonically_increasing_id``), needs no shuffle, and is
    reproducible in any SQL engine that has md5 (see :func:`stable_bucket_sql`).
    """
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string")
                                  for c in cols]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n))


def stable_bucket_sql(cols: list[str], n: int, seed: int = 42) -> str:
    """DuckDB form of :func:`stable_bucket`."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"(('0x' || substr(md5({inner}), 1, 15))::BIGINT % {n})"


def stable_unit(cols: list[Column | str], seed: int = 42) -> Column:
    """Deterministic pseudo-uniform value in [0, 1) from key columns."""
    return stable_bucket(cols, 1_000_000_007, seed).cast("double") / F.lit(1_000_000_007.0)


def fixed(x: Column, places: int, sign: bool = False) -> Column:
    """Fixed-point text with correct rounding (half-even on the exact binary value, like
    Python's format and C's printf; Java's %f would round half-up), no digit grouping.
    ``sign`` adds '+' to non-negative values."""
    txt = F.regexp_replace(F.format_number(x, places), ",", "")
    if not sign:
        return txt
    return F.when(txt.startswith("-"), txt).otherwise(F.concat(F.lit("+"), txt))


def pct_text(x: Column, places: int = 2) -> Column:
    """Format a share as a percentage, e.g. 0.2522 -> '25.22%'."""
    return F.concat(fixed(x * 100, places), F.lit("%"))


def signed_pct_text(x: Column, places: int = 1) -> Column:
    return F.concat(fixed(x * 100, places, sign=True), F.lit("%"))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
