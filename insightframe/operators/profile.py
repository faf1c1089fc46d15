"""Column profiling.

Pass 1 is one wide aggregate: row count, per-column non-NULL count and HLL distinct count.
Exact distinct counts come from one shuffle of fixed-width digests per distinct (column, value)
pair. Quartiles are exact at any size (``functions.quantiles``).
The outlier share is a second single-row aggregate that
reads its fences from a scalar subquery (no join).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (HIGH_MISSING_SHARE, OUTLIER_IQR_MULT, OUTLIER_MIN_NONNULL,
                                 OUTLIER_SHARE, quoted, safe_div)
from ..functions.quantiles import exact_quantiles
from ..functions.sketches import SKETCH_K, quantile_sketches, sketch_quantiles


@dataclass(frozen=True)
class ColumnKind:
    name: str
    ord: int
    dtype: str
    numeric: bool
    fractional: bool
    boolean: bool
    string: bool
    temporal: bool


def column_kinds(df: DataFrame) -> list[ColumnKind]:
    """Type classes straight from the schema (no job)."""
    out = []
    for i, f in enumerate(df.schema.fields):
        t = f.dataType
        frac = isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))
        integral = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        boolean = isinstance(t, T.BooleanType)
        out.append(ColumnKind(
            f.name, i, t.simpleString(), numeric=frac or integral or boolean, fractional=frac,
            boolean=boolean, string=isinstance(t, T.StringType),
            temporal=isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))))
    return out


def _long(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def basic_stats(df: DataFrame) -> DataFrame:
    """C1, C2 + HLL: (col_name, col_ord, dtype, n_rows, n_nonnull, missing_pct, approx_distinct)."""
    kinds = column_kinds(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for k in kinds:
        aggs += [F.count(F.col(quoted(k.name))).alias(f"nn_{k.ord}"),
                 F.approx_count_distinct(F.col(quoted(k.name))).alias(f"hll_{k.ord}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(k.name).alias("col_name"), F.lit(k.ord).alias("col_ord"),
                     F.lit(k.dtype).alias("dtype"), F.col("__n").alias("n_rows"),
                     F.col(f"nn_{k.ord}").alias("n_nonnull"),
                     F.col(f"hll_{k.ord}").alias("approx_distinct")) for k in kinds]
    return _long(wide, rows).withColumn(
        "missing_pct",
        F.round(F.coalesce(safe_div((F.col("n_rows") - F.col("n_nonnull")).cast("double") * 100,
                                    F.col("n_rows").cast("double")), F.lit(0.0)), 2))


def exact_distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C3 exact: (col_name, n_unique), NULLs excluded.

    Every value goes as a column number and a 128-bit digest, so the one shuffle carries 24 bytes
    per distinct (column, value) pair however wide the values are, and values that repeat
    within a task are combined before it.
    """
    cols = cols if cols is not None else df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, n_unique bigint")
    pairs = F.array(*[F.when(F.col(quoted(c)).isNotNull(), F.struct(
        F.lit(i).alias("i"), F.xxhash64(F.lit(1), F.col(quoted(c))).alias("h"), F.xxhash64(F.lit(2), F.col(quoted(c))).alias("g")))
        for i, c in enumerate(cols)])
    distinct = df.select(F.explode(pairs).alias("p")).where(F.col("p").isNotNull()).select("p.*").distinct()
    counted = distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique"))
    # columns with no non-NULL value still need a row
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, col_name string")
    return names.join(counted, "i", "left") \
        .select("col_name", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """C11: (value, n, share) with NULL excluded from the denominator."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def quantile_columns(df: DataFrame) -> list[str]:
    """Numeric, non-boolean columns (booleans skip the quartile/outlier step)."""
    return [k.name for k in column_kinds(df) if k.numeric and not k.boolean]


def quartiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_name, col_ord, q1, q3), exact with linear interpolation at any size."""
    q = exact_quantiles(df, {c: F.col(quoted(c)) for c in cols}, [0.25, 0.75])
    return df.sparkSession.createDataFrame([(c, i, *q[c]) for i, c in enumerate(cols)],
                                           "col_name string, col_ord int, q1 double, q3 double")


def quartiles_sketched(df: DataFrame, cols: list[str], group: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """C7 for interactive use: (group.., col_name, col_ord, n, q1, q3) in one scan, each quartile's
    rank within ``rank_error(k)`` of the exact one (see ``functions/sketches.py``)."""
    sketches = quantile_sketches(df, {c: F.col(quoted(c)) for c in cols}, group, k)
    return sketch_quantiles(sketches, {"q1": 0.25, "q3": 0.75})


def outlier_shares(df: DataFrame, quarts: DataFrame) -> DataFrame:
    """Share of ALL rows strictly outside [Q1 - 3 IQR, Q3 + 3 IQR], per column.

    Fences come in through a scalar subquery (a one-row struct), so the full table is read
    once with no join.
    """
    names = [f.name for f in df.schema.fields]
    q = quarts.select("col_name", "col_ord", "q1", "q3")
    # one-row map column_name -> (q1, q3), read by every row through a scalar subquery
    fences = q.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("col_name"), F.struct(F.col("q1"), F.col("q3"))))).alias("m")).scalar()
    # bind the scalar once as a column so every comparison reads the same value
    withf = df.select(fences.alias("_fences"), *[F.col(quoted(c)) for c in names])
    aggs = []
    qcols = names
    for i, c in enumerate(qcols):
        fq = F.col("_fences")[F.lit(c)]
        iqr = fq["q3"] - fq["q1"]
        lo = fq["q1"] - F.lit(OUTLIER_IQR_MULT) * iqr
        hi = fq["q3"] + F.lit(OUTLIER_IQR_MULT) * iqr
        x = F.col(quoted(c)).cast("double")
        aggs.append(F.avg(F.when((x < lo) | (x > hi), F.lit(1.0)).otherwise(F.lit(0.0)))
                    .alias(f"o_{i}"))
    wide = withf.agg(*aggs)
    long = _long(wide, [F.struct(F.lit(c).alias("col_name"), F.col(f"o_{i}").alias("outlier_share"))
                        for i, c in enumerate(qcols)])
    return q.join(long, "col_name").withColumn("iqr", F.col("q3") - F.col("q1"))


def profile_columns(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """One row per column with missing %, distinct count, quartiles, outlier
    share and the ordered quality-flag array (high_missing, possible_id, constant, outliers).

    ``exact_distinct=False`` takes the HLL estimates of the first pass for distinct counts.
    """
    kinds = {k.name: k for k in column_kinds(df)}
    stats = basic_stats(df)
    if exact_distinct:
        prof = stats.join(exact_distinct_counts(df), "col_name", "left")
    else:
        prof = stats.withColumn("n_unique", F.col("approx_distinct"))
    qcols = quantile_columns(df)
    if qcols:
        sub = df.select(*[F.col(quoted(c)) for c in qcols])
        out = outlier_shares(sub, quartiles(sub, qcols)).drop("col_ord")
        prof = prof.join(out, "col_name", "left")
    else:
        prof = (prof.withColumn("q1", F.lit(None).cast("double"))
                .withColumn("q3", F.lit(None).cast("double"))
                .withColumn("iqr", F.lit(None).cast("double"))
                .withColumn("outlier_share", F.lit(None).cast("double")))
    frac = F.col("col_name").isin([n for n, k in kinds.items() if k.fractional] or ["\u0000"])
    flags = F.array(
        F.when(F.col("missing_pct") / 100 > HIGH_MISSING_SHARE, F.lit("high_missing")),
        F.when((F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 0) & ~frac,
               F.lit("possible_id")),
        F.when(F.col("n_unique") <= 1, F.lit("constant")),
        F.when(F.col("q1").isNotNull() & (F.col("n_nonnull") > OUTLIER_MIN_NONNULL)
               & (F.col("iqr") > 0) & (F.col("outlier_share") > OUTLIER_SHARE), F.lit("outliers")))
    return prof.withColumn("quality_flags", F.filter(flags, lambda x: x.isNotNull())) \
        .orderBy("col_ord")


def flagged_summary_text(profile: DataFrame) -> DataFrame:
    """C9/C10 piece: "name: flag1, flag2" joined by '; ' in column order (one row)."""
    parts = profile.where(F.size("quality_flags") > 0).select(
        "col_ord", F.concat(F.col("col_name"), F.lit(": "),
                            F.array_join("quality_flags", ", ")).alias("part"))
    return parts.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col_ord", "part"))), lambda s: s["part"]), "; ")
        .alias("flagged"))


def quality_summary(profile: DataFrame, time_column: str | None,
                    targets: list[str]) -> DataFrame:
    """The one-line dataset summary."""
    n = profile.agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"))
    flagged = flagged_summary_text(profile)
    tail = ((f"Detected time column: {time_column}. " if time_column else "")
            + (f"Likely target(s): {', '.join(targets)}." if targets else ""))
    both = n.select("*", flagged.select("flagged").scalar().alias("flagged"))
    text = F.concat(
        F.format_number(F.col("n_rows"), 0), F.lit(" rows x "), F.col("n_cols").cast("string"),
        F.lit(" columns. "),
        F.when(F.col("flagged").isNotNull() & (F.col("flagged") != ""),
               F.concat(F.lit("Quality flags -> "), F.col("flagged"), F.lit(". ")))
        .otherwise(F.lit("No major quality flags. ")),
        F.lit(tail))
    return both.select("n_rows", "n_cols", text.alias("quality_summary"))


def column_dictionary(profile: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach user-supplied meanings (name, meaning) case-insensitively; '' if none.

    The dictionary has one row per column name of the profiled table, so its size is bounded
    by the schema width, which makes the broadcast safe.
    """
    d = dictionary.select(F.lower(F.trim(F.col("name"))).alias("_k"), F.col("meaning"))
    return (profile.join(F.broadcast(d), F.lower(F.col("col_name")) == F.col("_k"), "left")
            .withColumn("inferred_meaning", F.coalesce(F.trim(F.col("meaning")), F.lit("")))
            .drop("_k", "meaning"))


def describe_column(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max of one numeric column."""
    x = F.col(quoted(col)).cast("double")
    q = exact_quantiles(df, {col: x}, [0.25, 0.5, 0.75])[col]
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                  F.max(x).alias("max")).select(
        F.lit(col).alias("col_name"), "count", "mean", "std", "min",
        *[F.lit(v).cast("double").alias(n) for v, n in zip(q, ("p25", "p50", "p75"), strict=True)], "max")
