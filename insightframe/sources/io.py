"""Sources and sinks.

Parquet is the primary source. CSV support mirrors what an uploaded-file analyst needs:
header + inferred types, a salvage mode for ragged rows, and a date auto-parse that only
adopts a column when every value parses.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted

_SENTINEL = "_extra_field"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet), NaN folded into NULL."""
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere: fold it into NULL on DOUBLE/FLOAT columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(quoted(f.name)), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(quoted(f.name)))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types inferred over the whole file unless ``schema`` is given.

    Inference costs one extra pass, so callers at scale pass the explicit schema returned by
    :func:`csv_schema` (inferred once, then reused).
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return nan_to_null(reader.csv(path))


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Infer a CSV schema once so later reads are single-pass."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only (no data pass)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return spark.read.option("header", True).csv(path).columns


def read_csv_salvage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ragged-row salvage.

    Rows with *too many* fields are dropped; short rows are kept with missing fields NULL.
    A trailing sentinel column catches the overflow (quote-aware, because the CSV parser
    does the splitting), which ``DROPMALFORMED`` cannot do without also dropping short rows.
    """
    wide = T.StructType(list(schema.fields) + [T.StructField(_SENTINEL, T.StringType(), True)])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .schema(wide).csv(path))
    return raw.where(F.col(_SENTINEL).isNull()).drop(_SENTINEL)


def select_pruned(df: DataFrame, cols: list[str]) -> DataFrame:
    """S3: a pruned projection; on Parquet only these columns are read."""
    return df.select(*cols)


_TIME_ONLY = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"
_DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd"]


def parse_timestamp(c: F.Column) -> F.Column:
    """Lenient string -> TIMESTAMP, bad values -> NULL; time-only strings rejected."""
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(F.try_to_timestamp(s),
                        *[F.try_to_timestamp(s, F.lit(fmt)) for fmt in _DATE_FORMATS])
    return F.when(s.rlike(_TIME_ONLY), F.lit(None).cast("timestamp")).otherwise(parsed)


def date_autoparse(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Parse every STRING column whose name contains "date"; keep the raw column when
    any non-NULL value fails. One aggregate decides for all candidates at once."""
    cands = [f.name for f in df.schema.fields
             if "date" in f.name.lower() and isinstance(f.dataType, T.StringType)]
    if not cands:
        return df, []
    fails = df.agg(*[F.count_if(F.col(c).isNotNull() & parse_timestamp(F.col(c)).isNull())
                     .alias(c) for c in cands]).first()
    adopt = [c for c in cands if fails[c] == 0]
    out = df.select(*[parse_timestamp(F.col(f.name)).alias(f.name) if f.name in adopt
                      else F.col(f.name) for f in df.schema.fields])
    return out, adopt


def date_autoparse_report(df: DataFrame) -> DataFrame:
    """S6 as a table: (col_name, n_values, n_failed, adopted) for every candidate column."""
    cands = [f.name for f in df.schema.fields if "date" in f.name.lower()]
    rows = []
    for i, c in enumerate(cands):
        raw = F.col(c).cast("string")
        rows.append(F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("col_ord"),
                             F.count(raw).alias("n_values"),
                             F.count_if(raw.isNotNull() & parse_timestamp(raw).isNull())
                             .cast("bigint").alias("n_failed")))
    return (df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")
            .withColumn("adopted", F.col("n_failed") == 0))


def write_artifact(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Write one artifact table, partitioned by run id (overwrites that run only)."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(fmt).save(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
