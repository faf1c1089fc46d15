"""Ad-hoc segment analyses (H1-H5).

H1-H4 are the analyses the automated analyst produced in its sample report, written as
partial-aggregated group-bys with a scalar-subquery baseline (no join to a one-row table).
H5 replaces arbitrary generated code with user SQL steps run through Catalyst: one query per
step, commands rejected, results capped for display, errors recorded as rows, one corrected
retry, and a time limit enforced by cancelling the jobs that carry the step's tag.
"""
from __future__ import annotations

import difflib
import re
import uuid
from collections.abc import Callable
from concurrent.futures import Future, wait
from dataclasses import dataclass
from threading import Thread

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.util import inheritable_thread_target

from ..functions.columns import safe_div

MAX_STEPS = 3
STEP_SECONDS = 20.0
RESULT_ROWS = 20
RESULT_CHARS = 4000


def _baseline(df: DataFrame, y: str) -> Column:
    return df.agg(F.avg(F.col(y).cast("double"))).scalar()


def segment_pair_rates(df: DataFrame, k1: str, k2: str, y: str = "y", amount: str | None = None) -> DataFrame:
    """H1: positives / total / rate per (k1, k2) plus the value-weighted rate and the lift over
    the overall rate (in rate units)."""
    base = _baseline(df, y)
    aggs = [F.sum(F.col(y).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("n")]
    if amount:
        aggs.append(safe_div(F.sum(F.col(y) * F.col(amount)), F.sum(amount)).alias("value_weighted_rate"))
    g = df.where(F.col(k1).isNotNull() & F.col(k2).isNotNull()).groupBy(k1, k2).agg(*aggs)
    return (g.withColumn("rate", F.col("positives") / F.col("n"))
            .withColumn("overall_rate", base).withColumn("lift", F.col("rate") - base))


def star_segment_pair_rates(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, k1: str, k2: str,
                            y: str = "y", amount: str | None = None) -> DataFrame:
    """H1 over a star: same result as :func:`segment_pair_rates` on the inner join of ``fact``
    and ``dim``, but the fact rows are first reduced to (key, fact-side pair columns) with their
    sums, so the join moves one row per key and fact value instead of one per fact row."""
    fact_cols = [c for c in (k1, k2) if c in fact.columns]
    dim_cols = [c for c in (k1, k2) if c not in fact.columns]
    sums = [F.count(F.lit(1)).alias("_n"), F.count(y).alias("_ny"),
            F.sum(F.col(y).cast("bigint")).alias("_pos")]
    if amount:
        sums += [F.sum(F.col(y) * F.col(amount)).alias("_wy"), F.sum(amount).alias("_w")]
    per = fact.groupBy(key, *fact_cols).agg(*sums)
    joined = per.join(dim.select(F.col(dim_key).alias(key), *dim_cols), key)
    base = joined.agg(F.try_divide(F.sum("_pos").cast("double"), F.sum("_ny").cast("double"))).scalar()
    aggs = [F.sum("_pos").alias("positives"), F.sum("_n").alias("n")]
    if amount:
        aggs.append(safe_div(F.sum("_wy"), F.sum("_w")).alias("value_weighted_rate"))
    g = joined.where(F.col(k1).isNotNull() & F.col(k2).isNotNull()).groupBy(k1, k2).agg(*aggs)
    return (g.withColumn("rate", F.col("positives") / F.col("n"))
            .withColumn("overall_rate", base).withColumn("lift", F.col("rate") - base))


def star_segment_lift(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, k1: str, k2: str,
                      y: str = "y", min_n: int = 50) -> DataFrame:
    """H4 over a star (see :func:`star_segment_pair_rates`)."""
    return (star_segment_pair_rates(fact, key, dim, dim_key, k1, k2, y).where(F.col("n") >= min_n)
            .withColumn("lift_points", F.col("lift") * 100))


def bucket_rates(df: DataFrame, col: str, edges: list[float], y: str = "y", min_n: int = 1) -> DataFrame:
    """H2: rate per band [edge_i, edge_i+1) of a numeric column (open-ended outer bands)."""
    c = F.col(col)
    band = F.lit(0)
    for e in edges:
        band = band + F.when(c >= F.lit(e), 1).otherwise(0)
    labels = (["< " + _fmt(edges[0])] + [f"{_fmt(a)}-{_fmt(b)}" for a, b in zip(edges, edges[1:])]
              + [">= " + _fmt(edges[-1])])
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), band + 1)
    return (df.where(c.isNotNull()).groupBy(band.cast("int").alias("band"), lab.alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
            .where(F.col("n") >= min_n).withColumn("rate", F.col("positives") / F.col("n")))


def _fmt(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def risky_segment(df: DataFrame, flag: Column, y: str = "y") -> DataFrame:
    """H3: share of rows in a compound segment, its rate and the overall rate (one pass)."""
    f = F.coalesce(flag, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_flagged"),
                  F.avg(f.cast("double")).alias("share"),
                  F.avg(F.when(f, F.col(y).cast("double"))).alias("flagged_rate"),
                  F.avg(F.col(y).cast("double")).alias("overall_rate"))


def segment_lift(df: DataFrame, k1: str, k2: str, y: str = "y", min_n: int = 50) -> DataFrame:
    """H4: pairwise segment lift over the overall rate, in percentage points, n >= min_n."""
    return (segment_pair_rates(df, k1, k2, y).where(F.col("n") >= min_n)
            .withColumn("lift_points", F.col("lift") * 100))


_FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|"
                        r"refresh|cache|uncache|set|reset|add|load|msck|analyze|use)\b", re.I)


def validate_step(sql: str) -> str | None:
    """H5 guard: a single read-only query (SELECT / WITH / VALUES / TABLE). Returns an error
    message or None."""
    body = sql.strip().rstrip(";").strip()
    if not body:
        return "empty step"
    if ";" in body:
        return "one statement per step"
    first = body.split(None, 1)[0].lower()
    if first not in ("select", "with", "values", "table", "from"):
        return f"only queries are allowed (got '{first}')"
    if _FORBIDDEN.search(re.sub(r"'[^']*'", "''", body)):
        return "commands are not allowed inside a step"
    return None


def suggested_column(sql: str, error: Exception) -> str | None:
    """The correction that needs no author: an unknown column replaced by the nearest known one."""
    if not isinstance(error, AnalysisException) or not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
        return None
    told = error.getMessageParameters() or {}
    wrong = (told.get("objectName") or "").split(".")[-1].strip("` ")
    known = [x.split(".")[-1].strip("` ") for x in (told.get("proposal") or "").split(",")]
    near = difflib.get_close_matches(wrong, [x for x in known if x], 1)
    return re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", near[0], sql) if wrong and near else None


@dataclass
class _Outcome:
    status: str  # ok, error, rejected or limit
    n_rows: int | None = None
    result: str | None = None
    error: str | None = None
    cause: Exception | None = None


def _run_step(spark: SparkSession, sql: str, rows: int, limit_seconds: float) -> _Outcome:
    """One step in a thread of its own, its jobs under one tag; past the limit they are cancelled."""
    problem = validate_step(sql)
    if problem:
        return _Outcome("rejected", error=problem)
    context, tag = spark.sparkContext, f"step-{uuid.uuid4().hex}"
    done: Future = Future()

    def work():
        context.addJobTag(tag)
        try:
            res = spark.sql(sql.strip().rstrip(";"))
            n = res.count()
            done.set_result((n, ("[" + ",".join(res.limit(rows).toJSON().collect()) + "]")[:RESULT_CHARS]))
        except Exception as exc:  # noqa: BLE001 - the error is the step's result
            done.set_exception(exc)
        finally:
            context.removeJobTag(tag)

    Thread(target=inheritable_thread_target(spark)(work), daemon=True).start()
    try:
        n, result = done.result(limit_seconds)
        return _Outcome("ok", n, result)
    except TimeoutError:
        # jobs that the step would start later belong to the tag as well
        while not done.done():
            context.cancelJobsWithTag(tag)
            wait([done], 0.5)
        return _Outcome("limit", error=f"stopped after {limit_seconds:g} s")
    except Exception as exc:  # noqa: BLE001
        return _Outcome("error", error=f"{type(exc).__name__}: {str(exc).splitlines()[0][:300]}", cause=exc)


def sql_steps(spark: SparkSession, data: DataFrame, steps: list[str], view: str = "df",
              max_steps: int = MAX_STEPS, rows: int = RESULT_ROWS, limit_seconds: float = STEP_SECONDS,
              correct: Callable[[str, Exception], str | None] | None = suggested_column) -> DataFrame:
    """H5: run up to ``max_steps`` SQL steps against ``data`` (as temp view ``view``).

    Output (step, attempts, status, ok, n_rows, result, error): the result is the JSON of at most
    ``rows`` rows cut to 4000 characters (a display preview; the step's query itself runs on all
    rows). A failing step is tried once more as ``correct(sql, error)`` has it, if that gives
    something else; ``status`` is that of the last attempt. A step that runs longer than
    ``limit_seconds`` has its jobs cancelled and is not tried again; the session stays usable.
    """
    data.createOrReplaceTempView(view)
    out = []
    for i, sql in enumerate(steps[:max_steps]):
        got, attempts = _run_step(spark, sql, rows, limit_seconds), 1
        if got.status == "error" and correct is not None:
            better = correct(sql, got.cause)
            if better and better != sql:
                got, attempts = _run_step(spark, better, rows, limit_seconds), 2
        out.append((i, attempts, got.status, got.status == "ok", got.n_rows, got.result, got.error))
    return spark.createDataFrame(out, "step int, attempts int, status string, ok boolean, n_rows bigint, result string, error string")
