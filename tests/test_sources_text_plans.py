"""Sources/sinks (S*), text and question operators (T*, L*), ad-hoc steps (H5), plan checks
and the driver contract."""
import os
import tempfile

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightframe.operators import adhoc as ah
from insightframe.operators import textops as tx
from insightframe.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="insightframe-test-")


def test_ragged_csv_salvage(spark):
    d = _tmp()
    p = os.path.join(d, "ragged.csv")
    with open(p, "w") as f:
        f.write('a,b,c\n1,"x,y",3\n4,5\n6,7,8,9\n10,11,12\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()),
                           T.StructField("c", T.IntegerType())])
    rows = sorted(io.read_csv_salvage(spark, p, schema).collect())
    assert [tuple(r) for r in rows] == [(1, "x,y", 3), (4, "5", None), (10, "11", 12)]
    assert io.header_columns(spark, p) == ["a", "b", "c"]
    inferred = io.read_csv(spark, p, io.csv_schema(spark, p))
    assert inferred.columns == ["a", "b", "c"]


def test_date_autoparse_adopts_only_clean_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("2024-02-01", "oops")], "start_date string, end_date string")
    out, adopted = io.date_autoparse(df)
    assert adopted == ["start_date"]
    assert isinstance(out.schema["start_date"].dataType, T.TimestampType)
    assert isinstance(out.schema["end_date"].dataType, T.StringType)


def test_artifact_and_csv_sinks(spark):
    d = _tmp()
    df = spark.createDataFrame([(0, "a claim")], "ord int, claim string")
    io.write_artifact(df, os.path.join(d, "findings"), "run1")
    io.write_artifact(df.withColumn("claim", F.lit("b")), os.path.join(d, "findings"), "run2")
    back = spark.read.parquet(os.path.join(d, "findings"))
    assert sorted(r.run_id for r in back.collect()) == ["run1", "run2"]
    io.write_csv(df, os.path.join(d, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 1


def test_bullets_plan_fence_json(spark):
    text = ("# Plan\n- **Profile the data**\n* check rates\n• trend\n1. model it\n2) explain\n"
            "Overview:\n- Details:\nplain prose line\n3. last one")
    df = spark.createDataFrame([(1, text), (2, "no list here")], "k long, t string")
    items = [r.item for r in tx.bullet_items(df, "k", "t").where("k = 1").orderBy("item_no").collect()]
    assert items == ["Profile the data", "check rates", "trend", "model it", "explain", "last one"]
    plan = tx.plan_rows(df, "k", "t").orderBy("k", "step_ord").collect()
    assert [r.step for r in plan if r.k == 1] == items[:5]
    assert [r.step for r in plan if r.k == 2] == tx.DEFAULT_PLAN and all(r.is_default for r in plan if r.k == 2)
    code = spark.createDataFrame([("intro\n```python\nx = 1\n```\nmore ```y```",), ("  just code  ",)], "t string")
    got = [r.code for r in tx.fenced_block(code, "t").collect()]
    assert got == ["x = 1", "just code"]
    js = spark.createDataFrame([('Sure! {"claim": "Rate is 25%", "confidence": "HIGHEST", '
                                 '"limitations": ["a", "b", "c", "d"]} thanks',), ("{broken",)], "t string")
    rows = tx.json_findings(js, "t").collect()
    assert rows[0].claim == "Rate is 25%" and rows[0].confidence == "medium" and rows[0].limitations == ["a", "b", "c"]
    assert len(rows) == 1  # no claim, no finding


def test_question_routes_order_and_fallthrough(spark):
    qs = spark.createDataFrame([(1, "Which model had the best accuracy?"), (2, "show the dashboard"),
                                (3, "why is loss up?"), (4, "is it rising over time"), (5, "hello")],
                               "q long, text string")
    r = {x.q: x.route for x in tx.question_routes(qs, "text", True, True, False, True).collect()}
    assert r == {1: "model", 2: "chart", 3: "lead", 4: "trend", 5: "lead"}   # driver falls through
    r2 = {x.q: x.route for x in tx.question_routes(qs, "text", False, False, True, False).collect()}
    assert r2[1] == "model_none" and r2[2] == "chart_none" and r2[3] == "driver" and r2[4] == "lead"


def test_chat_window_skewed_conversation(spark):
    # one conversation holds most turns; the two-stage window must equal the plain window
    rows = [(0, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(3000)]
    rows += [(c, t, "user", f"c{c}t{t}") for c in range(1, 20) for t in range(5)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tx.chat_window(conv).select("conv_id", "turn").collect()
    want = [(0, t) for t in range(2988, 3000)] + [(c, t) for c in range(1, 20) for t in range(5)]
    assert sorted((r.conv_id, r.turn) for r in got) == sorted(want)
    last = {r.conv_id: r.last_user_turn for r in tx.chat_last_user(conv).collect()}
    assert last[0] == 2999


def test_sql_steps_guard(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    out = ah.sql_steps(spark, df, ["SELECT g, count(*) AS n FROM df GROUP BY g", "SELECT nope FROM df",
                                   "DROP TABLE df", "SELECT 1; SELECT 2"], max_steps=4)
    r = out.orderBy("step").collect()
    assert r[0].ok and r[0].n_rows == 2
    assert not r[1].ok and ("nope" in r[1].error.lower() or "unresolved" in r[1].error.lower())
    assert not r[2].ok and "only queries" in r[2].error
    assert not r[3].ok and "one statement" in r[3].error


def test_sql_steps_limit_and_retry(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("grade"), F.col("id").alias("amount"))
    steps = ["SELECT max(xxhash64(id)) FROM range(1000000000000000)", "SELECT grad, sum(amout) AS s FROM df GROUP BY grad",
             "SELECT sum(amonut) AS s FROM df", "SELECT zzz FROM df WHERE", "SELECT count(*) AS n FROM df"]
    began = time.monotonic()
    r = ah.sql_steps(spark, df, steps, max_steps=9, limit_seconds=3).orderBy("step").collect()
    assert time.monotonic() - began < 40
    assert (r[0].status, r[0].attempts, r[0].n_rows) == ("limit", 1, None) and "stopped after 3 s" in r[0].error
    assert (r[1].status, r[1].attempts) == ("error", 2)       # one correction, two wrong names
    assert (r[2].status, r[2].attempts, r[2].result) == ("ok", 2, '[{"s":499500}]')
    assert (r[3].status, r[3].attempts) == ("error", 1)       # nothing to correct in a syntax error
    assert (r[4].status, r[4].result) == ("ok", '[{"n":1000}]')
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    fixed = ah.sql_steps(spark, df, ["SELECT broken"], correct=lambda sql, error: "SELECT max(amount) AS m FROM df").first()
    assert (fixed.status, fixed.attempts, fixed.result) == ("ok", 2, '[{"m":999}]')
    assert ah.sql_steps(spark, df, ["SELECT amonut FROM df"], correct=None).first().attempts == 1


def test_plans_have_no_python_udfs_and_one_segment_shuffle(spark):
    from __spark_entry__ import queries
    q = queries()
    for name in ("segment_rates_all", "numeric_drivers", "monthly_rate", "rate_mix", "profile_columns"):
        txt = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "PythonUDF" not in txt and "BatchEvalPython" not in txt, name
    # numeric drivers: all correlations in ONE aggregate (no shuffle of raw rows)
    nd = q["numeric_drivers"](spark, "/root/testdata/sf0.001")
    plan = nd._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0


def test_driver_contract(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() >= 1
    assert set(oracle_sql()) <= set(queries())
    assert "categorical_drivers" in queries()


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Exchange")


def test_plan_shapes_bounded_exchanges(spark):
    from insightframe.operators import outcome as oc
    from insightframe.operators import series as sr
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet") \
        .withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    # Every column's segments from ONE hash-partitioned aggregate
    hashed, _ = _exchanges(oc.segment_rates_all(li, ["l_linestatus", "l_linenumber", "l_returnflag"]))
    assert hashed == 1
    # One group-by on the month
    s = sr.period_rates(li, "l_shipdate")
    assert _exchanges(s)[0] == 1
    # The group-by plus the single window over the aggregated series, nothing per refit
    assert _exchanges(sr.walk_forward(s))[1] <= 2
