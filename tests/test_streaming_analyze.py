"""Streaming rates equal the batch rates for closed windows; analyze() end to end."""
import uuid

from pyspark.sql import functions as F

from insightframe.operators import series as sr
from insightframe.plans.analyze import analyze, write_artifacts
from insightframe.streaming import rates as st

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch_daily_rates(spark):
    events = st.read_table_stream(spark, SF, "events").withColumn(
        "y", (F.col("event_type") == "error").cast("int"))
    name = "rates_" + uuid.uuid4().hex[:8]
    q = st.start_to_memory(st.windowed_rates(events, "ts", watermark="0 seconds"), name)
    q.awaitTermination(120)
    got = {r.window_start.date(): (r.n, r.positives) for r in spark.table(name).collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("y", (F.col("event_type") == "error").cast("int"))
    want = {r.period: (r.n, int(r.positives)) for r in sr.period_rates(batch, "ts", grain="day").collect()}
    # with a zero watermark every window but the last is closed and emitted exactly
    last = max(want)
    assert {k: v for k, v in got.items() if k != last} == {k: v for k, v in want.items() if k != last}
    assert len(got) >= len(want) - 1


def test_analyze_end_to_end(spark, lending):
    from insightframe.operators.models import ModelConfig
    a = analyze(lending, key=["loan_id"], question="Which model has the best accuracy?",
                model_config=ModelConfig(num_trees=10, max_depth=4, gbt_iter=5, gbt_depth=3))
    assert a.roles.target == "default" and a.roles.time_column == "issue_date"
    claims = {r.ord: r.claim for r in a.findings.collect()}
    assert claims[0].startswith("Overall default rate is ")
    assert "'grade' is the strongest categorical driver of default" in claims[1]
    assert "over time" in claims[3]
    assert claims[4].startswith("Best model is ")
    assert a.projections.count() == 3
    p = a.projections.collect()
    assert all(r.lower <= r.point <= r.upper for r in p)
    rules = [r.rule for r in a.guardrails.orderBy("ord").collect()]
    assert any("overclaiming" in r for r in rules) and rules[-1].startswith("State overall confidence")
    assert a.summary.first().summary.startswith("Executive summary (BLUF): Overall default rate")
    labels = [r.label for r in a.kpis.orderBy("ord").collect()]
    assert labels[0] == "Records analyzed" and labels[-1] == "Overall confidence"
    assert a.charts.select("chart_id").distinct().count() >= 4
    ans = a.answer.first()
    assert ans.route == "model" and ans.answer.startswith("Selected model: ")
    import tempfile
    out = tempfile.mkdtemp(prefix="insightframe-artifacts-")
    written = write_artifacts(a, out, "run1")
    assert {"findings", "projections", "leaderboard", "charts", "kpis"} <= set(written)
    back = spark.read.parquet(out + "/findings")
    assert back.where("run_id = 'run1'").count() == a.findings.count()
    a.unpersist()


def test_analyze_without_target(spark):
    df = spark.range(200).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 7).alias("k"))
    a = analyze(df, run_models=False)
    c = a.findings.first()
    assert c.confidence == "low" and "No target column was auto-detected" in c.claim
