"""The context digest profiles its table once; ranks of one bracket share a sketch."""
from pyspark.sql import functions as F

from insightframe.functions import quantiles as qt
from insightframe.plans.queries_report import q_context_digest


def _tables(spark, folder):
    n = F.col("id")
    spark.range(5).select(n.alias("n_nationkey"), F.concat(F.lit("N"), n).alias("n_name"), (n % 2).alias("n_regionkey")) \
        .write.parquet(f"{folder}/nation.parquet")
    spark.range(2).select(n.alias("r_regionkey"), F.concat(F.lit("R"), n).alias("r_name")).write.parquet(f"{folder}/region.parquet")
    spark.range(20).select(n.alias("c_custkey"), (n % 5).alias("c_nationkey"), F.concat(F.lit("M"), n % 3).alias("c_mktsegment")) \
        .write.parquet(f"{folder}/customer.parquet")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (n % 190 * 5).cast("int")).cast("timestamp_ntz")
    spark.range(200).select(n.alias("o_orderkey"), (n % 20).alias("o_custkey"), F.concat(F.lit("S"), n % 2).alias("o_orderstatus"),
                            F.concat(F.lit("P"), n % 4).alias("o_orderpriority"), day.alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    spark.range(800).select(
        (n % 200).alias("l_orderkey"), (n % 50).alias("l_partkey"), (n % 9).alias("l_suppkey"), (n % 7).cast("int").alias("l_linenumber"),
        (n % 31).cast("double").alias("l_quantity"), (n * 1.5).cast("double").alias("l_extendedprice"), (n % 10 / 100.0).cast("double").alias("l_discount"),
        (n % 8 / 100.0).cast("double").alias("l_tax"), F.element_at(F.array(*[F.lit(x) for x in "RAN"]), (n % 3 + 1).cast("int")).alias("l_returnflag"),
        F.element_at(F.array(F.lit("O"), F.lit("F")), (n % 2 + 1).cast("int")).alias("l_linestatus"), day.alias("l_shipdate")) \
        .write.parquet(f"{folder}/lineitem.parquet")


def test_digest_profiles_its_table_once(spark, tmp_path):
    _tables(spark, tmp_path)
    digest = q_context_digest(spark, str(tmp_path))
    assert "xxhash64" not in digest._jdf.queryExecution().optimizedPlan().toString()  # the profile's distinct values
    text = digest.first()[0]
    assert "800 rows x 11 columns" in text and "Likely target(s): l_linestatus." in text and text.count("l_returnflag rate (") == 3


def test_ranks_of_one_bracket_share_a_sketch(spark, monkeypatch):
    made = []
    plain = F.percentile_approx
    monkeypatch.setattr(qt.F, "percentile_approx", lambda *a: made.append(a) or plain(*a))
    monkeypatch.setattr(qt, "LAST_ROWS", 10)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"))
    found = qt.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75])
    assert found == {"x": [249.75, 499.5, 749.25]}
    assert len(made) == 1
