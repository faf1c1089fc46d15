import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from insightframe.session import get_spark
    s = get_spark("*", 8)
    yield s


@pytest.fixture(scope="session")
def lending(spark):
    """Small lending-like table with planted truths (deterministic, built with spark.range):
    risk rises with grade A->E, lower fico raises risk, 3% missing income, monthly dates."""
    from pyspark.sql import functions as F
    n = 6000
    u = lambda s: (F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(1000003)) / 1000003.0)
    df = spark.range(n).select(
        F.concat(F.lit("L"), (F.col("id") + 100000).cast("string")).alias("loan_id"),
        F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") % 24).cast("int")).alias("issue_date"),
        F.element_at(F.array(*[F.lit(g) for g in "ABCDE"]),
                     (F.least(F.floor(u(1) * 5), F.lit(4)) + 1).cast("int")).alias("grade"),
        (600 + F.floor(u(2) * 250)).cast("int").alias("fico_score"),
        F.when(u(3) < 0.03, F.lit(None)).otherwise(20000 + u(4) * 100000).alias("annual_income"),
        F.element_at(F.array(F.lit("RENT"), F.lit("MORTGAGE"), F.lit("OWN")),
                     (F.least(F.floor(u(5) * 3), F.lit(2)) + 1).cast("int")).alias("home_ownership"),
        u(6).alias("_noise"), u(7).alias("_r"))
    grade_idx = F.array_position(F.array(*[F.lit(g) for g in "ABCDE"]), F.col("grade")) - 1
    p = 0.10 + 0.09 * grade_idx + (700 - F.col("fico_score")) / 1000.0
    return df.withColumn("default", (F.col("_r") < p).cast("int")).drop("_noise", "_r").cache()
