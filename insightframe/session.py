"""Session helpers: one place that decides how a session is configured.

On a cluster the session already exists (spark-submit / notebook); these helpers only
fill in settings that are unset, so cluster-level configuration always wins.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. They are applied only when the key is unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int | None = None,
              app_name: str = "insightframe", driver_memory: str | None = None) -> SparkSession:
    """Local session for tests, benchmarks and the driver contract."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or (8 if cores == "*" else int(cores))))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is used as is. Only in local mode (tests), when it is unset, a fresh
    scratch folder is made; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="insightframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back.

    For tables that many later steps read: they start from the copy instead of planning and running
    all that led to it again, and a lost executor only costs running tasks.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows of a report table (bounded by its definition: a few lines, or one row a column or
    model) as a table of their own, so that what reads them does not run the analysis again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
