"""Analysis base tables built from the driver's star schema.

Each base table is a lazy DataFrame: column pruning and filters reach the Parquet scan.
Joins against the fact table are left to the optimizer and AQE (sort-merge at scale,
broadcast when the runtime size is small). Only ``nation`` and ``region`` are broadcast
explicitly: their row counts are fixed by the schema definition (25 and 5), independent of
the scale factor, so that broadcast has a proven size bound.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_table


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25-row geography dimension (fixed size)."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", "n_name", "r_name")


def order_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer and geography attributes."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    cust = customer.join(F.broadcast(nation_region(spark, sf_dir)),
                         F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))


def lineitem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the event ``y = (l_returnflag = 'R')``."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def lineitem_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lineitem x order x customer x nation x region base table."""
    return lineitem_events(spark, sf_dir).join(
        order_dims(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


def orders_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with ``y = (o_orderstatus = 'F')``."""
    return read_table(spark, sf_dir, "orders") \
        .withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def events_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``y = (event_type = 'error')``."""
    return read_table(spark, sf_dir, "events") \
        .withColumn("y", (F.col("event_type") == "error").cast("int"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents (both grow with the data: no forced broadcast)."""
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id")
