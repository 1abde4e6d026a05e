"""Conflict graphs derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def _items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns)


def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts on consecutive lines of one order, as they occur."""
    x = _items(spark, sf_dir, "l_orderkey", "l_partkey", "l_linenumber")
    y = x.select("l_orderkey", F.col("l_partkey").alias("b"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    return x.join(y, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("a"), "b")


def consecutive_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts on consecutive lines of one order."""
    return Graph.of_pairs(consecutive_pairs(spark, sf_dir))


def same_order_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts in the same order."""
    x = _items(spark, sf_dir, "l_orderkey", "l_partkey").distinct()
    y = x.withColumnRenamed("l_partkey", "b")
    return Graph.of_pairs(x.join(y, "l_orderkey").where("l_partkey < b").select(F.col("l_partkey").alias("a"), "b"))


def customer_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (even ids) and the parts they ordered (odd ids)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = _items(spark, sf_dir, "l_orderkey", "l_partkey")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return Graph.of_pairs(joined.select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders that follow each other for one part and supplier, by shipping date."""
    items = _items(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    follow = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey")
    return Graph.of_pairs(items.select(F.col("l_orderkey").alias("a"), F.lead("l_orderkey").over(follow).alias("b")).where("b IS NOT NULL"))


GRAPHS = {"g1": consecutive_parts, "g2": same_order_parts, "g3": customer_parts, "g4": order_chain}
