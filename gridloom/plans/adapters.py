"""The driver's tables in the roles of the model: parts as a tree, customers as loads, events as readings.

Part k hangs below (k - 1) div 2 if k is odd, else below k div 3; part 0 is the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (parent), dst (child), length."""
    k = F.col("p_partkey")
    parent = F.when(k % 2 == 1, F.expr("(p_partkey - 1) div 2")).otherwise(F.expr("p_partkey div 3"))
    return table(spark, sf_dir, "part").filter(k >= 1).select(parent.cast("string").alias("src"), k.cast("string").alias("dst"), F.col("p_size").cast("double").alias("length"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent of every part; part 0 has none."""
    edges = tree_edges(spark, sf_dir)
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("parent")).unionByName(table(spark, sf_dir, "part").filter("p_partkey = 0").select(F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent")))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, bus, base_kw, load_seq: customers at the part with their number."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("bus"), F.greatest("c_acctbal", F.lit(0.0)).alias("base_kw"), F.col("c_custkey").alias("load_seq"))


def helper_name(node: str) -> Column:
    """Some nodes renamed to helpers: r for every 7th, s for every 11th, _OPEN for every 13th."""
    k = F.col(node).cast("long")
    return F.when(k % 7 == 3, F.concat(node, F.lit("r"))).when(k % 11 == 5, F.concat(node, F.lit("s"))).when(k % 13 == 6, F.concat(node, F.lit("_OPEN"))).otherwise(F.col(node))


def helper_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with some of its nodes as helpers."""
    return tree_edges(spark, sf_dir).select(helper_name("src").alias("src"), helper_name("dst").alias("dst"))


def readings(spark: SparkSession, sf_dir: str, width: str = "day") -> DataFrame:
    """tick, meter, ts, event_id, p_kw of the events."""
    return table(spark, sf_dir, "events").select(F.date_trunc(width, "ts").cast("timestamp_ntz").alias("tick"), F.col("event_type").alias("meter"), "ts", "event_id", F.col("value").alias("p_kw"))


#: The tree for SQL.
TREE_SQL = """tree_edges AS (SELECT CASE WHEN p_partkey % 2 = 1 THEN (p_partkey - 1) // 2 ELSE p_partkey // 3 END AS p, p_partkey AS k, CAST(p_size AS DOUBLE) AS length FROM part WHERE p_partkey >= 1)"""
#: Every node with each of its ancestors, itself included.
CLOSURE_SQL = f"""{TREE_SQL},
up(node, anc, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT u.node, e.p, u.steps + 1 FROM up u JOIN tree_edges e ON e.k = u.anc)"""
LOADS_SQL = "loads AS (SELECT c_name AS name, c_custkey AS bus, greatest(c_acctbal, 0) AS base_kw, c_custkey AS load_seq FROM customer)"
