"""Where queries are registered, and the relations that they share.

Two encodings of the driver's tables as transactions: ARITH (4 partitions, 3 regions; keys are parts, placed by
arithmetic) and GEO (4 partitions, 5 regions; keys are suppliers, homes come from the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placement as P

QUERIES, ORACLE_SQL = {}, {}
PARTITIONS, REGIONS = 4, 3


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name, with DuckDB SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 250_000


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts a table's rows are dealt, so that a task's share, and its memory, stays as the table grows."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def lines(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Lines of orders, those of an order and key together."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", key, "l_returnflag").repartition(tasks(spark, sf_dir, "lineitem"), "l_orderkey", key)


def access_arith(spark, d) -> DataFrame:
    """txn_id, key, part, master, is_write: one row a transaction and key."""
    rows = lines(spark, d, "l_partkey").groupBy(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key")).agg(F.max(F.col("l_returnflag") == "R").alias("is_write"))
    return rows.select("txn_id", "key", P.simple_partition("key", PARTITIONS).alias("part"), P.simple_home("key", PARTITIONS, REGIONS).alias("master"), "is_write")


ACCESS_ARITH = """acc AS (
  SELECT l_orderkey AS txn_id, l_partkey AS key, l_partkey % 4 AS part, (l_partkey // 4) % 3 AS master, bool_or(l_returnflag = 'R') AS is_write
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def supplier_region(spark, d) -> DataFrame:
    """key, master: a supplier's region."""
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.col("n_regionkey").alias("master"))


def access_geo(spark, d) -> DataFrame:
    """txn_id, key, part, master, is_write, with masters from the data."""
    rows = lines(spark, d, "l_suppkey").groupBy(F.col("l_orderkey").alias("txn_id"), F.col("l_suppkey").alias("key")).agg(F.max(F.col("l_returnflag") == "R").alias("is_write"))
    return rows.join(supplier_region(spark, d), "key", "left").select("txn_id", "key", P.simple_partition("key", PARTITIONS).alias("part"), "master", "is_write")


ACCESS_GEO = """geo AS (
  SELECT l.txn_id, l.key, l.key % 4 AS part, n.n_regionkey AS master, l.is_write
  FROM (SELECT l_orderkey AS txn_id, l_suppkey AS key, bool_or(l_returnflag = 'R') AS is_write FROM lineitem GROUP BY 1, 2) l
  LEFT JOIN supplier s ON s.s_suppkey = l.key LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)"""


def coordinator_region(spark, d) -> DataFrame:
    """txn_id, coord: the region of an order's customer."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("txn_id"), F.col("n_regionkey").alias("coord"))


COORD = """coo AS (
  SELECT o_orderkey AS txn_id, n_regionkey AS coord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
