"""The nine TPC-C tables, each a function of its key's number: the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workload import draw

# Fixed values of the benchmark's scale.
DISTRICTS, CUSTOMERS, ORDERS, LINES, ITEMS = 10, 3000, 3000, 10, 100_000
SINCE = 1234567890


def text(by: Column, width: int, salt: int) -> Column:
    """A fixed-width text drawn by a number."""
    digest = F.sha2(F.concat_ws("/", by.cast("string"), F.lit(str(salt))), 256)
    return F.substring(F.repeat(digest, width // 64 + 1), 1, width)


def _grid(spark: SparkSession, warehouses: int, *sizes: tuple[str, int]) -> DataFrame:
    """All combinations of warehouse (from 1) and the further keys (from 1), from one range of numbers."""
    total = warehouses
    for _, n in sizes:
        total *= n
    rows, rest = spark.range(total).withColumn("n", F.col("id")), F.col("id")
    for name, n in reversed(sizes):
        rows = rows.withColumn(name, (F.pmod(rest, F.lit(n)) + 1).cast("int"))
        rest = F.floor(rest / n)
    return rows.withColumn("w_id", (rest + 1).cast("int"))


def warehouse(spark, w: int) -> DataFrame:
    n = F.col("n")
    return _grid(spark, w).select("w_id", text(n, 10, 1).alias("name"), text(n, 71, 2).alias("address"), draw(n, 3, 2001).cast("int").alias("tax"), F.lit(300_000).cast("long").alias("ytd"))


def district(spark, w: int) -> DataFrame:
    n = F.col("n")
    return _grid(spark, w, ("d_id", DISTRICTS)).select("w_id", "d_id", text(n, 10, 4).alias("name"), text(n, 71, 5).alias("address"), draw(n, 6, 2001).cast("int").alias("tax"), F.lit(30_000).cast("long").alias("ytd"), F.lit(ORDERS + 1).alias("next_o_id"))


def customer(spark, w: int) -> DataFrame:
    n = F.col("n")
    return _grid(spark, w, ("d_id", DISTRICTS), ("c_id", CUSTOMERS)).select(
        "w_id", "d_id", "c_id", text(n, 34, 7).alias("full_name"), text(n, 71, 8).alias("address"), text(n, 16, 9).alias("phone"), F.lit(SINCE).cast("long").alias("since"),
        F.when(draw(n, 10, 10) == 0, "BC").otherwise("GC").alias("credit"), F.lit(50_000).cast("long").alias("credit_lim"), draw(n, 11, 5001).cast("int").alias("discount"),
        F.lit(-10).cast("long").alias("balance"), F.lit(10).cast("long").alias("ytd_payment"), F.lit(1).cast("short").alias("payment_cnt"), F.lit(0).cast("short").alias("delivery_cnt"), text(n, 250, 12).alias("data"),
    )


def history(spark, w: int) -> DataFrame:
    n = F.col("n")
    return _grid(spark, w, ("d_id", DISTRICTS), ("c_id", CUSTOMERS)).select("w_id", "d_id", "c_id", F.lit(1).alias("h_id"), F.col("d_id").alias("c_d_id"), F.col("w_id").alias("c_w_id"), F.lit(SINCE).cast("long").alias("date"), F.lit(10).alias("amount"), text(n, 24, 13).alias("data"))


def order(spark, w: int) -> DataFrame:
    """A district's orders are of its customers, each once, in shuffled order."""
    n = F.col("n")
    c_id = F.pmod((F.col("o_id") - 1) * 1777 + F.col("d_id") * 131 + F.col("w_id") * 17, F.lit(CUSTOMERS)) + 1
    return _grid(spark, w, ("d_id", DISTRICTS), ("o_id", ORDERS)).select(
        "w_id", "d_id", "o_id", c_id.cast("int").alias("c_id"), F.lit(SINCE).cast("long").alias("entry_d"), F.when(F.col("o_id") <= ORDERS * 7 // 10, draw(n, 14, 10) + 1).otherwise(0).cast("int").alias("carrier_id"), F.lit(LINES).alias("ol_cnt"), F.lit(1).alias("all_local")
    )


def new_order(spark, w: int) -> DataFrame:
    return _grid(spark, w, ("d_id", DISTRICTS), ("o_id", ORDERS)).where(F.col("o_id") > ORDERS * 7 // 10).select("w_id", "d_id", "o_id", F.lit(0).alias("dummy"))


def order_line(spark, w: int) -> DataFrame:
    n = F.col("n")
    done = F.col("o_id") <= ORDERS * 7 // 10
    return _grid(spark, w, ("d_id", DISTRICTS), ("o_id", ORDERS), ("number", LINES)).select(
        "w_id", "d_id", "o_id", "number", (draw(n, 15, ITEMS) + 1).cast("int").alias("i_id"), F.col("w_id").alias("supply_w_id"), F.when(done, SINCE).otherwise(0).cast("long").alias("delivery_d"),
        F.lit(5).alias("quantity"), F.when(done, 0).otherwise(draw(n, 16, 999_999) + 1).cast("int").alias("amount"), text(n, 24, 17).alias("dist_info"),
    )


def item(spark, representatives: int) -> DataFrame:
    """Items of each representative warehouse, one a region, so that reading them stays local."""
    n = F.col("i_id").cast("long")
    return _grid(spark, representatives, ("i_id", ITEMS)).select("w_id", "i_id", (draw(n, 18, 10_000) + 1).cast("int").alias("im_id"), text(n, 24, 19).alias("name"), (draw(n, 20, 9_901) + 100).cast("int").alias("price"), text(n, 50, 21).alias("data"))


def stock(spark, w: int) -> DataFrame:
    n = F.col("n")
    return _grid(spark, w, ("i_id", ITEMS)).select("w_id", "i_id", (draw(n, 22, 91) + 10).cast("short").alias("quantity"), text(n, 240, 23).alias("all_dist"), F.lit(0).alias("ytd"), F.lit(0).cast("short").alias("order_cnt"), F.lit(0).cast("short").alias("remote_cnt"), text(n, 50, 24).alias("data"))


TABLES = {"warehouse": warehouse, "district": district, "customer": customer, "history": history, "new_order": new_order, "order": order, "order_line": order_line, "item": item, "stock": stock}
