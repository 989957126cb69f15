"""Workload generators: transactions and their keys from a range of numbers and seeded hashes.

Everything is a function of the transaction's number and a seed, so any partitioning gives the same workload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stats import lcg

# Parts of a hundred of new_order, payment, order_status, deliver, stock_level.
TPCC_MIX = (("new_order", 45), ("payment", 43), ("order_status", 4), ("deliver", 4), ("stock_level", 4))
#: Parameters of the basic workload with their defaults.
BASIC = {"mh": 0, "mp": 0, "mh_homes": 2, "mp_parts": 2, "records": 10, "writes": 10, "hot": 0, "hot_records": 0}


def draw(x: Column, salt: int, below: int) -> Column:
    """A number from 0 to below - 1, by hash of x and a salt."""
    return F.pmod(F.floor(lcg(lcg(x + F.lit(salt * 7919))) / 64), F.lit(below))


def key_of(index: Column, home: Column, part: Column, partitions: int, regions: int) -> Column:
    """The key of an index in the list of a home and partition."""
    return (index * regions + home) * partitions + part


def is_hot(index: Column, hot: int, regions: int) -> Column:
    """The first keys of each list are hot, at least one."""
    return index < max(1, hot // regions)


def basic(spark: SparkSession, n: int, keys_per_list: int, partitions: int, regions: int, seed: int = 1, **params) -> DataFrame:
    """txn_id, place, key, is_write, home, part of n transactions with ``records`` different keys each.

    Keys stand at places of a transaction; each place draws its own residue of the list, so no two are equal. hot_records
    of the places, from one that is drawn for each transaction, take keys from the list's hot ones (the first hot / regions,
    at least one), each its own residue of those; the other places take cold keys.
    """
    unknown = set(params) - set(BASIC)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    p = {**BASIC, **params}
    t = F.col("id")
    homes = F.when(draw(t, seed, 100) < p["mh"], p["mh_homes"]).otherwise(1)
    parts = F.when(draw(t, seed + 1, 100) < p["mp"], p["mp_parts"]).otherwise(1)
    rows = spark.range(n).select(t.alias("txn_id"), homes.alias("homes"), parts.alias("parts"), draw(t, seed + 2, regions).alias("home0"), draw(t, seed + 3, partitions).alias("part0"), F.explode(F.sequence(F.lit(0), F.lit(p["records"] - 1))).alias("place"))
    home = F.pmod(F.col("home0") + F.pmod("place", F.col("homes")), F.lit(regions))
    part = F.pmod(F.col("part0") + F.pmod(F.floor(F.col("place") / F.col("homes")), F.col("parts")), F.lit(partitions))
    n_hot = max(1, p["hot"] // regions) if p["hot"] or p["hot_records"] else 0
    if p["hot_records"] > min(n_hot, p["records"]) or p["writes"] > p["records"]:
        raise ValueError("more hot records than hot keys or records, or more writes than records")
    per = max(1, (keys_per_list - n_hot) // p["records"])
    index = n_hot + draw(F.col("txn_id") * 31 + F.col("place"), seed + 4, per) * p["records"] + F.col("place")
    if p["hot_records"]:
        turn = F.pmod(F.col("place") + draw(F.col("txn_id"), seed + 5, p["records"]), F.lit(p["records"]))
        hot_index = draw(F.col("txn_id") * 31 + F.col("place"), seed + 6, n_hot // p["hot_records"]) * p["hot_records"] + turn
        index = F.when(turn < p["hot_records"], hot_index).otherwise(index)
    return rows.select("txn_id", "place", home.cast("long").alias("home"), part.cast("long").alias("part"), index.cast("long").alias("index")).select(
        "txn_id", "place", "home", "part", key_of(F.col("index"), F.col("home"), F.col("part"), partitions, regions).alias("key"), (F.col("place") < p["writes"]).alias("is_write")
    )


def remastering(txns: DataFrame, gap: int, regions: int) -> DataFrame:
    """Every gap-th transaction moves its key to the next region instead."""
    return txns.withColumn("new_master", F.when(F.pmod("txn_id", F.lit(gap)) == 0, F.pmod(F.col("home") + 1, F.lit(regions))))


def zipf_weights(n: int, exponent: float, spark: SparkSession) -> DataFrame:
    """rank and weight 1 / (rank^a * H) of n ranks."""
    w = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-exponent)).alias("w"))
    return w.select("rank", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def zipf_sample(draws: DataFrame, n: int, exponent: float, k: int, seed: int = 1) -> DataFrame:
    """k different of n ranks for each draw, as a sequential draw without replacement gives them: the least -ln(u) / weight."""
    u = (draw(F.col("draw") * 1009 + F.col("rank"), seed, 1 << 24) + 0.5) / (1 << 24)
    ranks = draws.select("draw", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))  # of regions or warehouses, a few
    keyed = ranks.withColumn("race", -F.log(u) * F.pow(F.col("rank").cast("double"), F.lit(exponent)))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy("race"))).where(F.col("place") <= k).select("draw", "place", "rank")


def zipf_inverse(u: Column, n: int, theta: float) -> Column:
    """A Zipf rank (from 0) by the closed form of Gray and others, from u in [0, 1)."""
    zeta = sum(1 / i**theta for i in range(1, n + 1)) if n <= 10_000 else sum(1 / i**theta for i in range(1, 10_001)) + (n ** (1 - theta) - 10_000 ** (1 - theta)) / (1 - theta)
    two = 1 + 0.5**theta
    alpha, eta = 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - two / zeta)
    return F.when(u * zeta < 1, 0).when(u * zeta < two, 1).otherwise(F.floor(n * F.pow(eta * u - eta + 1, alpha))).cast("long")


def cockroach(spark: SparkSession, n: int, keys: int, theta: float, regions: int, mh: int = 0, seed: int = 1) -> DataFrame:
    """The first key is Zipf-distributed, the second uniform; of multi-home transactions it is of another region."""
    t = F.col("id")
    u = (draw(t, seed, 1 << 24)) / (1 << 24)
    home, away = draw(t, seed + 1, regions), F.pmod(draw(t, seed + 1, regions) + 1 + draw(t, seed + 2, regions - 1), F.lit(regions))
    multi = draw(t, seed + 3, 100) < mh
    first = zipf_inverse(u, keys, theta) * regions + home
    second = draw(t, seed + 4, keys) * regions + F.when(multi, away).otherwise(home)
    return spark.range(n).select(t.alias("txn_id"), home.alias("home"), first.alias("first_key"), second.alias("second_key"), multi.alias("multi_home"))


def tpcc_mix(spark: SparkSession, n: int, warehouses: int, remote_percent: int = 1, seed: int = 1, mix=TPCC_MIX) -> DataFrame:
    """Procedure, warehouse, district and customer of each transaction; customers by NURand."""
    t, at, which = F.col("id"), 0, None
    lot = draw(t, seed, 100)
    for name, part in mix:
        at += part
        which = F.when(lot < at, name) if which is None else which.when(lot < at, name)
    w = draw(t, seed + 1, warehouses) + 1
    remote = (draw(t, seed + 2, 100) < remote_percent) & F.lit(warehouses > 1)
    supply = F.when(remote, F.pmod(w + draw(t, seed + 3, max(1, warehouses - 1)), F.lit(warehouses)) + 1).otherwise(w)
    customer = F.pmod(draw(t, seed + 4, 1024).bitwiseOR(draw(t, seed + 5, 3000)) + 259, F.lit(3000)) + 1
    return spark.range(n).select(t.alias("txn_id"), which.alias("procedure"), w.alias("w_id"), (draw(t, seed + 6, 10) + 1).alias("d_id"), customer.alias("c_id"), supply.alias("supply_w"), remote.alias("is_remote"))
