"""Analysis and routing of transactions.

ACCESS has a row for each transaction and key: txn_id, key, part, master, is_write. All operators are aggregations by
transaction with partial sums, or projections; none needs more of a transaction than its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, SINGLE, MULTI = "UNKNOWN", "SINGLE_HOME", "MULTI_HOME_OR_LOCK_ONLY"


def joined(values: Column) -> Column:
    """A set of numbers in order, apart by ';'."""
    return F.array_join(F.sort_array(values), ";")


def classify(access: DataFrame) -> DataFrame:
    """Type, home, and the partitions and regions that each transaction involves.

    Numbers of partitions and homes are sizes of the sets, as distinct counts beside them would multiply the rows.
    """
    return (
        access.groupBy("txn_id")
        .agg(
            F.min("master").alias("low"), F.max("master").alias("high"), F.count_if(F.col("master").isNull()).alias("unplaced"), F.count_if("is_write").alias("n_writes"),
            F.sort_array(F.collect_set("part")).alias("parts"), F.collect_set(F.when(F.col("is_write"), F.col("part"))).alias("written"), F.collect_set("master").alias("masters"),
        )
        .select(
            "txn_id",
            F.when(F.col("unplaced") > 0, UNKNOWN).when(F.col("low") == F.col("high"), SINGLE).otherwise(MULTI).alias("type"),
            F.when((F.col("unplaced") == 0) & (F.col("low") == F.col("high")), F.col("low")).otherwise(-1).cast("int").alias("home"),
            joined(F.col("parts")).alias("involved_partitions"), joined(F.col("written")).alias("active_partitions"), joined(F.col("masters")).alias("involved_regions"),
            F.size("parts").cast("long").alias("n_parts"), F.size("masters").cast("long").alias("n_homes"), "n_writes", "parts",
        )
    )


def with_masters(access: DataFrame, store: DataFrame, default: Column | None = None) -> DataFrame:
    """Masters from the store by key; ``default`` for keys that it lacks, else null."""
    found = access.drop("master").join(store.select("key", "master"), "key", "left")
    return found if default is None else found.withColumn("master", F.coalesce("master", default))


def route(typed: DataFrame, local: DataFrame) -> DataFrame:
    """Where a transaction goes: its own region's sequencer, a remote one's, or the orderer.

    The partition of a remote region is drawn from the involved ones by the transaction's number, so reruns agree.
    """
    pick = F.element_at("parts", (F.pmod(F.col("txn_id"), F.size("parts")) + 1).cast("int"))
    where = (
        F.when(F.col("type") == UNKNOWN, "lookup").when(F.col("type") == MULTI, "orderer").when(F.col("home") == F.col("coord"), "local sequencer").otherwise("remote sequencer")
    )
    return (
        typed.join(local, "txn_id")
        .select("txn_id", "type", "home", "coord", where.alias("destination"), F.when(where == "remote sequencer", pick).otherwise(-1).cast("long").alias("to_partition"))
    )


def lock_only(access: DataFrame, typed: DataFrame) -> DataFrame:
    """A part of each multi-home transaction for each region that it involves."""
    multi = typed.where(F.col("type") == MULTI).select("txn_id")
    return access.join(multi, "txn_id", "left_semi").select("txn_id", F.col("master").alias("home")).distinct()


def project(access: DataFrame, parts: DataFrame) -> DataFrame:
    """Sub-transactions of each lock-only part and partition: number of keys, and whether none of them is homed there.

    A sub-transaction without a key of its home is redundant, and is dropped by whoever asks for those that aren't.
    """
    rows = parts.join(access, "txn_id")
    return rows.groupBy("txn_id", "home", "part").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("master") == F.col("home")).alias("n_own")).withColumn("redundant", F.col("n_own") == 0)


def sub_transactions(access: DataFrame) -> DataFrame:
    """``project`` for all lock-only parts of all multi-home transactions, without joins: a transaction's keys are counted by
    partition and home, so what is brought together is a row for each of those, however many keys it has."""
    cells = access.where(F.col("txn_id").isNotNull()).groupBy("txn_id", "part", "master").agg(F.count(F.lit(1)).alias("n"))
    txns = cells.groupBy("txn_id").agg(F.collect_list(F.struct("part", "master", "n")).alias("cells"), F.count_if(F.col("master").isNull()).alias("unplaced"), F.min("master").alias("low"), F.max("master").alias("high"))
    multi = txns.where((F.col("unplaced") == 0) & (F.col("low") != F.col("high")))
    homes = multi.select("txn_id", "cells", F.explode(F.array_distinct("cells.master")).alias("home"))
    subs = homes.select("txn_id", "home", "cells", F.explode(F.array_distinct("cells.part")).alias("part"))
    keys = lambda of: F.aggregate(F.filter("cells", of), F.lit(0).cast("long"), lambda n, c: n + c["n"])
    here = lambda c: c["part"].eqNullSafe(F.col("part"))
    rows = subs.select("txn_id", "home", "part", keys(here).alias("n_keys"), keys(lambda c: here(c) & (c["master"] == F.col("home"))).alias("n_own"))
    return rows.withColumn("redundant", F.col("n_own") == 0)


def surplus(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row, n_differing: rows of the first table that the second lacks, counting repeats, by one aggregation of both."""
    signed = first.select("*", F.lit(1).alias("sign")).unionByName(second.select("*", F.lit(-1).alias("sign")))
    left = signed.groupBy(*first.columns).agg(F.sum("sign").alias("left")).where("left > 0")
    return left.agg(F.coalesce(F.sum("left"), F.lit(0).cast("long")).alias("n_differing"))


def without_keys(txns: DataFrame, access: DataFrame) -> DataFrame:
    """Transactions that access no key are aborted."""
    return txns.join(access.select("txn_id"), "txn_id", "left_anti").select("txn_id", F.lit("ABORTED").alias("status"), F.lit("Txn accesses no key").alias("abort_reason"))


def merge(subs: DataFrame, expected: DataFrame) -> DataFrame:
    """Results of sub-transactions (txn_id, part, home, aborted, reason, n_keys) into one; complete if all are there."""
    return (
        subs.groupBy("txn_id")
        .agg(F.bool_or("aborted").alias("aborted"), F.min(F.when(F.col("aborted"), F.col("reason"))).alias("abort_reason"), F.count(F.lit(1)).alias("n_parts"), joined(F.collect_set("home")).alias("regions"), F.sum("n_keys").alias("n_keys"))
        .join(expected, "txn_id")
        .select(
            "txn_id", F.when(F.col("aborted"), "ABORTED").otherwise("COMMITTED").alias("status"), F.coalesce("abort_reason", F.lit("")).alias("abort_reason"), "regions",
            F.when(F.col("aborted"), 0).otherwise(F.col("n_keys")).alias("n_keys"), (F.col("n_parts") == F.col("n_expected")).alias("complete"),
        )
    )


def differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """Transactions (txn_id) of two logs (txn_id, key, is_write) whose ordered keys aren't the same, or that one log lacks."""

    def keys(log: DataFrame, name: str) -> DataFrame:
        return log.groupBy("txn_id").agg(F.sort_array(F.collect_list(F.struct("key", "is_write"))).alias(name))

    both = keys(first, "these").join(keys(second, "those"), "txn_id", "full")
    return both.where(~F.col("these").eqNullSafe(F.col("those"))).select("txn_id", F.col("these").isNotNull().alias("in_first"), F.col("those").isNotNull().alias("in_second"))


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of tables of the same columns: of each key the row of the first table that has it (the least of several)."""
    union = None
    for k, rows in enumerate(sources):
        ranked = rows.select(F.lit(k).alias("from_source"), *sources[0].columns)
        union = ranked if union is None else union.unionByName(ranked)
    row = F.struct("from_source", *(c for c in sources[0].columns if c != key))
    return union.groupBy(key).agg(F.min(row).alias("row")).select(key, "row.*")


def remaster(access: DataFrame, new_master: Column) -> DataFrame:
    """A move of each key: multi-home by definition, with a lock-only part in the old and in the new region."""
    return access.select(
        "key", F.col("master").alias("old_master"), new_master.cast("long").alias("new_master"), F.lit(MULTI).alias("type"),
        F.array_join(F.sort_array(F.array_distinct(F.array(F.col("master").cast("long"), new_master.cast("long")))), ";").alias("involved_regions"),
    )
