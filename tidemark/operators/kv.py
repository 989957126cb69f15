"""Key-value procedures over a snapshot: all commands of a batch of transactions read the same pre-images.

PROC has txn_id, seq, command, a, b; ACCESS has txn_id, key, is_write. Commands on keys that are not declared, or not
declared for writing, do nothing, and neither do unknown commands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMANDS = ("GET", "SET", "DEL", "COPY", "EQ", "SLEEP")


def known(proc: DataFrame) -> DataFrame:
    return proc.where(F.col("command").isin(*COMMANDS))


def aborts(proc: DataFrame, access: DataFrame, store: DataFrame) -> DataFrame:
    """Transactions in which an EQ does not hold: the reasons, in the order of the commands."""
    eq = proc.where("command = 'EQ'").select("txn_id", "seq", F.col("a").alias("key"), F.col("b").alias("expected"))
    read = eq.join(access.select("txn_id", "key"), ["txn_id", "key"]).join(store.select("key", "value"), "key")
    wrong = read.where(F.col("value") != F.col("expected"))
    reason = F.concat_ws(" ", F.lit("Key"), F.col("key").cast("string"), F.lit("is not"), F.col("expected"))
    return wrong.groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("seq", reason.alias("reason")))).alias("r")).select("txn_id", F.array_join("r.reason", "; ").alias("abort_reason"))


def effects(proc: DataFrame, access: DataFrame, store: DataFrame) -> DataFrame:
    """txn_id, key, new_value, deleted of every write that a transaction makes: the last command on a key holds."""
    writes = access.where("is_write").select("txn_id", "key")
    sets = proc.where("command = 'SET'").select("txn_id", "seq", F.col("a").alias("key"), F.col("b").alias("value"), F.lit(False).alias("deleted"))
    dels = proc.where("command = 'DEL'").select("txn_id", "seq", F.col("a").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))
    copy = proc.where("command = 'COPY'").select("txn_id", "seq", F.col("a").alias("source"), F.col("b").cast("long").alias("key"))
    declared = access.select("txn_id", F.col("key").alias("source"))
    copies = copy.join(declared, ["txn_id", "source"]).join(store.select(F.col("key").alias("source"), "value"), "source").select("txn_id", "seq", "key", "value", F.lit(False).alias("deleted"))
    every = sets.unionByName(dels).unionByName(copies).join(writes, ["txn_id", "key"], "left_semi")
    return every.groupBy("txn_id", "key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("w")).select("txn_id", "key", F.col("w.value").alias("new_value"), "w.deleted")


def committed_writes(access: DataFrame, done: DataFrame, aborted: DataFrame) -> DataFrame:
    """Writes of transactions that commit: a key declared for writing that no command set gets an empty value."""
    writes = access.where("is_write").join(aborted, "txn_id", "left_anti")
    out = writes.join(done, ["txn_id", "key"], "left")
    return out.select("txn_id", "key", F.when(F.col("deleted"), F.lit(None)).otherwise(F.coalesce("new_value", F.lit(""))).alias("value"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


def execute(proc: DataFrame, access: DataFrame, store: DataFrame) -> DataFrame:
    """Status and abort reason of each transaction."""
    wrong = aborts(proc, access, store)
    txns = access.select("txn_id").distinct()
    return txns.join(wrong, "txn_id", "left").select("txn_id", F.when(F.col("abort_reason").isNull(), "COMMITTED").otherwise("ABORTED").alias("status"), F.coalesce("abort_reason", F.lit("")).alias("abort_reason"))


def no_op(txns: DataFrame) -> DataFrame:
    return txns.select("txn_id", F.lit("COMMITTED").alias("status"))


#: How a transaction is executed, by the kind that a configuration names; anything unknown does nothing.
EXECUTIONS = {"KEY_VALUE": execute}


def execution(kind: str):
    return EXECUTIONS.get(kind, lambda proc, access, store: no_op(access.select("txn_id").distinct()))
