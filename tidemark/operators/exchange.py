"""What parts of a transaction send each other: remote reads, batches for siblings, events, and locks given back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .locks import waits


def parts(access: DataFrame, will_abort: Column) -> DataFrame:
    """A row for each transaction and partition that it involves: own reads, whether it writes (is active), and whether
    its own keys abort it. access: txn_id, part, is_write and what will_abort needs."""
    return access.groupBy("txn_id", "part").agg(F.count_if(~F.col("is_write")).alias("n_reads"), F.bool_or("is_write").alias("active"), F.bool_or(will_abort).alias("aborts"))


def remote_reads(of_parts: DataFrame) -> DataFrame:
    """Messages: each involved partition sends its reads and abort flag to the active ones other than itself.

    Receivers come from a window over the transaction, so rows meet once; they are as many as there are partitions.
    """
    active = F.collect_set(F.when(F.col("active"), F.col("part"))).over(Window.partitionBy("txn_id"))
    to = of_parts.withColumn("active_parts", active).withColumn("to_part", F.explode("active_parts")).where(F.col("to_part") != F.col("part"))
    return to.select("txn_id", F.col("part").alias("from_part"), "to_part", "n_reads", "aborts")


def with_remote_reads(of_parts: DataFrame) -> DataFrame:
    """Partitions of a transaction with what each waits for and then knows. An active one waits for all others, and
    aborts with any of them; a passive one waits for none and knows its own reads alone. In what is sent back to the
    client an abort of any part wins (merged_status)."""
    txn = Window.partitionBy("txn_id")
    every = {"n_parts": F.count(F.lit(1)).over(txn), "all_reads": F.sum("n_reads").over(txn), "any_aborts": F.bool_or("aborts").over(txn)}
    rows = of_parts.withColumns(every)
    status = lambda c: F.when(c, "ABORTED").otherwise("COMMITTED")
    return rows.select(
        "txn_id", "part", "active", F.when(F.col("active"), F.col("n_parts") - 1).otherwise(0).cast("long").alias("waiting_on"), F.when(F.col("active"), F.col("all_reads")).otherwise(F.col("n_reads")).alias("known_reads"),
        status(F.when(F.col("active"), F.col("any_aborts")).otherwise(F.col("aborts"))).alias("status"), status(F.col("any_aborts")).alias("merged_status"),
    )


def distributed(batches: DataFrame, local: int) -> DataFrame:
    """Batches as the partitions of region ``local`` get them. batches: batch_id, from_replica, from_partition, home,
    home_position, data (an array with an element a partition). The same partition of this region receives a batch of
    another one and passes the others' elements on; one from its own region carries the receiver's element alone."""
    own = F.col("from_replica") == local
    rows = batches.select("*", F.posexplode("data").alias("partition", "part_data"))
    kept = rows.where(~own | (F.col("partition") == F.col("from_partition")))
    return kept.withColumn("passed_on", ~own & (F.col("partition") != F.col("from_partition"))).drop("data")


def merged_events(events: DataFrame) -> DataFrame:
    """Events of a transaction's parts (txn_id, home, idx, event, time, machine) as one list: the main part, that of the
    least home, keeps all of its own; others add theirs from the cut-off on, the first place where any part differs
    from the main one, or the main one's length if none does. Every event bears its part's home."""
    txn, place = Window.partitionBy("txn_id"), Window.partitionBy("txn_id", "idx")
    what = F.struct("event", "time", "machine")
    rows = events.withColumn("is_main", F.col("home") == F.min("home").over(txn)).withColumn("main_size", F.count_if("is_main").over(txn))
    rows = rows.withColumn("main_event", F.max(F.when(F.col("is_main"), what)).over(place))
    differs = (F.col("idx") < F.col("main_size")) & ~what.eqNullSafe(F.col("main_event"))
    rows = rows.withColumn("cutoff", F.coalesce(F.min(F.when(differs, F.col("idx"))).over(txn), "main_size"))
    return rows.where(F.col("is_main") | (F.col("idx") >= F.col("cutoff"))).select(*events.columns)


def released(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Transactions (node) that become ready when those of ``gone`` (node) give their locks back: all that they wait for
    is gone. A transaction holds all of its locks before it ends, so none of ``gone`` waits itself."""
    left = edges.join(gone.select(F.col("node").alias("blocker"), F.lit(True).alias("gone")), "blocker", "left")
    return left.groupBy(F.col("waiter").alias("node")).agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("ready")).where("ready").select("node")


def aborted_early(requests: DataFrame, aborting: DataFrame) -> DataFrame:
    """Status of transactions when those of ``aborting`` (txn_id) are taken out before they are dispatched: their
    requests leave the queues, held or waiting, as though never made, and others move up."""
    rest = waits(requests.join(aborting, "txn_id", "left_anti")).select("txn_id", F.when(F.col("ready"), "READY").otherwise("WAITING").alias("status"))
    return rest.unionByName(aborting.select("txn_id").distinct().withColumn("status", F.lit("ABORTED")))


def remaster_requests(requests: DataFrame, new_master: Column) -> DataFrame:
    """Lock requests of a log in which a transaction that moves a key locks it in its old and in its new region."""
    more = requests.withColumn("master", new_master).where(F.col("master").isNotNull())
    return requests.unionByName(more.withColumn("name", F.concat_ws(":", "key", "master")))


def slot_prefix(slots: DataFrame, data: DataFrame) -> DataFrame:
    """Slots (slot, batch_id) from 0 on that have a batch whose data (batch_id) is there, up to the first that has not.

    The end is the least ready slot without a ready one behind it: an anti-join and a minimum, no window over the log.
    """
    there = slots.join(data.select("batch_id").distinct(), "batch_id", "left_semi")
    ends = there.join(there.select((F.col("slot") - 1).alias("slot")), "slot", "left_anti").agg(F.min("slot").alias("end"), F.lit(1).alias("one"))
    first = there.where("slot = 0").select(F.lit(1).alias("one")).distinct()
    return there.join(F.broadcast(ends.join(first, "one").select("end")), F.col("slot") <= F.col("end")).select("slot", "batch_id")
