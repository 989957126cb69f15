"""Dependencies between transactions of a log: who waits for whom, and in which order they can run.

Requests have pos (place in the log), txn_id, name (the lock: a key in a region) and is_write. A read waits for the
last write before it; a write waits for the reads since the last write, or for that write if there are none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared


def epochs(requests: DataFrame) -> DataFrame:
    """Requests with the position of the last write before them, and of the reads between."""
    before = Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("last_write", F.last(F.when(F.col("is_write"), F.col("pos")), ignorenulls=True).over(before))


def wait_edges(requests: DataFrame) -> DataFrame:
    """(blocker, waiter) positions. Reads join the epoch that they stand in with the write that ends it."""
    rows = epochs(requests)
    read_waits = rows.where(~F.col("is_write") & F.col("last_write").isNotNull()).select(F.col("last_write").alias("blocker"), F.col("pos").alias("waiter"))
    reads = rows.where(~F.col("is_write")).select("name", F.coalesce("last_write", F.lit(-1)).alias("epoch"), F.col("pos").alias("blocker"))
    writes = rows.where("is_write").select("name", F.coalesce("last_write", F.lit(-1)).alias("epoch"), F.col("pos").alias("waiter"), "last_write")
    # an epoch ends with one write, so this is a join on (name, epoch) of one row on the right
    write_waits = reads.join(writes.drop("last_write"), ["name", "epoch"]).select("blocker", "waiter")
    unread = writes.where(F.col("last_write").isNotNull()).join(reads.select("name", "epoch"), ["name", "epoch"], "left_anti")
    return read_waits.unionByName(write_waits).unionByName(unread.select(F.col("last_write").alias("blocker"), "waiter")).distinct()


def holders(requests: DataFrame) -> DataFrame:
    """Which requests a lock grants at once while none is released: the first, and reads before any write."""
    rows = epochs(requests)
    first = Window.partitionBy("name").orderBy("pos")
    return rows.select("pos", "txn_id", "name", "is_write", ((~F.col("is_write") & F.col("last_write").isNull()) | (F.row_number().over(first) == 1)).alias("granted"))


def waits(requests: DataFrame) -> DataFrame:
    """For each transaction: locks asked for, granted and waited for; it is ready if it waits for none."""
    return holders(requests).groupBy("txn_id").agg(F.count(F.lit(1)).alias("n_locks"), F.count_if(~F.col("granted")).alias("n_waiting")).withColumn("ready", F.col("n_waiting") == 0)


BLOCK_EDGES = 2_000_000


def levels(edges: DataFrame, most: int | None = None, nodes: DataFrame | None = None, block_edges: int = BLOCK_EDGES, at_once: int | None = None) -> DataFrame:
    """node -> level: the longest way to it from a node that waits for none; nodes of a level can run together.

    Nodes are positions in a log, so a waiter comes behind its blockers. nodes: all there are; without it those that have
    an edge. most: a level that no node may reach.

    The log is cut into blocks of about so many edges, and a task goes through a block once, in order, however long its
    chains are. ``at_once`` blocks run together and tell each other their levels until none rises, which takes no more
    rounds than chains cross blocks; then they are done and tell those behind them, each edge once. So passes over an edge
    are ``at_once`` at most, whatever the length of the log or of a chain.
    """
    spark = edges.sparkSession
    folder = shared.shared_folder(spark, "levels")
    edges.select("blocker", "waiter").write.parquet(f"{folder}/edges")
    edges = spark.read.schema("blocker long, waiter long").parquet(f"{folder}/edges")
    if nodes is None:
        nodes = edges.select(F.col("blocker").alias("node")).unionByName(edges.select(F.col("waiter").alias("node"))).distinct()
    count, low, high, back = edges.agg(F.count(F.lit(1)), F.min("waiter"), F.max("waiter"), F.count_if(F.col("blocker") >= F.col("waiter"))).first()
    if back:
        raise ValueError("a waiter stands before its blocker, or waits go in a circle")
    if not count:
        return nodes.select("node", F.lit(0).cast("long").alias("level"))
    at_once = at_once or max(4, spark.sparkContext.defaultParallelism)
    block, blocks = _blocks(edges, count, low, high, block_edges)
    told = _cut_up(edges, block, folder)

    done: list[str] = []
    for first in range(0, blocks, at_once):
        done += _settled(spark, folder, block, range(first, min(first + at_once, blocks)), told)
    level = spark.read.schema("node long, level long").parquet(*done)
    if most is not None and level.agg(F.max("level")).first()[0] >= most:
        raise ValueError("a chain of waits is longer than allowed")
    return nodes.select("node").join(level, "node", "left").select("node", F.coalesce("level", F.lit(0).cast("long")).alias("level"))


def _blocks(edges: DataFrame, count: int, low: int, high: int, block_edges: int) -> tuple[Callable[[Column], Column], int]:
    """The block of a position, and how many there are: cells of equal width, counted and put together by their edges."""
    cells = 64 * -(-count // block_edges)
    width = (high - low) // cells + 1
    cell = lambda at: F.greatest(F.floor((at - low) / width), F.lit(0))
    of_cell, number, inside = [0] * cells, 0, 0
    sizes = dict(tuple(r) for r in edges.groupBy(cell(F.col("waiter")).alias("cell")).count().collect())
    for c in range(cells):
        if inside and inside + sizes.get(c, 0) > block_edges:
            number, inside = number + 1, 0
        of_cell[c], inside = number, inside + sizes.get(c, 0)
    known = F.split(F.lit(",".join(map(str, of_cell))), ",").cast("array<int>")
    return (lambda at: F.get(known, F.least(cell(at), F.lit(cells - 1)).cast("int"))), number + 1


def _cut_up(edges: DataFrame, block: Callable[[Column], Column], folder: str) -> set[tuple[int, int]]:
    """Edges within blocks into ``inner``, by block, with a row of level 1 for each waiter that has others; these into
    ``cross``, by the blocker's block. Gives the pairs of blocks between which there are any."""
    spark = edges.sparkSession
    placed = edges.select("blocker", "waiter", block(F.col("blocker")).alias("from_block"), block(F.col("waiter")).alias("block"))
    same = F.col("from_block") == F.col("block")
    one = placed.where(~same).select("block", "waiter", F.lit(None).cast("long").alias("blocker"), F.lit(1).cast("long").alias("level")).distinct()
    inner = placed.where(same).select("block", "waiter", "blocker", F.lit(None).cast("long").alias("level")).unionByName(one)
    inner.repartition("block").write.partitionBy("block").parquet(f"{folder}/inner")
    placed.where(~same).repartition("from_block").write.partitionBy("from_block").parquet(f"{folder}/cross")
    cross = spark.read.schema(_CROSS).parquet(f"{folder}/cross")
    return {tuple(r) for r in cross.select("from_block", "block").distinct().collect()}


_INNER, _CROSS, _HEARD = "waiter long, blocker long, level long, block int", "blocker long, waiter long, block int, from_block int", "waiter long, level long, block int"


def _settled(spark: SparkSession, folder: str, block: Callable[[Column], Column], those: range, told: set[tuple[int, int]]) -> list[str]:
    """Levels of the waiters of these blocks, a folder a block, once all blocks before them are done."""
    mine = lambda c: F.col(c).between(those[0], those[-1])
    among = any(a in those and b in those for a, b in told)
    inner = spark.read.schema(_INNER).parquet(f"{folder}/inner")
    cross = spark.read.schema(_CROSS).parquet(f"{folder}/cross").where(mine("from_block"))
    heard = spark.read.schema(_HEARD).parquet(f"{folder}/heard").where(mine("block")) if any(a < those[0] and b in those for a, b in told) else None
    latest, sums, again, news = {}, {}, list(those), None
    for turn in range(len(those) + 1):
        rows = inner
        for more in (heard, news):
            rows = rows if more is None else rows.unionByName(more, allowMissingColumns=True)
        at = f"{folder}/turn-{those[0]}-{turn}"
        in_order = rows.where(F.col("block").isin(again)).repartitionById(len(those), F.col("block") - those[0]).sortWithinPartitions("waiter")
        in_order.select("waiter", "blocker", "level").mapInArrow(_pass, "node long, level long").withColumn("block", block(F.col("node"))).write.partitionBy("block").parquet(at)
        latest |= {b: f"{at}/block={b}" for b in again}
        if not among:
            break
        _tell(spark, cross.where(F.col("block") <= those[-1]), latest).write.parquet(f"{at}-news")
        news = spark.read.schema(_HEARD).parquet(f"{at}-news")
        now = {r[0]: r[1] for r in news.groupBy("block").agg(F.sum("level")).collect()}
        again, sums = [b for b, n in now.items() if sums.get(b) != n], now  # levels only rise
        if not again:
            break
    if any(a in those and b > those[-1] for a, b in told):
        _tell(spark, cross.where(F.col("block") > those[-1]), latest).write.mode("append").partitionBy("block").parquet(f"{folder}/heard")
    return list(latest.values())


def _tell(spark: SparkSession, cross: DataFrame, latest: dict[int, str]) -> DataFrame:
    level = spark.read.schema("node long, level long").parquet(*latest.values())
    of = cross.join(level, cross["blocker"] == level["node"], "left")
    return of.groupBy("waiter", "block").agg((F.max(F.coalesce("level", F.lit(0))) + 1).alias("level")).select("waiter", "level", "block")


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's rows in the order of waiters: an edge within the block, or a level that the waiter has at least."""
    level: dict[int, int] = {}
    for batch in batches:
        for waiter, blocker, least in zip(*(c.to_pylist() for c in batch.columns)):
            if blocker is not None:
                least = level.get(blocker, 0) + 1
            if least > level.get(waiter, 0):
                level[waiter] = least
    yield pa.RecordBatch.from_arrays([pa.array(level.keys(), pa.int64()), pa.array(level.values(), pa.int64())], names=["node", "level"])


def assembled(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Multi-home transactions and whether a lock-only part of every region that they involve has arrived."""
    seen = parts.groupBy("txn_id").agg(F.count_distinct("home").alias("n_seen"))
    return expected.join(seen, "txn_id", "left").select("txn_id", "n_homes", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), (F.coalesce("n_seen", F.lit(0)) == F.col("n_homes")).alias("ready"))


def verify_counter(txn_counter: Column, store_counter: Column, same_master: Column) -> Column:
    """ABORT for a key that has moved on since, WAIT for a move that is still to come, else VALID if masters agree."""
    return F.when(txn_counter < store_counter, "ABORT").when(txn_counter > store_counter, "WAIT").when(same_master, "VALID").otherwise("ABORT")


def behind(rows: DataFrame, queue: list[str], order: list[str]) -> DataFrame:
    """Rows with whether one before them in their queue waits: a waiting head blocks all behind it."""
    before = Window.partitionBy(*queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("blocked", F.coalesce(F.max(F.col("verdict") == "WAIT").over(before), F.lit(False)))


def behind_first(rows: DataFrame, queue: list[str], order: list[str]) -> DataFrame:
    """As behind(), for few and long queues: the first that waits is a partial aggregate, so no queue is sorted."""
    first = rows.where(F.col("verdict") == "WAIT").groupBy(*queue).agg(F.min(F.struct(*order)).alias("first_wait"))
    blocked = F.coalesce(F.struct(*order) > F.col("first_wait"), F.lit(False))
    return rows.join(F.broadcast(first), queue, "left").withColumn("blocked", blocked).drop("first_wait")


def master_at(accesses: DataFrame, start: Column) -> DataFrame:
    """The master of each key as of each place in the log: what the last move before it made it, at first ``start``."""
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return accesses.withColumn("master_then", F.coalesce(F.last("new_master", ignorenulls=True).over(before), start))
