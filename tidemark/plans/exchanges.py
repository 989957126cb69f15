"""Queries of remote reads, distribution, merged events, released locks and the multi-home order."""

from pyspark.sql import functions as F

from ..operators import exchange as E
from ..operators import locks as L
from ..operators import ordering as O
from .catalog import ACCESS_ARITH, access_arith, query, table, tasks
from .logs import _BATCHED, DURATION, EDGES, _events, requests

_PARTS = f"""{ACCESS_ARITH}, pt AS (SELECT txn_id, part, count(*) FILTER (WHERE NOT is_write) AS n_reads, bool_or(is_write) AS active, bool_or(NOT is_write AND key % 23 = 0) AS aborts FROM acc GROUP BY ALL)"""


def _parts(spark, d):
    return E.parts(access_arith(spark, d), ~F.col("is_write") & (F.pmod("key", F.lit(23)) == 0))


@query(f"WITH {_PARTS} SELECT s.txn_id, s.part AS from_part, r.part AS to_part, s.n_reads, s.aborts FROM pt s JOIN pt r ON s.txn_id = r.txn_id AND s.part <> r.part AND r.active")
def remote_read_messages(spark, d):
    """Who sends reads to whom."""
    return E.remote_reads(_parts(spark, d))


@query(f"""WITH {_PARTS}, al AS (SELECT txn_id, count(*) AS n, CAST(sum(n_reads) AS BIGINT) AS reads, bool_or(aborts) AS ab FROM pt GROUP BY 1)
SELECT txn_id, part, active, CASE WHEN active THEN n - 1 ELSE 0 END AS waiting_on, CASE WHEN active THEN reads ELSE n_reads END AS known_reads, CASE WHEN CASE WHEN active THEN ab ELSE aborts END THEN 'ABORTED' ELSE 'COMMITTED' END AS status,
CASE WHEN ab THEN 'ABORTED' ELSE 'COMMITTED' END AS merged_status FROM pt JOIN al USING (txn_id)""")
def remote_read_wait(spark, d):
    """What active and passive partitions wait for and come to."""
    return E.with_remote_reads(_parts(spark, d))


@query("""WITH c AS (SELECT l_orderkey // 8 AS batch_id, l_partkey % 4 AS partition, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT DISTINCT l_orderkey // 8 AS batch_id FROM lineitem), g AS (SELECT batch_id, CAST(p AS INT) AS partition FROM b, (SELECT unnest(range(4)) AS p))
SELECT batch_id, batch_id % 3 AS from_replica, batch_id % 4 AS from_partition, batch_id % 3 AS home, batch_id // 12 AS home_position, partition, coalesce(n, 0) AS part_data, batch_id % 3 <> 1 AND partition <> batch_id % 4 AS passed_on
FROM g LEFT JOIN c USING (batch_id, partition) WHERE batch_id % 3 <> 1 OR partition = batch_id % 4""")
def distribute_batches(spark, d):
    """Batches of eight orders as region 1 deals them; the data of a partition is its number of lines."""
    batch, part = F.floor(F.col("l_orderkey") / 8), F.pmod("l_partkey", F.lit(4))
    b = table(spark, d, "lineitem").groupBy(batch.alias("batch_id")).agg(F.array(*(F.count_if(part == p) for p in range(4))).alias("data"))
    home = F.pmod("batch_id", F.lit(3))
    return E.distributed(b.select("batch_id", home.alias("from_replica"), F.pmod("batch_id", F.lit(4)).alias("from_partition"), home.alias("home"), F.floor(F.col("batch_id") / 12).alias("home_position"), "data"), 1)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS txn_id, l_suppkey % 3 AS home FROM lineitem), e AS (
SELECT txn_id, home, 0 AS idx, 'ENTER_SERVER' AS event, txn_id * 100 AS time, txn_id % 4 AS machine FROM p UNION ALL SELECT txn_id, home, 1, 'ENTER_FORWARDER', txn_id * 100 + CASE WHEN txn_id % 5 = 0 AND home = 2 THEN 2 ELSE 1 END, txn_id % 4 FROM p
UNION ALL SELECT txn_id, home, 2, 'ENTER_LOCK_MANAGER', txn_id * 100 + 10 + home, txn_id % 3 FROM p WHERE txn_id % 7 <> 0), m AS (SELECT txn_id, min(home) AS mh FROM p GROUP BY 1),
c AS (SELECT e.txn_id, min(e.idx) AS cut FROM e JOIN m USING (txn_id) JOIN e f ON f.txn_id = e.txn_id AND f.home = mh AND f.idx = e.idx WHERE (e.event, e.time, e.machine) <> (f.event, f.time, f.machine) GROUP BY 1)
SELECT e.txn_id, e.home, e.idx, e.event, e.time, e.machine FROM e JOIN m USING (txn_id) LEFT JOIN c USING (txn_id) WHERE e.home = mh OR e.idx >= coalesce(cut, CASE WHEN txn_id % 7 = 0 THEN 2 ELSE 3 END)""")
def merge_events(spark, d):
    """Lock-only parts share their first events; some differ in the second."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.pmod("l_suppkey", F.lit(3)).alias("home"))
    p = p.repartition(tasks(spark, d, "lineitem"), "txn_id").distinct()
    t, home = F.col("txn_id"), F.col("home")
    step = lambda i, name, time, machine: F.struct(F.lit(i).alias("idx"), F.lit(name).alias("event"), time.alias("time"), machine.alias("machine"))
    second = t * 100 + F.when((F.pmod(t, F.lit(5)) == 0) & (home == 2), 2).otherwise(1)
    steps = F.array(step(0, "ENTER_SERVER", t * 100, F.pmod(t, F.lit(4))), step(1, "ENTER_FORWARDER", second, F.pmod(t, F.lit(4))), step(2, "ENTER_LOCK_MANAGER", t * 100 + 10 + home, F.pmod(t, F.lit(3))))
    e = p.select("txn_id", "home", F.explode(steps).alias("s")).select("txn_id", "home", "s.*")
    return E.merged_events(e.where((F.col("idx") < 2) | (F.pmod("txn_id", F.lit(7)) != 0)))


@query(f"""WITH {EDGES}, go AS (SELECT DISTINCT pos FROM req WHERE pos % 2 = 1 AND pos NOT IN (SELECT waiter FROM edge))
SELECT waiter AS node FROM edge GROUP BY waiter HAVING bool_and(blocker IN (SELECT pos FROM go))""")
def lock_release(spark, d):
    """I4: who becomes ready when all odd transactions that were ready at once have ended."""
    rows = requests(spark, d)
    edges = L.wait_edges(rows)
    ready = rows.where(F.pmod("pos", F.lit(2)) == 1).select(F.col("pos").alias("node")).distinct().join(edges.select(F.col("waiter").alias("node")), "node", "left_anti")
    return E.released(edges, ready)


_GRANTS = """ep AS (SELECT *, last_value(CASE WHEN is_write THEN pos END IGNORE NULLS) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lw FROM req),
h AS (SELECT *, (NOT is_write AND lw IS NULL) OR row_number() OVER (PARTITION BY name ORDER BY pos) = 1 AS granted FROM ep)"""


@query(f"""WITH {ACCESS_ARITH}, req AS (SELECT txn_id AS pos, txn_id, key || ':' || master AS name, is_write FROM acc UNION ALL SELECT txn_id, txn_id, key || ':' || (master + 1) % 3, is_write FROM acc WHERE is_write AND txn_id % 10 = 0), {_GRANTS}
SELECT txn_id, count(*) AS n_locks, count(*) FILTER (WHERE NOT granted) AS n_waiting, count(*) FILTER (WHERE NOT granted) = 0 AS ready FROM h GROUP BY txn_id""")
def lock_waits_remaster(spark, d):
    """Locks by key and region; a move takes two."""
    moves = F.when(F.col("is_write") & (F.pmod("txn_id", F.lit(10)) == 0), F.pmod(F.col("master") + 1, F.lit(3)))
    return L.waits(E.remaster_requests(requests(spark, d), moves))


@query(f"""WITH {ACCESS_ARITH}, ab AS (SELECT DISTINCT txn_id FROM acc WHERE key % 37 = 5), req AS (SELECT txn_id AS pos, txn_id, key || ':' || master AS name, is_write FROM acc WHERE txn_id NOT IN (SELECT txn_id FROM ab)), {_GRANTS}
SELECT txn_id, CASE WHEN count(*) FILTER (WHERE NOT granted) = 0 THEN 'READY' ELSE 'WAITING' END AS status FROM h GROUP BY txn_id UNION ALL SELECT txn_id, 'ABORTED' FROM ab""")
def pre_dispatch_abort(spark, d):
    """Transactions with a key that aborts them leave the lock queues before they run."""
    rows = requests(spark, d)
    return E.aborted_early(rows, rows.where(F.pmod("key", F.lit(37)) == 5).select("txn_id"))


@query(f"{_BATCHED}, r AS (SELECT machine, batch_start, unnest(list_distinct([id % 5, machine])) AS region, id FROM b) SELECT machine, batch_start, region, count(*) AS n, min(id) AS first_id FROM r GROUP BY ALL")
def mh_batches(spark, d):
    """H6: anchored batches of multi-home transactions, each transaction in the batch of every region that it involves."""
    b = O.anchored_batches(_events(spark, d), DURATION, 0)
    r = b.withColumn("region", F.explode(F.array_distinct(F.array(F.pmod("id", F.lit(5)), "machine"))))
    return r.groupBy("machine", "batch_start", "region").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("SELECT o_orderkey AS slot, o_orderkey * 7 + 3 AS batch_id FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 1000 = 777)")
def mh_global_order(spark, d):
    """H7: slots in order, up to the first whose batch has not come (one in a thousand here)."""
    slots = table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), (F.col("o_orderkey") * 7 + 3).alias("batch_id"))
    return E.slot_prefix(slots, slots.where(F.pmod("slot", F.lit(1000)) != 777).select("batch_id"))
