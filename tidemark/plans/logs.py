"""Queries of batching, ordering and dependencies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import locks as L
from ..operators import ordering as O
from .catalog import ACCESS_ARITH, access_arith, query, table


def _events(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("machine"), F.col("event_id").alias("id"), t.alias("t"))


DURATION, MOST = 3_600_000_000, 20
_BATCHED = f"""WITH RECURSIVE e AS (SELECT user_id % 4 AS machine, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT machine, id, t, n, t AS batch_start, 0 AS place FROM e WHERE n = 1
  UNION ALL SELECT e.machine, e.id, e.t, e.n, CASE WHEN e.t >= b.batch_start + {DURATION} THEN e.t ELSE b.batch_start END, CASE WHEN e.t >= b.batch_start + {DURATION} THEN 0 ELSE b.place + 1 END
  FROM b JOIN e ON e.machine = b.machine AND e.n = b.n + 1)"""


@query(f"{_BATCHED} SELECT machine, id, t, batch_start, CAST(place // {MOST} AS BIGINT) AS sub_batch, CAST(place % {MOST} AS BIGINT) AS place FROM b")
def batch_anchored(spark, d):
    return O.anchored_batches(_events(spark, d), DURATION, MOST)


@query(f"{_BATCHED} SELECT machine, count(DISTINCT (batch_start, place // {MOST})) AS n_batches, CAST(count(*) AS BIGINT) AS n_events FROM b GROUP BY machine")
def batch_stats(spark, d):
    b = O.in_batches(_events(spark, d), DURATION).groupBy("machine", "batch_start").agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("machine").agg(F.sum(F.ceil(F.col("n") / MOST)).alias("n_batches"), F.sum("n").alias("n_events"))


@query("SELECT event_id, epoch_us(ts) + (event_id % 7) * 1000 AS sent_at, epoch_us(ts) + (event_id % 7) * 1000 + CASE WHEN event_id % 100 < 10 THEN 50000 ELSE 0 END AS replicated_at FROM events")
def sequencer_delay(spark, d):
    sent = F.col("t") + F.pmod("id", F.lit(7)) * 1000
    return _events(spark, d).select(F.col("id").alias("event_id"), sent.alias("sent_at"), O.delayed(sent, 10, 50000, F.col("id")).alias("replicated_at"))


@query("SELECT o_orderkey, o_custkey % 4 AS machine, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderdate, o_orderkey) - 1 AS home_position FROM orders")
def home_position(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.pmod("o_custkey", F.lit(4)).alias("machine"))
    return O.home_position(o, "machine", ["o_orderdate", "o_orderkey"], F.col("o_orderdate")).select("o_orderkey", "machine", F.col("home_position").cast("long").alias("home_position"))


def _slots(spark, d):
    """Slot i names the queue of order i; queues have their batches in order of order key, one in fifty not yet there."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), F.pmod("o_custkey", F.lit(4)).alias("queue"))
    positions = O.home_position(o.withColumnRenamed("slot", "batch_id"), "queue", ["batch_id"], O.by_key("batch_id")).withColumnRenamed("home_position", "position")
    return o, positions.where(F.pmod("batch_id", F.lit(5000)) != 4321)


_SLOTS = """o AS (SELECT o_orderkey AS slot, o_custkey % 4 AS queue, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS position FROM orders),
l AS (SELECT slot, queue, position, CASE WHEN slot % 5000 <> 4321 THEN slot END AS batch_id FROM o)"""


@query(f"WITH {_SLOTS} SELECT slot, queue, position, coalesce(batch_id, -1) AS batch_id FROM l")
def local_log_order(spark, d):
    slots, positions = _slots(spark, d)
    return O.local_log(slots, positions).select("slot", "queue", F.col("position").cast("long").alias("position"), F.coalesce("batch_id", F.lit(-1).cast("long")).alias("batch_id"))


@query(f"WITH {_SLOTS}, k AS (SELECT queue, position, row_number() OVER (PARTITION BY queue ORDER BY position) - 1 AS r FROM l WHERE batch_id IS NOT NULL) SELECT queue, CAST(position AS BIGINT) AS position FROM k WHERE r = position")
def resequence_prefix(spark, d):
    _, positions = _slots(spark, d)
    return O.prefix(positions.withColumn("position", F.col("position").cast("long")), ["queue"], "position").select("queue", "position")


@query("""WITH a AS (SELECT l_orderkey AS batch_id, count(DISTINCT l_suppkey % 5) AS acked FROM lineitem GROUP BY 1)
SELECT o_custkey % 4 AS home, o_orderkey AS slot, o_orderkey AS batch_id FROM orders LEFT JOIN a ON batch_id = o_orderkey WHERE o_orderstatus <> 'P' AND coalesce(acked, 0) >= 2""")
def batchlog_ready(spark, d):
    o = table(spark, d, "orders")
    slots = o.select(F.pmod("o_custkey", F.lit(4)).alias("home"), F.col("o_orderkey").alias("slot"), F.col("o_orderkey").alias("batch_id"), F.lit(2).alias("needed"))
    acks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.pmod("l_suppkey", F.lit(5)).alias("replica"))
    return O.ready(slots, o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("batch_id")), acks).select("home", "slot", "batch_id")


@query("""SELECT a.r_regionkey AS home, string_agg(CAST(b.r_regionkey AS VARCHAR), ';' ORDER BY (b.r_regionkey - a.r_regionkey + 5) % 5) AS acks FROM region a JOIN region b ON (b.r_regionkey - a.r_regionkey + 5) % 5 BETWEEN 1 AND 2 GROUP BY 1""")
def replication_ack_set(spark, d):
    r = table(spark, d, "region")
    # the replication order of a region: those after it, around the circle
    order = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.pmod(F.col("r_regionkey") + i, F.lit(5)))
    return r.select(F.col("r_regionkey").alias("home"), F.array_join(O.ack_set(order, 3), ";").alias("acks"))


@query("SELECT o_custkey % 3 AS home, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey) - 1 AS slot FROM orders")
def interleave_global(spark, d):
    """Slots of each region's log; (slot, home) is the global order that interleaves them."""
    o = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(3)).alias("home"), "o_orderkey", "o_orderdate")
    logs = O.home_position(o, "home", ["o_orderdate", "o_orderkey"], F.col("o_orderdate")).withColumnRenamed("home_position", "slot")
    return O.global_order(logs).select("home", "o_orderkey", F.col("order_key.slot").cast("long").alias("slot"))


@query("""WITH m AS (SELECT l_orderkey // 32 AS batch_id, l_suppkey % 5 AS region FROM lineitem) SELECT batch_id, region, count(*) AS n FROM m GROUP BY ALL""")
def mh_order(spark, d):
    """Batches of multi-home transactions, replicated into each region that they involve."""
    m = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 32).alias("batch_id"), F.pmod("l_suppkey", F.lit(5)).alias("region"))
    return m.groupBy("batch_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey % 4 AS queue, o_orderkey % 3 = 0 AS leader, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def leader_only(spark, d):
    o = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(4)).alias("queue"), (F.pmod("o_orderkey", F.lit(3)) == 0).alias("leader"))
    return o.where("leader").groupBy("queue", "leader").agg(F.count(F.lit(1)).alias("n"))


def requests(spark, d):
    """Lock requests of the log in the order of transactions' numbers."""
    a = access_arith(spark, d)
    return a.select(F.col("txn_id").alias("pos"), "txn_id", F.concat_ws(":", "key", "master").alias("name"), "key", "master", "is_write")


REQ = f"""{ACCESS_ARITH}, req AS (SELECT txn_id AS pos, txn_id, key || ':' || master AS name, key, master, is_write FROM acc),
ep AS (SELECT *, last_value(CASE WHEN is_write THEN pos END IGNORE NULLS) OVER (PARTITION BY name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lw FROM req)"""
EDGES = f"""{REQ}, edge AS (
  SELECT lw AS blocker, pos AS waiter FROM ep WHERE NOT is_write AND lw IS NOT NULL
  UNION SELECT r.pos, w.pos FROM ep r JOIN ep w ON r.name = w.name AND w.is_write AND NOT r.is_write AND coalesce(r.lw, -1) = coalesce(w.lw, -1)
  UNION SELECT lw, pos FROM ep w WHERE is_write AND lw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ep r WHERE r.name = w.name AND NOT r.is_write AND coalesce(r.lw, -1) = w.lw))"""


@query(f"WITH {EDGES} SELECT blocker, waiter FROM edge")
def wait_edges(spark, d):
    return L.wait_edges(requests(spark, d))


@query(f"""WITH {REQ}, h AS (SELECT *, (NOT is_write AND lw IS NULL) OR row_number() OVER (PARTITION BY name ORDER BY pos) = 1 AS granted FROM ep)
SELECT txn_id, count(*) AS n_locks, count(*) FILTER (WHERE NOT granted) AS n_waiting, count(*) FILTER (WHERE NOT granted) = 0 AS ready FROM h GROUP BY txn_id""")
def lock_waits_rw(spark, d):
    return L.waits(requests(spark, d))


@query(f"""WITH {REQ}, h AS (SELECT *, (NOT is_write AND lw IS NULL) OR row_number() OVER (PARTITION BY name ORDER BY pos) = 1 AS granted FROM ep)
SELECT name, count(*) FILTER (WHERE granted) AS n_holders, count(*) FILTER (WHERE NOT granted) AS n_waiters, bool_or(granted AND is_write) AS exclusive FROM h GROUP BY name""")
def grant_readers(spark, d):
    h = L.holders(requests(spark, d))
    return h.groupBy("name").agg(F.count_if("granted").alias("n_holders"), F.count_if(~F.col("granted")).alias("n_waiters"), F.bool_or(F.col("granted") & F.col("is_write")).alias("exclusive"))


@query(f"WITH {EDGES} SELECT blocker, string_agg(CAST(waiter AS VARCHAR), ';' ORDER BY waiter) AS waiters FROM edge GROUP BY blocker")
def wait_graph_dump(spark, d):
    e = L.wait_edges(requests(spark, d))
    return e.groupBy("blocker").agg(F.array_join(F.array_sort(F.collect_list("waiter")), ";").alias("waiters"))


@query(f"WITH {ACCESS_ARITH}, p AS (SELECT txn_id, count(DISTINCT master) AS n_homes, count(DISTINCT master) FILTER (WHERE key % 11 <> 0) AS n_seen FROM acc GROUP BY txn_id) SELECT txn_id, n_homes, n_seen, n_homes = n_seen AS ready FROM p")
def lo_assembly(spark, d):
    a = access_arith(spark, d)
    expected = a.groupBy("txn_id").agg(F.count_distinct("master").alias("n_homes"))
    return L.assembled(a.where(F.pmod("key", F.lit(11)) != 0).select("txn_id", F.col("master").alias("home")), expected)


_VERIFY = f"""{ACCESS_ARITH}, v AS (SELECT txn_id, key, master, key % 3 AS txn_counter, p_size % 3 AS store_counter,
  CASE WHEN key % 3 < p_size % 3 THEN 'ABORT' WHEN key % 3 > p_size % 3 THEN 'WAIT' WHEN (p_size + key) % 7 <> 0 THEN 'VALID' ELSE 'ABORT' END AS verdict FROM acc JOIN part ON p_partkey = key)"""


def _verified(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    rows = access_arith(spark, d).join(p, "key")
    verdict = L.verify_counter(F.pmod("key", F.lit(3)), F.pmod("p_size", F.lit(3)), F.pmod(F.col("p_size") + F.col("key"), F.lit(7)) != 0)
    return rows.select("txn_id", "key", "master", F.pmod("key", F.lit(3)).alias("txn_counter"), verdict.alias("verdict"))


@query(f"WITH {_VERIFY} SELECT txn_id, key, verdict FROM v")
def remaster_verify(spark, d):
    return _verified(spark, d).select("txn_id", "key", "verdict")


@query(f"""WITH {_VERIFY}, q AS (SELECT *, coalesce(bool_or(verdict = 'WAIT') OVER (PARTITION BY txn_id // 100, master ORDER BY txn_id, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM v)
SELECT txn_id, key, verdict, blocked FROM q""")
def remaster_hol_block(spark, d):
    """One queue a region and hundred transactions; whoever waits at the head blocks all behind."""
    rows = _verified(spark, d).withColumn("window", F.floor(F.col("txn_id") / 100))
    return L.behind(rows, ["window", "master"], ["txn_id", "key"]).select("txn_id", "key", "verdict", "blocked")


@query(f"""WITH {_VERIFY}, q AS (SELECT *, coalesce(bool_or(verdict = 'WAIT') OVER (PARTITION BY master ORDER BY txn_id, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM v)
SELECT txn_id, key, verdict, blocked FROM q""")
def remaster_hol_home(spark, d):
    """One queue a home, as long as the log; whoever waits at its head blocks all behind."""
    return L.behind_first(_verified(spark, d), ["master"], ["txn_id", "key"]).select("txn_id", "key", "verdict", "blocked")


@query(f"""WITH {_VERIFY}, q AS (SELECT *, coalesce(bool_or(verdict = 'WAIT') OVER (PARTITION BY key ORDER BY txn_counter, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM v)
SELECT txn_id, key, verdict, blocked FROM q""")
def remaster_perkey(spark, d):
    return L.behind(_verified(spark, d), ["key"], ["txn_counter", "txn_id"]).select("txn_id", "key", "verdict", "blocked")


@query(f"""WITH {ACCESS_ARITH}, m AS (SELECT txn_id, key, master, CASE WHEN is_write AND txn_id % 10 = 0 THEN (master + 1) % 3 END AS new_master FROM acc),
t AS (SELECT *, coalesce(last_value(new_master IGNORE NULLS) OVER (PARTITION BY key ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), master) AS master_then FROM m)
SELECT txn_id, key, master, master_then, CASE WHEN master <> master_then THEN 'Outdated master' ELSE '' END AS abort_reason FROM t""")
def outdated_master(spark, d):
    a = access_arith(spark, d).withColumn("pos", F.col("txn_id"))
    a = a.withColumn("new_master", F.when(F.col("is_write") & (F.pmod("txn_id", F.lit(10)) == 0), F.pmod(F.col("master") + 1, F.lit(3))))
    then = L.master_at(a, F.col("master"))
    return then.select("txn_id", "key", "master", "master_then", F.when(F.col("master") != F.col("master_then"), "Outdated master").otherwise("").alias("abort_reason"))


@query(f"""WITH {ACCESS_ARITH}, n AS (SELECT key, master, count(*) FILTER (WHERE is_write AND txn_id % 10 = 0) AS moves FROM acc GROUP BY ALL)
SELECT key, CAST((master + moves) % 3 AS BIGINT) AS master, moves AS counter FROM n""")
def remaster_execute(spark, d):
    """Each move puts a key to the next region and counts."""
    n = access_arith(spark, d).groupBy("key", "master").agg(F.count_if(F.col("is_write") & (F.pmod("txn_id", F.lit(10)) == 0)).alias("moves"))
    return n.select("key", F.pmod(F.col("master") + F.col("moves"), F.lit(3)).alias("master"), F.col("moves").alias("counter"))


BATCH = 40


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT * FROM edge WHERE blocker // {BATCH} = waiter // {BATCH}),
w AS (SELECT DISTINCT pos AS node, 0 AS level FROM req UNION SELECT waiter, level + 1 FROM w JOIN s ON blocker = node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY node""")
def exec_level(spark, d):
    """Which transactions of a batch can run together: a batch begins when the one before it is done, so that only
    waits within a batch count."""
    rows = requests(spark, d)
    edges = L.wait_edges(rows).where(F.floor(F.col("blocker") / BATCH) == F.floor(F.col("waiter") / BATCH))
    return L.levels(edges, nodes=rows.select(F.col("pos").alias("node")).distinct())


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT pos AS node, 0 AS level FROM req UNION SELECT waiter, level + 1 FROM w JOIN edge ON blocker = node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY node""")
def exec_level_log(spark, d):
    """Which transactions of the whole log can run together: each as soon as all that it waits for are done, however
    far back they stand. No batch barrier, unlike exec_level."""
    rows = requests(spark, d)
    return L.levels(L.wait_edges(rows), nodes=rows.select(F.col("pos").alias("node")).distinct())
