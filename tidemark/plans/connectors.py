"""Queries of sources, sinks, streams, and of the whole way of a transaction."""

from functools import partial

from pyspark.sql import functions as F

from ..functions import placement as P
from ..operators import analysis as A
from ..operators import kv, locks as L, store as S
from ..sources import datums, requests as R, results, shared, tpcc
from ..streaming import logs as ST
from .catalog import ACCESS_ARITH, access_arith, query, table
from .execution import _proc, PROC, store0
from .logs import _BATCHED, _SLOTS, DURATION, MOST, _events, _slots, requests


@query("SELECT CAST(i AS VARCHAR) AS key, repeat('a', 20) AS value, (i // 4) % 3 AS master, i % 4 AS part FROM range(2000) t(i)")
def simple_store(spark, d):
    return R.simple_store(spark, 2000, 20, 4, 3)


@query("SELECT p_name AS key, p_brand AS record, p_partkey % 3 AS master, count(*) AS n FROM part GROUP BY ALL")
def datum_roundtrip(spark, d):
    """Parts as binary data files and back."""
    folder = shared.shared_folder(spark, "datums")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    p = table(spark, d, "part")
    rows = p.select(F.col("p_name").cast("binary").alias("key"), F.col("p_brand").cast("binary").alias("record"), F.pmod("p_partkey", F.lit(3)).alias("master"), P.hash_partition("p_name", 4).alias("part"))
    datums.write(rows, folder)
    found = datums.read(spark, folder).withColumn("part", F.regexp_extract("file", r"(\d+)", 1).cast("long"))
    good = datums.load(found, P.hash_partition(F.col("key").cast("string"), 4), 3)
    return good.groupBy("key", F.col("value").alias("record"), "master").agg(F.count(F.lit(1)).alias("n"))


@query()
def offline_data(spark, d):
    return datums.generate(spark, datums.records_for(1_000_000, 100), 100, 3, 4).select(F.col("key").cast("string").alias("key"), F.length("record").alias("size"), "master", "part")


@query("SELECT p_partkey % 4 AS part, (p_partkey // 4) % 3 AS home, p_partkey AS key FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 4, (p_partkey // 4) % 3 ORDER BY p_partkey) AS r FROM part) WHERE r <= 10")
def key_lists(spark, d):
    """The hot keys of each list: its first ten; the limit is the feature."""
    from pyspark.sql import Window

    k = table(spark, d, "part").select(P.simple_partition("p_partkey", 4).alias("part"), P.simple_home("p_partkey", 4, 3).alias("home"), F.col("p_partkey").alias("key"))
    return k.withColumn("r", F.row_number().over(Window.partitionBy("part", "home").orderBy("key"))).where("r <= 10").drop("r")


@query("""SELECT 'o' || o_orderkey AS txn, 'k' || o_custkey AS key, true AS is_write, 'SET' AS command FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'r' || o_custkey, false, 'SET' FROM orders""")
def json_txn_source(spark, d):
    """Transactions as JSON lines and back."""
    folder = shared.shared_folder(spark, "json")
    o = table(spark, d, "orders")
    body = o.select(F.array(F.concat(F.lit("r"), "o_custkey")).alias("read_set"), F.array(F.concat(F.lit("k"), "o_custkey")).alias("write_set"), F.array(F.array(F.lit("SET"), F.concat(F.lit("k"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"))).alias("code"))
    body.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    txns = spark.read.schema(R.TXN).json(folder).withColumn("file", F.col("code")[0][2])
    none = F.array().cast("array<string>")
    keyed = txns.select("file", F.concat(F.transform(F.coalesce("write_set", none), lambda k: F.struct(k.alias("key"), F.lit(True).alias("is_write"))), F.transform("read_set", lambda k: F.struct(k.alias("key"), F.lit(False).alias("is_write")))).alias("keys"), "code", "new_master")
    return R.accesses(keyed).join(R.procedures(keyed).select("file", "command"), "file").select(F.col("file").alias("txn"), "key", "is_write", "command")


@query("SELECT CAST(a.r_regionkey AS INT) AS \"from\", CAST(b.r_regionkey AS INT) AS \"to\", CAST(abs(a.r_regionkey - b.r_regionkey) * 10 + 0.5 AS DOUBLE) AS ms FROM region a, region b")
def latency_matrix(spark, d):
    """A matrix of a few regions, written as a CSV and read with its places."""
    folder = shared.shared_folder(spark, "matrix")
    r = table(spark, d, "region").select("r_regionkey")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.abs(F.col("r_regionkey") - i) * 10 + 0.5).cast("string")), ",")
    r.coalesce(1).sortWithinPartitions("r_regionkey").select(line.alias("value")).write.text(folder)
    return R.latency_matrix(spark, folder)


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def log_source(spark, d):
    """Lines of a log, taken apart by thread."""
    folder = shared.shared_folder(spark, "log")
    table(spark, d, "events").select(F.concat_ws(" ", F.lit("I0101 00:00"), F.concat(F.lit("t"), "user_id"), F.lit("event"), "event_id").alias("value")).write.text(folder)
    lines = R.log_lines(spark, folder)
    return lines.groupBy(F.substring("thread", 2, 20).cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.element_at(F.split("line", " "), -1).cast("long")).alias("first_id"))


@query(f"WITH {ACCESS_ARITH} SELECT txn_id, array_to_string(list_sort(list(DISTINCT master)), ';') AS replicas, array_to_string(list_sort(list(DISTINCT part)), ';') AS partitions FROM acc GROUP BY 1")
def csv_results_roundtrip(spark, d):
    folder = shared.shared_folder(spark, "csv")
    t = access_arith(spark, d).groupBy("txn_id").agg(F.sort_array(F.collect_set("master")).alias("replicas"), F.sort_array(F.collect_set("part")).alias("partitions"))
    results.write_csv(t, folder)
    return results.read_csv(spark, folder, "txn_id long, replicas string, partitions string")


@query("SELECT event_id AS txn_id, event_type AS event, epoch_us(ts) AS time, user_id % 4 AS machine, user_id % 5 AS home FROM events")
def csv_events_roundtrip(spark, d):
    folder = shared.shared_folder(spark, "csv-events")
    e = table(spark, d, "events").select(F.col("event_id").alias("txn_id"), F.col("event_type").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.pmod("user_id", F.lit(4)).alias("machine"), F.pmod("user_id", F.lit(5)).alias("home"))
    results.write_csv(e, folder)
    return results.read_csv(spark, folder, "txn_id long, event string, time long, machine long, home long")


@query("SELECT 1 AS version, 'basic' AS name, '30' AS \"wl:mh\", '50' AS \"wl:mp\"")
def csv_metadata(spark, d):
    return results.with_params(spark.range(1).select(F.lit(1).alias("version"), F.lit("basic").alias("name")), {"mp": 50, "mh": 30})


@query("SELECT n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def print_rows(spark, d):
    return table(spark, d, "nation").select(results.cells("n_nationkey", "n_name", "n_regionkey").alias("line"))


@query("SELECT 'txn ' || l_orderkey || ' ' || string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS line FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def profile_lines(spark, d):
    a = access_arith(spark, d).groupBy("txn_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return a.select(results.profile_line(F.col("txn_id"), F.transform("keys", lambda k: k.cast("string"))).alias("line"))


@query("""SELECT 'warehouse' AS name, 2 AS n UNION ALL SELECT 'district', 20 UNION ALL SELECT 'customer', 60000 UNION ALL SELECT 'history', 60000 UNION ALL SELECT 'new_order', 18000
UNION ALL SELECT 'order', 60000 UNION ALL SELECT 'order_line', 600000 UNION ALL SELECT 'item', 200000 UNION ALL SELECT 'stock', 200000""")
def tpcc_tables(spark, d):
    """Rows and different keys of the nine generated tables for two warehouses."""
    keys = {"warehouse": 1, "district": 2, "customer": 3, "history": 4, "new_order": 3, "order": 3, "order_line": 4, "item": 2, "stock": 2}
    out = None
    for name, make in tpcc.TABLES.items():
        t = make(spark, 2)
        n = t.select(*t.columns[: keys[name]]).distinct().agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


WAVES = 3


def _staged(spark, d, rows, name, wave):
    return ST.staged(spark, rows.withColumn("wave", wave.cast("int")), shared.shared_folder(spark, name), "wave")


@query(f"WITH {_SLOTS}, k AS (SELECT queue, position, slot, row_number() OVER (PARTITION BY queue ORDER BY position) - 1 AS r FROM l WHERE batch_id IS NOT NULL) SELECT queue, CAST(position AS BIGINT) AS position, CAST(slot AS VARCHAR) AS value FROM k WHERE r = position")
def stream_resequence(spark, d):
    """Batches that arrive out of order, in three waves, leave in the order of their positions."""
    _, positions = _slots(spark, d)
    rows = positions.select("queue", F.col("position").cast("long").alias("position"), F.col("batch_id").cast("string").alias("value"))
    stream, arrive = _staged(spark, d, rows, "positions", F.pmod(F.col("position") * 7, F.lit(WAVES)))
    return ST.run(stream, shared.shared_folder(spark, "resequenced"), WAVES, [arrive], ST.resequence)


@query("SELECT o_orderkey AS batch_id, o_custkey % 4 AS queue, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def stream_batchlog(spark, d):
    """Slots and data as two streams; the data of some batches comes waves after their slots."""
    o = table(spark, d, "orders")
    slots, come = _staged(spark, d, o.select(F.col("o_orderkey").alias("batch_id"), F.pmod("o_custkey", F.lit(4)).alias("queue")), "slots", F.pmod("batch_id", F.lit(WAVES)))
    data, follow = _staged(spark, d, o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("batch_id"), "o_orderstatus"), "data", F.pmod(F.col("batch_id") + 1, F.lit(WAVES)))
    return ST.run(ST.order_with_data(slots, data), shared.shared_folder(spark, "batchlog"), WAVES, [come, follow])


@query(f"{_BATCHED} SELECT machine, id, t, batch_start, CAST(place // {MOST} AS BIGINT) AS sub_batch, CAST(place % {MOST} AS BIGINT) AS place FROM b")
def stream_batch_timer(spark, d):
    e = _events(spark, d)
    third = e.agg(F.percentile_approx("t", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0] or (0, 0)
    wave = F.when(F.col("t") < third[0], 0).when(F.col("t") < third[1], 1).otherwise(2)
    stream, arrive = _staged(spark, d, e, "timed", wave)
    return ST.run(stream, shared.shared_folder(spark, "batches"), WAVES, [arrive], partial(ST.anchored_batches, duration_us=DURATION, most=MOST))


@query("SELECT DISTINCT o_custkey FROM orders")
def stream_dedupe(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey")
    s, arrive = _staged(spark, d, o, "replies", F.pmod("o_orderkey", F.lit(WAVES)))
    return ST.run(ST.once(s, "o_custkey", "at", "10000 days").select("o_custkey"), shared.shared_folder(spark, "once"), WAVES, [arrive])


@query(f"""WITH {PROC}, w AS (SELECT acc.txn_id, key, CASE WHEN key % 5 = 0 THEN 'v' || acc.txn_id WHEN key % 5 = 1 THEN NULL ELSE '' END AS value, key % 5 = 1 AS deleted
FROM acc LEFT JOIN ab USING (txn_id) WHERE is_write AND abort_reason IS NULL), z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC) AS r FROM w) WHERE r = 1)
SELECT p_partkey AS key, CASE WHEN z.key IS NULL THEN p_name ELSE value END AS value FROM part LEFT JOIN z ON z.key = p_partkey WHERE NOT coalesce(deleted, false)""")
def e2e_pipeline(spark, d):
    """A batch of transactions all the way: placed, executed against the snapshot, its writes applied in log order."""
    access, proc, store = access_arith(spark, d), _proc(spark, d), store0(spark, d)
    writes = kv.committed_writes(access, kv.effects(kv.known(proc), access, store), kv.aborts(proc, access, store))
    last = S.last_versions(writes, F.col("txn_id"))
    return S.apply_versions(store, last).select("key", "value")


@query(f"WITH {ACCESS_ARITH} SELECT part, master, count(*) AS n_keys, count(DISTINCT txn_id) AS n_txns FROM acc GROUP BY ALL")
def e2e_by_machine(spark, d):
    """What each machine gets to do."""
    return access_arith(spark, d).groupBy("part", "master").agg(F.count(F.lit(1)).alias("n_keys"), F.count_distinct("txn_id").alias("n_txns"))
