"""Queries of result files in full, rates, samples and comparisons of logs."""

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import ordering as O
from ..operators import stats as S
from ..operators import workload as W
from ..sources import results, shared
from .catalog import ACCESS_ARITH, REGIONS, access_arith, query, table
from .logs import _BATCHED, DURATION, MOST, _events
from .measures import _COUNTS, _RESULTS, _draw, _results

_DAY_US = 86_400_000_000
_SENT = f"date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * {_DAY_US}"


def _written(spark, rows, name):
    """Written as a CSV file of results and read again, by the frame's own types."""
    folder = shared.shared_folder(spark, name)
    results.write_csv(rows, folder)
    kinds = ", ".join(f"{c} {'string' if t.startswith('array') else t}" for c, t in rows.dtypes)
    return results.read_csv(spark, folder, kinds)


def _sent(spark, d):
    """txn_id, customer and time of sending: the order's day."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"), "o_custkey", (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * _DAY_US).alias("sent_at"))


@query(f"""WITH {ACCESS_ARITH}, a AS (SELECT txn_id, list_sort(list(DISTINCT master)) AS r, list_sort(list(DISTINCT part)) AS p FROM acc GROUP BY 1)
SELECT txn_id, o_custkey % 4 AS coordinator, array_to_string(r, ';') AS replicas, array_to_string(p, ';') AS partitions, o_custkey % 5 AS generator,
  array_to_string([txn_id * 3 + x for x in r], ';') AS global_log_pos, {_SENT} AS sent_at, {_SENT} + txn_id % 97 * 1000 AS received_at FROM a JOIN orders ON o_orderkey = txn_id""")
def csv_transactions(spark, d):
    """B2, all eight columns; a transaction's place in a region's log is of its number and the region."""
    a = access_arith(spark, d).groupBy("txn_id").agg(F.sort_array(F.collect_set("master")).alias("replicas"), F.sort_array(F.collect_set("part")).alias("partitions"))
    rows = a.join(_sent(spark, d), "txn_id").select(
        "txn_id", F.pmod("o_custkey", F.lit(4)).alias("coordinator"), "replicas", "partitions", F.pmod("o_custkey", F.lit(5)).alias("generator"),
        F.transform("replicas", lambda r: F.col("txn_id") * REGIONS + r).alias("global_log_pos"), "sent_at", (F.col("sent_at") + F.pmod("txn_id", F.lit(97)) * 1000).alias("received_at"),
    )
    return _written(spark, rows, "csv-transactions")


@query(f"""WITH {_RESULTS}, c AS (SELECT generator, {_COUNTS} FROM r GROUP BY generator),
e AS (SELECT o_custkey % 5 AS generator, max({_SENT}) - min({_SENT}) AS elapsed_time FROM orders GROUP BY 1) SELECT c.*, elapsed_time FROM c JOIN e USING (generator)""")
def csv_summary(spark, d):
    """A row a generator, its counters and the time from its first sending to its last."""
    counts = S.summary(_results(spark, d), ["generator"])
    elapsed = _sent(spark, d).groupBy(F.pmod("o_custkey", F.lit(5)).alias("generator")).agg((F.max("sent_at") - F.min("sent_at")).alias("elapsed_time"))
    return _written(spark, counts.join(elapsed, "generator"), "csv-summary")


@query("SELECT event_type AS event, epoch_us(ts) AS time, event_id % 4 AS partition, user_id % 3 AS replica FROM events")
def csv_server_metrics(spark, d):
    """B7."""
    e = table(spark, d, "events").select(F.col("event_type").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.pmod("event_id", F.lit(4)).alias("partition"), F.pmod("user_id", F.lit(3)).alias("replica"))
    return _written(spark, e, "csv-metrics")


@query(f"""WITH {ACCESS_ARITH} SELECT txn_id, any_value({_SENT}) AS sent_at, array_to_string(list_sort(list(key) FILTER (WHERE NOT is_write)), ';') AS reads, array_to_string(list_sort(list(key) FILTER (WHERE is_write)), ';') AS writes
FROM acc JOIN orders ON o_orderkey = txn_id GROUP BY txn_id""")
def csv_scheduler_transactions(spark, d):
    """Keys that a transaction reads and writes; a set that is empty is an empty cell, and read again as null."""
    keys = access_arith(spark, d).groupBy("txn_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_write"), F.col("key")))).alias("reads"), F.sort_array(F.collect_list(F.when(F.col("is_write"), F.col("key")))).alias("writes")
    )
    rows = keys.join(_sent(spark, d), "txn_id").select("txn_id", "sent_at", "reads", "writes")
    return _written(spark, rows, "csv-scheduler")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 AS ms FROM events), s AS (SELECT event_type, ms // 3600 AS step, count(*) AS n, max(ms) AS last FROM e GROUP BY ALL),
l AS (SELECT event_type, step, n, last - lag(last) OVER (PARTITION BY event_type ORDER BY step) AS took_ms FROM s)
SELECT event_type, step, n, took_ms, n * 1000 // took_ms AS rate FROM l WHERE took_ms > 0""")
def tps_instant(spark, d):
    """K5: change of the count by the time between. A second of the driver's events, which are far apart, stands for 1 ms."""
    e = table(spark, d, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ms"))
    return S.rate_between(e, ["event_type"], "ms", 3600)


@query(f"""{_BATCHED}, g AS (SELECT machine, batch_start, place // {MOST} AS sub, count(*) AS size, max(t) - min(t) AS duration FROM b GROUP BY ALL),
v AS (SELECT machine, 'size' AS measure, size AS x FROM g UNION ALL SELECT machine, 'duration', duration FROM g), a AS (SELECT machine, measure, list_sort(list(x)) AS x FROM v GROUP BY ALL),
p AS (SELECT unnest(range(0, 101, 10)) AS percent) SELECT machine, measure, CAST(percent AS INT) AS percent, CAST(x[CAST(floor(percent * (len(x) - 1) / 100) AS INT) + 1] AS BIGINT) AS value FROM a, p""")
def batch_percentiles(spark, d):
    """K6: percentiles of the batches' sizes and durations."""
    each = O.anchored_batches(_events(spark, d), DURATION, MOST).groupBy("machine", "batch_start", "sub_batch").agg(F.count(F.lit(1)).alias("size"), (F.max("t") - F.min("t")).alias("duration"))
    long = each.select("machine", F.explode(F.create_map(F.lit("size"), F.col("size"), F.lit("duration"), F.col("duration"))).alias("measure", "value"))
    return S.floor_percentiles(long, ["machine", "measure"], "value")


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 1048576 * 1103515245 + 12345) % 2147483648 AS lot FROM orders), n AS (SELECT least(count(*), greatest(count(*) * 10 // 100, 500)) AS k FROM orders)
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY lot, o_orderkey) AS r FROM o), n WHERE r <= k""")
def sample_results(spark, d):
    """A tenth of the results, 500 at least where there are as many; the sample is the feature."""
    o = table(spark, d, "orders").select("o_orderkey")
    return S.exact_sample(o, S.lcg("o_orderkey"), ["o_orderkey"], S.sample_size(o.count(), 10, 500))


@query("""WITH t AS (SELECT user_id, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 AS ms FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN ms > 0 THEN (n * 2000000 + ms) // (ms * 2) END AS x FROM t)
SELECT user_id, CASE WHEN ms = 0 THEN 'inf' ELSE (x // 1000) || '.' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0') END AS throughput FROM r""")
def scheduler_throughput(spark, d):
    """K16, a run for each user; a second of its events stands for 1 ms."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    runs = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.floor((F.max("t") - F.min("t")) / 1_000_000).alias("ms"))
    return runs.select("user_id", S.throughput_text(F.col("n"), F.col("ms")).alias("throughput"))


@query("""WITH u AS (SELECT 0 AS from_source, user_id AS key, min(event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 2 UNION ALL
  SELECT 1, user_id, max(event_id) FROM events WHERE event_type = 'view' GROUP BY 2 UNION ALL SELECT 2, c_custkey, c_nationkey FROM customer)
SELECT key, from_source, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY from_source) AS r FROM u) WHERE r = 1""")
def union_first_by_key(spark, d):
    """The first table that has a key gives its row."""
    e = table(spark, d, "events")
    clicks = e.where(F.col("event_type") == "click").groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("value"))
    views = e.where(F.col("event_type") == "view").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("value"))
    rest = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    return A.first_wins([clicks, views, rest], "key")


@query(f"""WITH {ACCESS_ARITH}, y AS (SELECT txn_id, key, is_write <> (key % 97 = 0) AS is_write FROM acc WHERE txn_id % 101 <> 0), x AS (SELECT txn_id, key, is_write FROM acc)
SELECT DISTINCT txn_id, true AS in_first, txn_id % 101 <> 0 AS in_second FROM ((SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT ALL SELECT * FROM x))""")
def txn_differences(spark, d):
    """A log against another that lacks some transactions and has a few keys read instead of written, or written."""
    first = access_arith(spark, d).select("txn_id", "key", "is_write")
    second = first.where(F.pmod("txn_id", F.lit(101)) != 0).select("txn_id", "key", (F.col("is_write") != (F.pmod("key", F.lit(97)) == 0)).alias("is_write"))
    return A.differing(first, second)


@query("""SELECT hot, mh, mp, 10 AS writes, 10 AS records, 2 AS hot_records FROM (SELECT unnest([10000, 30]) AS hot), (SELECT unnest([0, 50, 100]) AS mh), (SELECT unnest([0, 50, 100]) AS mp)""")
def microbenchmark_grid(spark, d):
    """2.P: the 18 runs of the micro-benchmark."""
    parts = F.array(*map(F.lit, (0, 50, 100)))
    runs = spark.range(1).select(F.explode(F.array(F.lit(10000), F.lit(30))).alias("hot")).withColumn("mh", F.explode(parts)).withColumn("mp", F.explode(parts))
    return runs.select("hot", "mh", "mp", F.lit(10).alias("writes"), F.lit(10).alias("records"), F.lit(2).alias("hot_records"))


@query(f"""WITH t AS (SELECT i AS txn_id, CASE WHEN {_draw('i', 1, 100)} < 30 THEN 2 ELSE 1 END AS homes, CASE WHEN {_draw('i', 2, 100)} < 50 THEN 2 ELSE 1 END AS parts, {_draw('i', 3, 3)} AS home0, {_draw('i', 4, 4)} AS part0,
  {_draw('i', 6, 10)} AS shift FROM range(5000) t(i)),
p AS (SELECT *, unnest(range(0, 10)) AS place FROM t),
k AS (SELECT txn_id, CAST(place AS INT) AS place, (home0 + place % homes) % 3 AS home, (part0 + (place // homes) % parts) % 4 AS part,
  CASE WHEN (place + shift) % 10 < 2 THEN ({_draw('txn_id * 31 + place', 7, 5)}) * 2 + (place + shift) % 10 ELSE 10 + ({_draw('txn_id * 31 + place', 5, 99)}) * 10 + place END AS idx FROM p)
SELECT txn_id, place, home, part, (idx * 3 + home) * 4 + part AS key, idx < 10 AS is_hot, place < 4 AS is_write FROM k""")
def wl_basic_hot(spark, d):
    """N1 with two hot records a transaction, out of the ten hot keys of a list."""
    rows = W.basic(spark, 5000, 1000, 4, 3, mh=30, mp=50, records=10, writes=4, hot=30, hot_records=2)
    return rows.select("txn_id", "place", "home", "part", "key", W.is_hot(F.floor(F.col("key") / 12), 30, 3).alias("is_hot"), "is_write")
