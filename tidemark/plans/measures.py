"""Queries of statistics, traces, strings and workloads."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as X
from ..operators import analysis as A
from ..operators import locks as L
from ..operators import stats as S
from ..operators import workload as W
from .catalog import ACCESS_ARITH, ACCESS_GEO, access_arith, access_geo, query, table
from .logs import REQ, requests
from .routing import TYPED


def _events(spark, d):
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""WITH a AS (SELECT event_type, list_sort(list(CAST(round(value * 100) AS BIGINT))) AS v FROM events GROUP BY 1), p AS (SELECT unnest(range(0, 101, 10)) AS percent)
SELECT event_type, CAST(percent AS INT) AS percent, v[CAST(floor(percent * (len(v) - 1) / 100) AS INT) + 1] AS cents FROM a, p""")
def percentiles_floor(spark, d):
    return S.floor_percentiles(_events(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long")), ["event_type"], "cents")


def _results(spark, d):
    a = A.classify(access_geo(spark, d)).select("txn_id", "n_homes", "n_parts")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"), "o_orderstatus", F.pmod("o_custkey", F.lit(5)).alias("generator"))
    status = F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "O", "ABORTED").otherwise("NOT_STARTED")
    return o.join(a, "txn_id").select("txn_id", "generator", status.alias("status"), "n_homes", "n_parts", (F.pmod("txn_id", F.lit(50)) == 0).alias("is_remaster"))


_RESULTS = f"""{ACCESS_GEO}, a AS (SELECT txn_id, count(DISTINCT master) AS n_homes, count(DISTINCT part) AS n_parts FROM geo GROUP BY 1),
r AS (SELECT txn_id, o_custkey % 5 AS generator, CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'O' THEN 'ABORTED' ELSE 'NOT_STARTED' END AS status, n_homes, n_parts, txn_id % 50 = 0 AS is_remaster FROM orders JOIN a ON txn_id = o_orderkey)"""
_COUNTS = """count(*) FILTER (WHERE status = 'COMMITTED') AS committed, count(*) FILTER (WHERE status = 'ABORTED') AS aborted, count(*) FILTER (WHERE status = 'NOT_STARTED') AS not_started,
count(*) FILTER (WHERE n_homes = 1) AS single_home, count(*) FILTER (WHERE n_homes > 1) AS multi_home, count(*) FILTER (WHERE n_parts = 1) AS single_partition, count(*) FILTER (WHERE n_parts > 1) AS multi_partition, count(*) FILTER (WHERE is_remaster) AS remaster"""


@query(f"WITH {_RESULTS} SELECT generator, {_COUNTS} FROM r GROUP BY generator")
def summary_counts(spark, d):
    return S.summary(_results(spark, d), ["generator"])


@query(f"WITH {_RESULTS} SELECT {_COUNTS} FROM r")
def partial_final(spark, d):
    """Sums of the generators' counters."""
    each = S.summary(_results(spark, d), ["generator"])
    return each.agg(*(F.sum(c).alias(c) for c in each.columns if c != "generator"))


_TIMED = """t AS (SELECT user_id % 5 AS generator, CASE WHEN event_id % 10 = 0 THEN 'ABORTED' ELSE 'COMMITTED' END AS status, epoch_us(ts) AS t FROM events)"""


def _timed(spark, d):
    return _events(spark, d).select(F.pmod("user_id", F.lit(5)).alias("generator"), F.when(F.pmod("event_id", F.lit(10)) == 0, "ABORTED").otherwise("COMMITTED").alias("status"), "t")


@query(f"""WITH {_TIMED}, g AS (SELECT generator, count(*) FILTER (WHERE status = 'COMMITTED') AS committed, (max(t) - min(t)) / 1e6 AS s FROM t GROUP BY 1)
SELECT CAST(floor(sum(committed / s)) AS BIGINT) AS avg_tps, CAST(sum(committed) AS BIGINT) AS committed FROM g""")
def avg_tps(spark, d):
    return S.average_rate(_timed(spark, d), "generator", "t", "t")


@query("""WITH s AS (SELECT event_type, epoch_us(ts) // 3600000000 AS step, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, step, n, n - lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY step) AS change FROM s""")
def tps_per_second(spark, d):
    """By hour here, as the driver's events are days apart."""
    return S.rate_by_second(_events(spark, d), ["event_type"], "t", 3_600_000_000)


_LCG = "(({0}) % 1048576 * 1103515245 + 12345) % 2147483648"


@query(f"SELECT o_orderkey FROM orders ORDER BY {_LCG.format('o_orderkey')}, o_orderkey LIMIT 250")
def sample_seeded(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return S.exact_sample(o, S.lcg("o_orderkey"), ["o_orderkey"], 250)


@query("""WITH c AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 256 AS slot FROM events)
SELECT event_id, event_type, slot FROM c WHERE (slot * 167 + 13) % 256 < 25""")
def event_mask_sample(spark, d):
    return S.masked(_events(spark, d), ["event_type"], ["ts", "event_id"], 10).select("event_id", "event_type", "slot")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 UNION ALL SELECT 'all: ' || event_type, count(*) FROM events GROUP BY 1")
def event_gate(spark, d):
    e = _events(spark, d)
    some, every = S.gated(e, ["click", "view"]), S.gated(e, ["ALL"])
    return some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).unionByName(every.groupBy(F.concat(F.lit("all: "), "event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS latency_us FROM events GROUP BY user_id")
def latency(spark, d):
    return _events(spark, d).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("latency_us"))


@query("""WITH l AS (SELECT event_type, lag(event_type) OVER w AS from_event, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS took FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT from_event, event_type AS to_event, count(*) AS n, CAST(sum(took) AS BIGINT) AS took_us FROM l WHERE from_event IS NOT NULL GROUP BY ALL""")
def stage_latency(spark, d):
    s = S.stages(_events(spark, d), "user_id", ["ts", "event_id"])
    return s.groupBy("from_event", F.col("event_type").alias("to_event")).agg(F.count(F.lit(1)).alias("n"), F.sum("took_us").alias("took_us"))


@query(f"""WITH {REQ}, h AS (SELECT *, (NOT is_write AND lw IS NULL) OR row_number() OVER (PARTITION BY name ORDER BY pos) = 1 AS granted FROM ep)
SELECT count(DISTINCT name) AS n_locks, count(*) FILTER (WHERE granted) AS n_granted, count(DISTINCT txn_id) FILTER (WHERE NOT granted) AS n_waiting_txns FROM h""")
def lock_table_stats(spark, d):
    h = L.holders(requests(spark, d))
    return h.agg(F.count_distinct("name").alias("n_locks"), F.count_if("granted").alias("n_granted"), F.count_distinct(F.when(~F.col("granted"), F.col("txn_id"))).alias("n_waiting_txns"))


@query("""SELECT user_id % 4 AS machine, '{"pending":' || count(*) || ',"partial":' || count(*) FILTER (WHERE event_type = 'click') || '}' AS stats FROM events GROUP BY 1""")
def server_stats_json(spark, d):
    e = _events(spark, d).groupBy(F.pmod("user_id", F.lit(4)).alias("machine")).agg(F.count(F.lit(1)).alias("pending"), F.count_if(F.col("event_type") == "click").alias("partial"))
    return e.select("machine", F.to_json(F.struct("pending", "partial")).alias("stats"))


@query(f"WITH {ACCESS_GEO}, {TYPED} SELECT type, count(*) AS n, CAST(sum(home) AS BIGINT) AS homes FROM typ GROUP BY type")
def scheduler_stats(spark, d):
    return A.classify(access_geo(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("home").alias("homes"))


@query(f"WITH {ACCESS_ARITH} SELECT txn_id, array_to_string(list_sort(list(DISTINCT master)), ';') AS regions, array_to_string(list_sort(list(DISTINCT part)), ';') AS partitions, count(*) FILTER (WHERE is_write) AS n_writes FROM acc GROUP BY 1")
def txn_profiles(spark, d):
    return A.classify(access_arith(spark, d)).select("txn_id", F.col("involved_regions").alias("regions"), F.col("involved_partitions").alias("partitions"), "n_writes")


@query("SELECT user_id, event_id, ts_us FROM (SELECT user_id, event_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def log_tail(spark, d):
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return _events(spark, d).withColumn("r", last).where("r <= 3").select("user_id", "event_id", F.col("t").alias("ts_us"))


@query("SELECT event_type, user_id FROM events UNION SELECT 'none', user_id FROM events WHERE user_id % 2 = 0")
def union_first_wins(spark, d):
    e = _events(spark, d).select("event_type", "user_id")
    return e.unionByName(e.where(F.pmod("user_id", F.lit(2)) == 0).select(F.lit("none").alias("event_type"), "user_id")).distinct()


@query("SELECT CAST(status AS INT) AS generator, kind FROM (SELECT unnest(range(0, 3)) AS status), (SELECT unnest(['hot', 'cold']) AS kind)")
def experiment_matrix(spark, d):
    """The grid of experiments: every combination of a few fixed values."""
    return spark.range(3).select(F.col("id").cast("int").alias("generator"), F.explode(F.array(F.lit("hot"), F.lit("cold"))).alias("kind"))


@query("SELECT p_partkey, regexp_extract(p_name, '[^ a]+') AS token, array_to_string(regexp_extract_all(p_name, '[^ a]+'), '|') AS tokens FROM part")
def str_next_token(spark, d):
    return table(spark, d, "part").select("p_partkey", X.next_token("p_name", " a").alias("token"), F.array_join(X.tokens("p_name", " a"), "|").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN len(regexp_extract_all(p_type, '[^ ]+')) >= 2 THEN array_to_string(regexp_extract_all(p_type, '[^ ]+')[1:2], '|') ELSE '' END AS two FROM part")
def str_next_n_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.next_n_tokens("p_type", 2, " "), "|").alias("two"))


@query(r"SELECT doc_id, regexp_replace(chr(9) || text || chr(10) || ' ', '^\s+|\s+$', '', 'g') AS trimmed FROM documents")
def str_trim(spark, d):
    return table(spark, d, "documents").select("doc_id", X.trim_space(F.concat(F.lit("\t"), "text", F.lit("\n "))).alias("trimmed"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ ,]+')) AS n_tokens, regexp_extract_all(text, '[^ ,]+')[-1] AS last_token FROM documents")
def str_split(spark, d):
    t = X.tokens("text", " ,")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.element_at(t, -1).alias("last_token"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS pairs FROM nation GROUP BY 1")
def str_join(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return n.select("n_regionkey", X.join("names").alias("names"), X.join_pairs("m").alias("pairs"))


@query(r"""SELECT p_partkey, list_reduce(list_prepend('', list_transform(regexp_extract_all(hex(encode(p_name || chr(9) || 'é')), '..'), lambda h: CASE WHEN ('0x' || h)::INT BETWEEN 32 AND 126 THEN chr(('0x' || h)::INT) ELSE '\' || lower(ltrim(h, '0')) END)), lambda a, b: a || b) AS shown FROM part""")
def to_readable(spark, d):
    return table(spark, d, "part").select("p_partkey", X.to_readable(F.concat("p_name", F.lit("\té"))).alias("shown"))


@query("SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS mh, CAST(event_id % 5 AS VARCHAR) AS writes, 2 AS n FROM events")
def parse_params(spark, d):
    text = F.concat(F.lit("mh="), F.pmod("event_id", F.lit(7)), F.when(F.pmod("event_id", F.lit(2)) == 0, ";").otherwise(","), F.lit(" writes = "), F.pmod("event_id", F.lit(5)))
    m = table(spark, d, "events").select("event_id", X.parse_params(text).alias("m"))
    return m.select("event_id", F.col("m")["mh"].alias("mh"), F.col("m")["writes"].alias("writes"), F.size("m").alias("n"))


@query("SELECT o_orderkey, base64(unhex(concat(" + ", ".join(f"substr(lpad(hex(o_orderkey), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + "))) AS key FROM orders")
def base64_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.base64_le("o_orderkey").alias("key"))


@query("SELECT CAST(i AS BIGINT) AS rank, round(pow(i, -0.9) / (SELECT sum(pow(j, -0.9)) FROM range(1, 1001) t(j)), 9) AS weight FROM range(1, 1001) t(i)")
def zipf_weights(spark, d):
    return W.zipf_weights(1000, 0.9, spark).select("rank", F.round("weight", 9).alias("weight"))


def _draw(x, salt, below):
    inner = _LCG.format(f"({x}) + {salt * 7919}")
    return f"(({_LCG.format(inner)}) // 64) % {below}"


@query(f"""WITH t AS (SELECT i AS txn_id, CASE WHEN {_draw('i', 1, 100)} < 30 THEN 2 ELSE 1 END AS homes, CASE WHEN {_draw('i', 2, 100)} < 50 THEN 2 ELSE 1 END AS parts, {_draw('i', 3, 3)} AS home0, {_draw('i', 4, 4)} AS part0 FROM range(5000) t(i)),
p AS (SELECT *, unnest(range(0, 10)) AS place FROM t),
k AS (SELECT txn_id, CAST(place AS INT) AS place, (home0 + place % homes) % 3 AS home, (part0 + (place // homes) % parts) % 4 AS part, ({_draw('txn_id * 31 + place', 5, 100)}) * 10 + place AS idx FROM p)
SELECT txn_id, place, home, part, (idx * 3 + home) * 4 + part AS key, place < 4 AS is_write FROM k""")
def wl_basic(spark, d):
    return W.basic(spark, 5000, 1000, 4, 3, mh=30, mp=50, records=10, writes=4)


@query("SELECT o_orderkey AS txn_id, o_custkey % 3 AS home, CASE WHEN o_orderkey % 50 = 0 THEN (o_custkey % 3 + 1) % 3 ELSE -1 END AS new_master FROM orders")
def wl_remaster(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"), F.pmod("o_custkey", F.lit(3)).alias("home"))
    return W.remastering(o, 50, 3).withColumn("new_master", F.coalesce("new_master", F.lit(-1).cast("long")))


@query(f"SELECT i AS txn_id, {_draw('i', 2, 3)} AS home, ({_draw('i', 5, 1000)}) * 3 + CASE WHEN {_draw('i', 4, 100)} < 20 THEN ({_draw('i', 2, 3)} + 1 + {_draw('i', 3, 2)}) % 3 ELSE {_draw('i', 2, 3)} END AS second_key, {_draw('i', 4, 100)} < 20 AS multi_home FROM range(5000) t(i)")
def wl_cockroach(spark, d):
    return W.cockroach(spark, 5000, 1000, 0.1, 3, mh=20).select("txn_id", "home", "second_key", "multi_home")


@query(f"""WITH t AS (SELECT i AS txn_id, {_draw('i', 1, 100)} AS lot, {_draw('i', 2, 8)} + 1 AS w_id, {_draw('i', 3, 100)} < 1 AS is_remote, {_draw('i', 4, 7)} AS away, {_draw('i', 7, 10)} + 1 AS d_id, (({_draw('i', 5, 1024)}) | ({_draw('i', 6, 3000)})) AS nu FROM range(10000) t(i))
SELECT txn_id, CASE WHEN lot < 45 THEN 'new_order' WHEN lot < 88 THEN 'payment' WHEN lot < 92 THEN 'order_status' WHEN lot < 96 THEN 'deliver' ELSE 'stock_level' END AS procedure,
  w_id, d_id, (nu + 259) % 3000 + 1 AS c_id, CASE WHEN is_remote THEN (w_id + away) % 8 + 1 ELSE w_id END AS supply_w, is_remote FROM t""")
def wl_tpcc_mix(spark, d):
    return W.tpcc_mix(spark, 10000, 8)


@query()
def zipf_sample_topk(spark, d):
    return W.zipf_sample(spark.range(2000).withColumnRenamed("id", "draw"), 20, 0.9, 3)


@query("SELECT p_partkey % 4 AS part, (p_partkey // 4) % 3 AS home, p_partkey // 12 < 10 AS hot, count(*) AS n FROM part GROUP BY ALL")
def hot_cold_keys(spark, d):
    k = table(spark, d, "part").select(F.pmod("p_partkey", F.lit(4)).alias("part"), F.pmod(F.floor(F.col("p_partkey") / 4), F.lit(3)).alias("home"), F.floor(F.col("p_partkey") / 12).alias("i"))
    return k.groupBy("part", "home", W.is_hot(F.col("i"), 30, 3).alias("hot")).agg(F.count(F.lit(1)).alias("n"))
