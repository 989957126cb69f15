"""Queries of placement, analysis and routing."""

from pyspark.sql import functions as F

from ..functions import placement as P
from ..operators import analysis as A
from .catalog import ACCESS_ARITH, ACCESS_GEO, COORD, access_arith, access_geo, coordinator_region, query, supplier_region, table, tasks

TYPED = """typ AS (
  SELECT txn_id, CASE WHEN count(*) > count(master) THEN 'UNKNOWN' WHEN min(master) = max(master) THEN 'SINGLE_HOME' ELSE 'MULTI_HOME_OR_LOCK_ONLY' END AS type,
    CAST(CASE WHEN count(*) = count(master) AND min(master) = max(master) THEN min(master) ELSE -1 END AS INT) AS home
  FROM geo GROUP BY txn_id)"""
SORTED = "array_to_string(list_sort(list(DISTINCT {0}){1}), ';')"


@query(f"""WITH {ACCESS_GEO}, t AS (
  SELECT txn_id, CASE WHEN count(*) > count(master) THEN 'UNKNOWN' WHEN min(master) = max(master) THEN 'SINGLE_HOME' ELSE 'MULTI_HOME_OR_LOCK_ONLY' END AS type,
    count(DISTINCT master) AS n_homes, count(DISTINCT part) AS n_parts FROM geo GROUP BY txn_id)
SELECT type, n_homes, n_parts, count(*) AS n_txns FROM t GROUP BY type, n_homes, n_parts""")
def classify_geo(spark, d):
    return A.classify(access_geo(spark, d)).groupBy("type", "n_homes", "n_parts").agg(F.count(F.lit(1)).alias("n_txns"))


@query("SELECT p_partkey AS key, p_partkey % 4 AS part, (p_partkey // 4) % 3 AS home FROM part")
def place_simple(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), P.simple_partition("p_partkey", 4).alias("part"), P.simple_home("p_partkey", 4, 3).alias("home"))


@query("SELECT s_suppkey + 1 AS w_id, s_suppkey % 4 AS part, (s_suppkey // 4) % 3 AS home FROM supplier")
def place_tpcc(spark, d):
    w = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("w_id"))
    return w.select("w_id", P.warehouse_partition("w_id", 4).alias("part"), P.warehouse_home("w_id", 4, 3).alias("home"))


@query("SELECT n_nationkey, n_regionkey * 4 + n_nationkey % 4 AS machine_id, (n_regionkey * 4 + n_nationkey % 4) // 4 AS region, (n_regionkey * 4 + n_nationkey % 4) % 4 AS part FROM nation")
def machine_pack_unpack(spark, d):
    m = table(spark, d, "nation").select("n_nationkey", P.machine("n_regionkey", F.pmod("n_nationkey", F.lit(4)), 4).alias("machine_id"))
    return m.select("n_nationkey", "machine_id", P.machine_region("machine_id", 4).cast("int").alias("region"), P.machine_partition("machine_id", 4).alias("part"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: xor((h * 16777619) % 4294967296, b))"


@query(f"SELECT p_name AS key, {_FNV.format('p_name')} AS fnv, {_FNV.format('p_name')} % 4 AS part, {_FNV.format('p_name[1:2]')} % 4 AS part_of_2_bytes FROM part")
def fnv_partition(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("key"), P.fnv1("p_name").alias("fnv"), P.hash_partition("p_name", 4).alias("part"), P.hash_partition("p_name", 4, 2).alias("part_of_2_bytes"))


@query(f"WITH {ACCESS_ARITH} SELECT DISTINCT key, key || ':' || master AS lock_name FROM acc")
def key_replica_name(spark, d):
    return access_arith(spark, d).select("key", P.key_replica("key", "master").alias("lock_name")).distinct()


@query("SELECT a.n_regionkey AS local, b.r_regionkey AS region, a.n_nationkey, ((b.r_regionkey + 5 - a.n_regionkey) % 5) % 4 AS to_partition FROM nation a, region b WHERE a.n_regionkey <> b.r_regionkey")
def replication_target(spark, d):
    regions = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey")
    other = table(spark, d, "nation").select("n_nationkey", "n_regionkey", regions).where("n_regionkey <> r_regionkey")
    return other.select(F.col("n_regionkey").alias("local"), F.col("r_regionkey").alias("region"), "n_nationkey", P.replication_target("r_regionkey", "n_regionkey", 4, 5).alias("to_partition"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) * 100 + o_custkey % 20 AS txn_id FROM orders")
def assign_txn_id(spark, d):
    from pyspark.sql import Window

    counter = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", P.unique_id(counter.cast("long"), F.pmod("o_custkey", F.lit(20))).alias("txn_id"))


@query(f"""WITH {ACCESS_ARITH} SELECT txn_id, {SORTED.format('part', '')} AS involved_partitions,
  coalesce(array_to_string(list_sort(list(DISTINCT part) FILTER (WHERE is_write)), ';'), '') AS active_partitions FROM acc GROUP BY txn_id""")
def involved_partitions(spark, d):
    return A.classify(access_arith(spark, d)).select("txn_id", "involved_partitions", "active_partitions")


@query(f"WITH {ACCESS_GEO} SELECT txn_id, coalesce({SORTED.format('master', '')}, '') AS involved_regions, count(DISTINCT master) AS n_homes FROM geo WHERE master IS NOT NULL GROUP BY txn_id")
def involved_replicas(spark, d):
    return A.classify(access_geo(spark, d)).select("txn_id", "involved_regions", "n_homes")


@query(f"WITH {ACCESS_GEO} SELECT txn_id, key, master FROM geo")
def master_lookup_local(spark, d):
    return A.with_masters(access_geo(spark, d), supplier_region(spark, d)).select("txn_id", "key", "master")


@query(f"""WITH {ACCESS_GEO} SELECT txn_id, key, CASE WHEN key % 5 = 0 THEN (key // 4) % 5 ELSE CAST(master AS BIGINT) END AS master FROM geo""")
def master_lookup_default(spark, d):
    known = supplier_region(spark, d).where(F.pmod("key", F.lit(5)) != 0).withColumn("master", F.col("master").cast("long"))
    return A.with_masters(access_geo(spark, d), known, P.simple_home("key", 4, 5)).select("txn_id", "key", "master")


@query(f"""WITH {ACCESS_GEO}, {COORD}, {TYPED}, p AS (SELECT txn_id, list_sort(list(DISTINCT part)) AS parts FROM geo GROUP BY txn_id),
w AS (SELECT txn_id, type, home, coord, parts, CASE WHEN type = 'UNKNOWN' THEN 'lookup' WHEN type <> 'SINGLE_HOME' THEN 'orderer' WHEN home = coord THEN 'local sequencer' ELSE 'remote sequencer' END AS destination
  FROM typ JOIN p USING (txn_id) JOIN coo USING (txn_id))
SELECT txn_id, type, home, coord, destination, CASE WHEN destination = 'remote sequencer' THEN parts[CAST(txn_id % len(parts) AS INT) + 1] ELSE -1 END AS to_partition FROM w""")
def route_destination(spark, d):
    return A.route(A.classify(access_geo(spark, d)), coordinator_region(spark, d))


@query(f"WITH {ACCESS_GEO}, {TYPED} SELECT DISTINCT txn_id, master AS home FROM geo WHERE txn_id IN (SELECT txn_id FROM typ WHERE type = 'MULTI_HOME_OR_LOCK_ONLY')")
def lock_only_explode(spark, d):
    access = access_geo(spark, d)
    return A.lock_only(access, A.classify(access))


_PROJECT = f"""WITH {ACCESS_GEO}, {TYPED}, lo AS (SELECT DISTINCT txn_id, master AS home FROM geo WHERE txn_id IN (SELECT txn_id FROM typ WHERE type = 'MULTI_HOME_OR_LOCK_ONLY')),
s AS (SELECT lo.txn_id, lo.home, part, count(*) AS n_keys, count(*) FILTER (WHERE master = home) AS n_own FROM lo JOIN geo USING (txn_id) GROUP BY ALL)"""


def _by_txn(spark, d):
    return access_geo(spark, d).repartition(tasks(spark, d, "lineitem"), "txn_id")


@query(f"{_PROJECT} SELECT txn_id, home, part, n_keys, n_own FROM s WHERE n_own > 0")
def partition_projection(spark, d):
    return A.sub_transactions(_by_txn(spark, d)).where(~F.col("redundant")).drop("redundant")


@query(f"{_PROJECT} SELECT txn_id, home, part, n_keys FROM s WHERE n_own = 0")
def redundant_subtxn(spark, d):
    return A.sub_transactions(_by_txn(spark, d)).where("redundant").select("txn_id", "home", "part", "n_keys")


@query("SELECT o_orderkey AS txn_id, 'ABORTED' AS status, 'Txn accesses no key' AS abort_reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def validate_empty(spark, d):
    return A.without_keys(table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id")), access_arith(spark, d))


@query(f"""WITH {ACCESS_ARITH}, s AS (SELECT txn_id, part, master AS home, count(*) AS n_keys, bool_or(is_write AND key % 97 = 0) AS aborted, min('key ' || key) FILTER (WHERE is_write AND key % 97 = 0) AS reason
  FROM acc GROUP BY txn_id, part, master), e AS (SELECT txn_id, count(DISTINCT part * 10 + master) AS n_expected FROM acc GROUP BY txn_id)
SELECT txn_id, CASE WHEN bool_or(aborted) THEN 'ABORTED' ELSE 'COMMITTED' END AS status, coalesce(min(reason), '') AS abort_reason, {SORTED.format('home', '')} AS regions,
  CASE WHEN bool_or(aborted) THEN 0 ELSE CAST(sum(n_keys) AS BIGINT) END AS n_keys, count(*) = any_value(n_expected) AS complete FROM s JOIN e USING (txn_id) GROUP BY txn_id""")
def merge_subtxns(spark, d):
    access = access_arith(spark, d)
    bad = F.col("is_write") & (F.pmod("key", F.lit(97)) == 0)
    subs = access.groupBy("txn_id", "part", F.col("master").alias("home")).agg(F.count(F.lit(1)).alias("n_keys"), F.bool_or(bad).alias("aborted"), F.min(F.when(bad, F.concat(F.lit("key "), F.col("key")))).alias("reason"))
    expected = access.groupBy("txn_id").agg(F.count_distinct(F.col("part") * 10 + F.col("master")).alias("n_expected"))
    return A.merge(subs, expected)


@query(f"WITH {ACCESS_GEO}, {COORD} SELECT DISTINCT txn_id, master AS region FROM geo JOIN coo USING (txn_id) WHERE master = coord")
def coordinator_filter(spark, d):
    rows = access_geo(spark, d).join(coordinator_region(spark, d), "txn_id")
    return rows.where(F.col("master") == F.col("coord")).select("txn_id", F.col("master").alias("region")).distinct()


@query("""SELECT p_partkey AS key, (p_partkey // 4) % 3 AS old_master, CAST(p_size % 3 AS BIGINT) AS new_master, 'MULTI_HOME_OR_LOCK_ONLY' AS type,
  array_to_string(list_sort(list_distinct([(p_partkey // 4) % 3, p_size % 3])), ';') AS involved_regions FROM part""")
def remaster_classify(spark, d):
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("key"), P.simple_home("p_partkey", 4, 3).alias("master"), "p_size")
    return A.remaster(keys, F.pmod("p_size", F.lit(3)))


@query("""SELECT e.event_id AS txn_id, e.event_type, e.event_id // 64 AS batch_id, b.opened_by FROM events e
JOIN (SELECT event_id // 64 AS batch_id, min(event_id) AS opened_by FROM events GROUP BY 1) b ON b.batch_id = e.event_id // 64""")
def unbatch_events(spark, d):
    """What is known of a batch, copied to each of its transactions."""
    txns = table(spark, d, "events").select(F.col("event_id").alias("txn_id"), "event_type", F.floor(F.col("event_id") / 64).alias("batch_id"))
    batches = txns.groupBy("batch_id").agg(F.min("txn_id").alias("opened_by"))
    return txns.join(batches, "batch_id").select("txn_id", "event_type", "batch_id", "opened_by")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_replies FROM orders GROUP BY o_orderstatus")
def reply_dedupe(spark, d):
    """A client takes one reply for each request, however many come."""
    return table(spark, d, "orders").dropDuplicates(["o_orderstatus", "o_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_replies"))


@query(f"WITH {ACCESS_ARITH} SELECT count(*) AS n_differing FROM (SELECT txn_id, key, is_write FROM acc EXCEPT ALL SELECT txn_id, key, is_write FROM acc)")
def txn_equality(spark, d):
    """Two encodings of one transaction log have the same rows, counting repeats."""
    dealt = lambda: access_arith(spark, d).select("txn_id", "key", "is_write").repartition(tasks(spark, d, "lineitem"), "txn_id", "key")
    return A.surplus(dealt(), dealt())
