"""Queries of the store, of typed tables, of key-value procedures and of TPC-C."""

from pyspark.sql import functions as F

from ..functions import placement as P
from ..operators import kv, store as S, tpcc as T
from .catalog import ACCESS_ARITH, access_arith, query, table

BIG = lambda x: f"CAST({x} AS BIGINT)"


def store0(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))


def write_log(spark, d):
    """Lines as writes of parts in the order of the log: R sets, A deletes, others read."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    position = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long"), "l_extendedprice")
    return rows.where("l_returnflag <> 'N'").select(
        F.col("l_partkey").alias("key"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("value"), (F.col("l_returnflag") == "A").alias("deleted"), position.alias("position")
    )


LOG = """lg AS (
  SELECT l_partkey AS key, concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS value, l_returnflag = 'A' AS deleted,
    row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS back
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N')"""


@query(f"WITH {ACCESS_ARITH} SELECT txn_id, key, is_write, p_name AS value FROM acc JOIN part ON p_partkey = key")
def point_read(spark, d):
    return S.point_read(access_arith(spark, d).select("txn_id", "key", "is_write"), store0(spark, d)).select("txn_id", "key", "is_write", "value")


@query("SELECT p_partkey AS key, p_partkey % 4 AS part, (p_partkey // 4) % 3 AS master, CAST(0 AS INT) AS counter FROM part")
def master_metadata(spark, d):
    return store0(spark, d).select("key", P.simple_partition("key", 4).alias("part"), P.simple_home("key", 4, 3).alias("master"), F.lit(0).alias("counter"))


@query(f"WITH {LOG} SELECT coalesce(p_partkey, key) AS key, coalesce(value, p_name) AS value, p_partkey IS NOT NULL AS existed FROM part FULL JOIN (SELECT key, value FROM lg WHERE back = 1) w ON key = p_partkey".replace("FROM lg WHERE back = 1", "FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY back) AS r FROM lg WHERE NOT deleted) WHERE r = 1"))
def upsert_lww(spark, d):
    log = write_log(spark, d).where(~F.col("deleted"))
    return S.apply_versions(store0(spark, d), S.last_versions(log, F.col("position")))


@query(f"WITH {LOG} SELECT coalesce(p_partkey, key) AS key, CASE WHEN key IS NULL THEN p_name ELSE value END AS value, p_partkey IS NOT NULL AS existed FROM part FULL JOIN (SELECT * FROM lg WHERE back = 1) w ON key = p_partkey WHERE NOT coalesce(deleted, false)")
def delete_tombstone(spark, d):
    return S.apply_versions(store0(spark, d), S.last_versions(write_log(spark, d), F.col("position")))


@query("SELECT l_orderkey, count(*) AS n_lines, any_value(o_custkey) AS o_custkey, any_value(o_orderstatus) AS o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def select_grouped(spark, d):
    """Rows by full key, of a table whose rows are stored whole."""
    wanted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return wanted.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "n_lines", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey AS key, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def select_ungrouped(spark, d):
    """Rows of a table whose columns are stored one by one; customers of a debt have no segment stored."""
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return S.from_cells(S.to_cells(c, "c_custkey", ["c_name", "c_mktsegment"]), ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, coalesce(s.o_orderstatus, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS o_orderstatus FROM orders WHERE o_totalprice > 200000 GROUP BY 1) s ON o_custkey = c_custkey")
def update_by_pk(spark, d):
    changes = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("new"))
    return S.update(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment", F.col("new")).select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name) FROM supplier WHERE s_acctbal > 0")
def insert_row(spark, d):
    s = table(spark, d, "supplier")
    new = s.where("s_acctbal > 0").select((F.col("s_suppkey") + 1000000).alias("key"), F.upper("s_name").alias("value"), F.lit(False).alias("deleted"), F.lit(1).alias("position"))
    return S.apply_versions(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")), S.last_versions(new, F.col("position"))).select("key", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def delete_by_pk(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.delete(table(spark, d, "orders"), gone, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT concat_ws('/', o_custkey, 'ORDER', o_orderkey) AS storage_key FROM orders")
def storage_keys(spark, d):
    return table(spark, d, "orders").select(F.concat_ws("/", "o_custkey", F.lit("ORDER"), "o_orderkey").alias("storage_key"))


@query("SELECT s_suppkey, array_to_string(list_filter([CASE WHEN length(s_name) <> 18 THEN 's_name' END], lambda x: x IS NOT NULL), ';') AS wrong FROM supplier WHERE length(s_name) <> 18 UNION ALL SELECT p_partkey, 'p_brand' FROM part WHERE length(p_brand) <> 8")
def type_validation(spark, d):
    s = S.wrong_width(table(spark, d, "supplier"), {"s_name": 18}).select("s_suppkey", F.array_join("wrong", ";").alias("wrong"))
    p = S.wrong_width(table(spark, d, "part"), {"p_brand": 8}).select(F.col("p_partkey").alias("s_suppkey"), F.array_join("wrong", ";").alias("wrong"))
    return s.unionByName(p)


@query("SELECT l_orderkey AS txn_id, l_partkey AS key, bool_or(l_returnflag = 'R') AS is_write FROM lineitem GROUP BY ALL")
def keygen_rw_set(spark, d):
    return S.read_write_set(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("is_write")))


@query("""SELECT l_orderkey AS txn_id, l_partkey AS key, arg_min(l_returnflag = 'R', (l_linenumber, l_suppkey, l_extendedprice)) AS is_write, count(*) AS n_declared FROM lineitem GROUP BY ALL""")
def kv_duplicate_key(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("is_write"), "l_linenumber", "l_suppkey", "l_extendedprice")
    return S.first_declared(rows, F.struct("l_linenumber", "l_suppkey", "l_extendedprice"))


def _proc(spark, d):
    """A command for each declared key: by the key's remainder of 5 it is set, deleted, compared, got or unknown."""
    a = access_arith(spark, d)
    kind = F.pmod("key", F.lit(5))
    command = F.when(kind == 0, "SET").when(kind == 1, "DEL").when(kind == 2, "EQ").when(kind == 3, "GET").otherwise("FLY")
    b = F.when(kind == 0, F.concat(F.lit("v"), F.col("txn_id"))).when((kind == 2) & (F.pmod("key", F.lit(50)) == 2), "other")
    # a comparison with the stored value holds; every tenth is with another one
    rows = a.join(store0(spark, d), "key", "left").select("txn_id", F.col("key").alias("seq"), command.alias("command"), F.col("key").alias("a"), F.coalesce(b, F.when(kind == 2, F.col("value"))).alias("b"))
    return rows


PROC = f"""{ACCESS_ARITH}, ab AS (SELECT txn_id, string_agg('Key ' || key || ' is not other', '; ' ORDER BY key) AS abort_reason FROM acc JOIN part ON p_partkey = key WHERE key % 50 = 2 AND p_name <> 'other' GROUP BY txn_id)"""


@query(f"WITH {ACCESS_ARITH} SELECT txn_id, key, 'v' || txn_id AS new_value FROM acc WHERE is_write AND key % 5 = 0")
def kv_get_set(spark, d):
    a = access_arith(spark, d)
    return kv.effects(kv.known(_proc(spark, d)), a, store0(spark, d)).where(~F.col("deleted")).select("txn_id", "key", "new_value")


@query(f"WITH {ACCESS_ARITH} SELECT txn_id, key FROM acc WHERE is_write AND key % 5 = 1")
def kv_del(spark, d):
    return kv.effects(_proc(spark, d), access_arith(spark, d), store0(spark, d)).where("deleted").select("txn_id", "key")


@query(f"""WITH {ACCESS_ARITH}, p AS (SELECT txn_id, min(key) AS lo, max(key) AS hi FROM acc WHERE is_write GROUP BY txn_id HAVING min(key) < max(key))
SELECT txn_id, lo AS key, p_name AS new_value FROM p JOIN part ON p_partkey = hi UNION ALL SELECT txn_id, hi, p_name FROM p JOIN part ON p_partkey = lo""")
def kv_copy_swap(spark, d):
    """Two copies, each of the other's pre-image, swap the values of the first and last written key."""
    a = access_arith(spark, d)
    ends = a.where("is_write").groupBy("txn_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    one = ends.select("txn_id", F.lit(1).alias("seq"), F.lit("COPY").alias("command"), F.col("lo").alias("a"), F.col("hi").cast("string").alias("b"))
    two = ends.select("txn_id", F.lit(2).alias("seq"), F.lit("COPY").alias("command"), F.col("hi").alias("a"), F.col("lo").cast("string").alias("b"))
    return kv.effects(one.unionByName(two), a, store0(spark, d)).select("txn_id", "key", "new_value")


@query(f"WITH {PROC} SELECT DISTINCT acc.txn_id, CASE WHEN abort_reason IS NULL THEN 'COMMITTED' ELSE 'ABORTED' END AS status, coalesce(abort_reason, '') AS abort_reason FROM acc LEFT JOIN ab USING (txn_id)")
def kv_eq_abort(spark, d):
    return kv.execution("KEY_VALUE")(_proc(spark, d), access_arith(spark, d), store0(spark, d))


@query(f"""WITH {PROC} SELECT acc.txn_id, key, CASE WHEN key % 5 = 0 THEN 'v' || acc.txn_id WHEN key % 5 = 1 THEN NULL ELSE '' END AS value, key % 5 = 1 AS deleted
FROM acc LEFT JOIN ab USING (txn_id) WHERE is_write AND abort_reason IS NULL""")
def kv_apply_writes(spark, d):
    proc, a, st = _proc(spark, d), access_arith(spark, d), store0(spark, d)
    return kv.committed_writes(a, kv.effects(proc, a, st), kv.aborts(proc, a, st))


@query("SELECT DISTINCT l_orderkey AS txn_id, 'COMMITTED' AS status FROM lineitem")
def kv_noop(spark, d):
    return kv.execution("NOOP")(_proc(spark, d), access_arith(spark, d), store0(spark, d))


@query(f"WITH {ACCESS_ARITH} SELECT key % 5 AS kind, count(*) AS n FROM acc WHERE key % 5 < 4 GROUP BY 1")
def kv_unknown_command(spark, d):
    return kv.known(_proc(spark, d)).groupBy(F.pmod("a", F.lit(5)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _lines(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("item"), F.pmod("l_suppkey", F.lit(10)).alias("supply_w"),
        F.pmod("l_orderkey", F.lit(10)).alias("w"), F.col("l_quantity").cast("long").alias("quantity"), "l_suppkey",
    )


def _items(spark, d):
    return table(spark, d, "part").where(F.pmod("p_partkey", F.lit(101)) != 0).select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("price"))


@query("SELECT l_orderkey AS order_id, l_linenumber AS number, l_partkey AS item, l_suppkey % 10 AS supply_w, l_orderkey % 10 AS w, CAST(l_quantity AS BIGINT) AS quantity, coalesce(CAST(l_quantity AS BIGINT) * p_size, 0) AS amount, p_size IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 101 <> 0) ON p_partkey = l_partkey")
def tpcc_new_order_lines(spark, d):
    return T.new_order_lines(_lines(spark, d), _items(spark, d)).withColumn("amount", F.coalesce("amount", F.lit(0).cast("long")))


@query("""SELECT l_orderkey AS order_id, count(*) AS ol_cnt, CAST(sum(coalesce(CAST(l_quantity AS BIGINT) * p_size, 0)) AS BIGINT) AS total, bool_and(l_suppkey % 10 = l_orderkey % 10) AS all_local,
  CASE WHEN bool_or(p_size IS NULL) THEN 'ABORTED' ELSE 'COMMITTED' END AS status FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 101 <> 0) ON p_partkey = l_partkey GROUP BY l_orderkey""")
def tpcc_all_local(spark, d):
    return T.new_order(T.new_order_lines(_lines(spark, d), _items(spark, d)))


@query("""SELECT l_suppkey AS w, l_partkey AS item, list_reduce(list_prepend(10 + (l_partkey * 7 + l_suppkey) % 91, list(CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber)),
  lambda q, x: CASE WHEN q > x THEN q - x ELSE q - x + 91 END) AS quantity, count(*) AS n_orders FROM lineitem
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 101 <> 0)) GROUP BY l_suppkey, l_partkey""")
def tpcc_new_order_stock(spark, d):
    """Stock after the orders that commit: one with a missing item takes nothing."""
    lines = _lines(spark, d)
    done = T.new_order(T.new_order_lines(lines, _items(spark, d))).where("status = 'COMMITTED'").select("order_id")
    start = F.lit(10) + F.pmod(F.col("item") * 7 + F.col("w"), F.lit(91))
    sums = lines.join(done, "order_id", "left_semi").groupBy(F.col("l_suppkey").alias("w"), "item").agg(F.sum("quantity").alias("ordered"), F.count(F.lit(1)).alias("n_orders"))
    return sums.select("w", "item", T.stock_after(start, F.col("ordered")).alias("quantity"), "n_orders")


_CENTS = "CAST(round({0} * 100) AS BIGINT)"


@query(f"""SELECT c_custkey AS customer, {_CENTS.format('c_acctbal')} - coalesce(s, 0) AS balance, coalesce(s, 0) AS ytd_payment, coalesce(n, 0) AS payment_cnt FROM customer
LEFT JOIN (SELECT o_custkey, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def tpcc_payment(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return T.payment(table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), cents("c_acctbal").alias("balance")), table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), cents("o_totalprice").alias("amount")))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer, c_name AS name, o_orderstatus, coalesce(l_linenumber, 0) AS number, coalesce(l_partkey, 0) AS item, coalesce(CAST(l_quantity AS BIGINT), 0) AS quantity FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def tpcc_order_status(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), "o_orderstatus")
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))
    out = T.order_status(orders, names, _lines(spark, d).select("order_id", "number", "item", "quantity"))
    return out.select("order_id", "customer", "name", "o_orderstatus", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("number", "item", "quantity")))


@query("""SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderkey % 10 + 1 AS carrier, coalesce(a, 0) AS amount, coalesce(n, 0) AS n_lines FROM orders
LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""")
def tpcc_deliver(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"))
    return T.deliver(orders, _lines(spark, d).select("order_id", F.col("quantity").alias("amount")), F.pmod("order_id", F.lit(10)) + 1)


def _recent(spark, d):
    lines = _lines(spark, d).select(F.pmod("order_id", F.lit(10)).alias("district"), F.floor(F.col("order_id") / 10).alias("o_id"), "item", "supply_w")
    districts = table(spark, d, "orders").groupBy(F.pmod("o_orderkey", F.lit(10)).alias("district")).agg((F.max(F.floor(F.col("o_orderkey") / 10)) + 1).alias("next_o"))
    return T.stock_level(districts, lines)


_RECENT = """ds AS (SELECT o_orderkey % 10 AS district, max(o_orderkey // 10) + 1 AS next_o FROM orders GROUP BY 1),
rc AS (SELECT district, next_o, l_orderkey // 10 AS o_id, l_partkey AS item FROM lineitem JOIN ds ON district = l_orderkey % 10 WHERE l_orderkey // 10 < next_o AND l_orderkey // 10 >= next_o - 20)"""


@query(f"WITH {_RECENT} SELECT district, o_id, item, count(*) AS n FROM rc GROUP BY ALL")
def tpcc_stock_level(spark, d):
    return _recent(spark, d).groupBy("district", "o_id", "item").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RECENT} SELECT district, count(DISTINCT item) AS n_low FROM rc JOIN part ON p_partkey = item WHERE p_size < 25 GROUP BY district")
def ext_tpcc_stock_level_count(spark, d):
    """An extension: how many different items of those lines are low."""
    low = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("item"))
    return _recent(spark, d).join(low, "item").groupBy("district").agg(F.count_distinct("item").alias("n_low"))
