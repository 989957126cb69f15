"""Queries of what the TPC-C procedures write, a table each, and of the checks before they run (F1-F5, dispatcher)."""

from pyspark.sql import functions as F

from ..operators import tpcc as T
from .catalog import query, table
from .execution import _items, _lines

# Orders are placed in warehouse key % 10 and district key // 10 % 10; items divisible by 101 are missing.
_PRICED = """pl AS (SELECT l_orderkey AS order_id, l_linenumber AS number, l_partkey AS item, l_suppkey % 10 AS supply_w, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_quantity AS BIGINT) * p_size AS amount, p_size IS NULL AS missing,
  l_suppkey % 10 = l_orderkey % 10 AS local FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 101 <> 0) ON p_partkey = l_partkey),
dn AS (SELECT order_id, count(*) AS ol_cnt, bool_and(local) AS all_local FROM pl GROUP BY 1 HAVING NOT bool_or(missing))"""


def _priced(spark, d):
    return T.new_order_lines(_lines(spark, d), _items(spark, d))


def _done(spark, d):
    return T.new_order(_priced(spark, d))


def _placed(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("order_id"), F.pmod(key, F.lit(10)).alias("w"), F.pmod(F.floor(key / 10), F.lit(10)).alias("d"), F.col("o_custkey").alias("customer"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("entry_d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
    )


_PLACED = "od AS (SELECT o_orderkey AS order_id, o_orderkey % 10 AS w, o_orderkey // 10 % 10 AS d, o_custkey AS customer, epoch_us(o_orderdate) AS entry_d, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus FROM orders)"


def _districts(spark):
    places = spark.range(100).select(F.floor(F.col("id") / 10).alias("w"), F.pmod("id", F.lit(10)).alias("d"))
    return places.withColumn("next_o", F.lit(3001).cast("long") + F.col("d")).withColumn("ytd", F.lit(3_000_000).cast("long")).withColumn("d_name", F.concat(F.lit("d"), "d"))


@query("""WITH o AS (SELECT o_orderkey AS order_id, o_orderkey % 13 <> 0 AS hw, c_custkey IS NOT NULL AS hc, o_orderkey % 17 <> 0 AS hd FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 <> 7) ON c_custkey = o_custkey),
l AS (SELECT l_orderkey AS order_id, l_linenumber AS number, l_partkey % 11 <> 0 AS hi, (l_partkey + l_suppkey) % 19 <> 0 AS hs FROM lineitem),
b AS (SELECT order_id, min(number * 2 + CASE WHEN hi THEN 1 ELSE 0 END) AS worst FROM l WHERE NOT (hi AND hs) GROUP BY 1),
r AS (SELECT order_id, CASE WHEN NOT hw THEN 'Warehouse does not exist' WHEN NOT hc THEN 'The customer does not exist' WHEN NOT hd THEN 'The district does not exist' WHEN worst % 2 = 0 THEN 'The item does not exist' WHEN worst % 2 = 1 THEN 'Stock of the item does not exist' END AS e FROM o LEFT JOIN b USING (order_id))
SELECT order_id, CASE WHEN e IS NULL THEN 'COMMITTED' ELSE 'ABORTED' END AS status, coalesce('NewOrder Txn - ' || e, '') AS abort_reason FROM r""")
def tpcc_new_order_errors(spark, d):
    """the first error of each new order."""
    customers = table(spark, d, "customer").where(F.pmod("c_custkey", F.lit(50)) != 7).select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = table(spark, d, "orders").join(customers, "o_custkey", "left")
    heads = o.select(F.col("o_orderkey").alias("order_id"), (F.pmod("o_orderkey", F.lit(13)) != 0).alias("has_warehouse"), F.coalesce("known", F.lit(False)).alias("has_customer"), (F.pmod("o_orderkey", F.lit(17)) != 0).alias("has_district"))
    lines = _lines(spark, d).select("order_id", "number", (F.pmod("item", F.lit(11)) != 0).alias("has_item"), (F.pmod(F.col("item") + F.col("l_suppkey"), F.lit(19)) != 0).alias("has_stock"))
    return T.first_error(heads, lines)


@query(f"WITH {_PRICED}, {_PLACED} SELECT w, d, CAST(3001 + d + (SELECT count(*) FROM od JOIN dn USING (order_id) WHERE od.w = p.w AND od.d = p.d) AS BIGINT) AS next_o FROM (SELECT range // 10 AS w, range % 10 AS d FROM range(100)) p")
def tpcc_new_order_district(spark, d):
    """the next order number of each district."""
    committed = _placed(spark, d).join(_done(spark, d).where("status = 'COMMITTED'"), "order_id", "left_semi")
    return T.next_order_ids(_districts(spark), committed)


@query(f"WITH {_PRICED}, {_PLACED} SELECT order_id, w, d, customer, entry_d, ol_cnt, all_local, 0 AS carrier FROM od JOIN dn USING (order_id)")
def tpcc_new_order_rows(spark, d):
    """orders inserted; their keys are also the rows of new_order."""
    return T.order_rows(_placed(spark, d).drop("amount"), _done(spark, d))


@query(f"WITH {_PRICED} SELECT order_id, number, item, supply_w, CAST(0 AS BIGINT) AS delivery_d, quantity, amount, substr(repeat('dist' || supply_w || '-' || item || ';', 20), 1, 24) AS dist_info FROM pl WHERE order_id IN (SELECT order_id FROM dn)")
def tpcc_order_line_rows(spark, d):
    """lines inserted."""
    all_dist = F.repeat(F.concat(F.lit("dist"), "supply_w", F.lit("-"), "item", F.lit(";")), 20)
    return T.order_line_rows(_priced(spark, d), _done(spark, d), all_dist)


@query(f"WITH {_PLACED} SELECT w, CAST(30000000 + sum(amount) AS BIGINT) AS ytd FROM od GROUP BY w")
def tpcc_payment_warehouse(spark, d):
    """what warehouses took in the year."""
    places = _districts(spark).groupBy("w").agg(F.sum("ytd").alias("ytd"))
    return T.paid_in(places, _placed(spark, d), ["w"])


@query(f"WITH {_PLACED} SELECT w, d, CAST(3000000 + sum(amount) AS BIGINT) AS ytd FROM od GROUP BY w, d")
def tpcc_payment_district(spark, d):
    """what districts took in the year."""
    return T.paid_in(_districts(spark), _placed(spark, d), ["w", "d"])


@query(f"WITH {_PLACED} SELECT order_id AS history_id, w, d, customer, amount, 'w' || w || '    d' || d AS data FROM od")
def tpcc_payment_history(spark, d):
    """history rows."""
    warehouses = spark.range(10).select(F.col("id").alias("w"), F.concat(F.lit("w"), "id").alias("w_name"))
    return T.history(_placed(spark, d).withColumnRenamed("order_id", "history_id"), warehouses, _districts(spark))


_DELIVERED = f"""{_PLACED}, am AS (SELECT l_orderkey AS order_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY 1),
dl AS (SELECT order_id, customer, coalesce(am.amount, 0) AS amount, entry_d + 86400000000 AS date FROM od LEFT JOIN am USING (order_id) WHERE o_orderstatus = 'O')"""


def _deliveries(spark, d):
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    mine = _placed(spark, d).drop("amount").join(open_orders, "order_id", "left_semi")
    sums = T.deliver(mine, _lines(spark, d).select("order_id", F.col("quantity").alias("amount")), F.pmod("order_id", F.lit(10)) + 1)
    return sums.join(mine.select("order_id", (F.col("entry_d") + 86_400_000_000).alias("date")), "order_id")


@query(f"WITH {_DELIVERED} SELECT c_custkey AS customer, CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(s, 0) AS balance, coalesce(n, 0) AS delivery_cnt FROM customer LEFT JOIN (SELECT customer, CAST(sum(amount) AS BIGINT) AS s, count(*) AS n FROM dl GROUP BY 1) ON customer = c_custkey")
def tpcc_deliver_customer(spark, d):
    """balances and counts of deliveries."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), F.lit(0).cast("long").alias("delivery_cnt"))
    return T.delivered_customers(c, _deliveries(spark, d))


@query(f"WITH {_DELIVERED} SELECT order_id, CAST(order_id % 10 + 1 AS BIGINT) AS carrier FROM dl UNION ALL SELECT order_id, 0 FROM od WHERE o_orderstatus <> 'O'")
def tpcc_deliver_orders(spark, d):
    """carriers of all orders; those without one (0) are what stays in new_order."""
    got = _deliveries(spark, d).select("order_id", "carrier")
    return _placed(spark, d).select("order_id").join(got, "order_id", "left").select("order_id", F.coalesce("carrier", F.lit(0)).cast("long").alias("carrier"))


@query(f"WITH {_DELIVERED} SELECT l_orderkey AS order_id, l_linenumber AS number, l_partkey AS item, coalesce(date, 0) AS delivery_d FROM lineitem LEFT JOIN dl ON order_id = l_orderkey")
def tpcc_deliver_lines(spark, d):
    """delivery dates of lines."""
    return T.delivered_lines(_lines(spark, d).select("order_id", "number", "item"), _deliveries(spark, d))


@query(f"""WITH {_DELIVERED} SELECT o.order_id, o.customer, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, o.entry_d, CASE WHEN o_orderstatus = 'O' THEN o.order_id % 10 + 1 ELSE 0 END AS carrier,
l_linenumber AS number, l_partkey AS item, l_suppkey % 10 AS supply_w, CAST(l_quantity AS BIGINT) AS quantity, coalesce(date, 0) AS delivery_d FROM od o JOIN customer ON c_custkey = o.customer JOIN lineitem ON l_orderkey = o.order_id LEFT JOIN dl ON dl.order_id = o.order_id""")
def tpcc_order_status_full(spark, d):
    """all that the procedure reads, after deliveries."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    got = _deliveries(spark, d).select("order_id", "carrier", "date")
    lines = _lines(spark, d).select("order_id", "number", "item", "supply_w", "quantity")
    rows = T.order_status(_placed(spark, d).drop("w", "d", "amount"), c, lines).where("number IS NOT NULL AND name IS NOT NULL").join(got, "order_id", "left")
    return rows.withColumn("carrier", F.coalesce("carrier", F.lit(0)).cast("long")).withColumn("delivery_d", F.coalesce("date", F.lit(0).cast("long"))).drop("date")


@query("""WITH k AS (SELECT o_orderkey AS txn_id, o_orderkey % 7 AS kind, o_custkey % 4 = 0 AS longer, o_custkey % 5 = 0 AS fewer, o_custkey % 3 = 0 AS line FROM orders)
SELECT txn_id, CASE kind WHEN 0 THEN CASE WHEN longer OR fewer THEN 'NewOrder Txn - Invalid number of arguments' WHEN line THEN 'NewOrder Txn - Invalid number of arguments for order line' ELSE '' END
  WHEN 1 THEN CASE WHEN longer THEN 'Payment Txn - Invalid number of arguments' ELSE '' END WHEN 2 THEN CASE WHEN longer THEN 'OrderStatus Txn - Invalid number of arguments' ELSE '' END
  WHEN 3 THEN CASE WHEN longer THEN 'Deliver Txn - Invalid number of arguments' ELSE '' END WHEN 4 THEN CASE WHEN longer THEN 'StockLevel Txn - Invalid number of arguments' WHEN fewer THEN 'StockLevel Txn - Invalid number of items' ELSE '' END
  WHEN 5 THEN 'Unknown procedure name' ELSE 'Invalid code' END AS abort_reason FROM k""")
def tpcc_dispatch(spark, d):
    """Calls of every procedure, an unknown one and none, some with an argument, a line or an item too many or too few."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind, names = F.pmod(key, F.lit(7)), [*T.PROCEDURES, "refund"]
    longer, fewer, line = (F.pmod(cust, F.lit(m)) == 0 for m in (4, 5, 3))
    args = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    arity = F.coalesce(F.get(F.array(*(F.lit(T.PROCEDURES[p][1]) for p in T.PROCEDURES), F.lit(3)), kind), F.lit(3))
    head = F.concat(F.array(F.get(F.array(*map(F.lit, names)), kind)), args(arity - 1 + longer.cast("int")))
    lines = F.transform(F.sequence(F.lit(1), T.LINES - fewer.cast("int")), lambda i: args(F.when(line & (i == 3), T.LINE_ARGS - 1).otherwise(T.LINE_ARGS)))
    calls = F.when(kind == 6, F.array().cast("array<array<string>>")).when(kind == 0, F.concat(F.array(head), lines)).when(kind == 4, F.array(head, args(T.STOCK_ITEMS - fewer.cast("int")))).otherwise(F.array(head))
    return table(spark, d, "orders").select(key.alias("txn_id"), T.dispatched(calls).alias("abort_reason"))
