"""TPC-C procedures over batches of orders, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Restock quantity, lines looked back on.
RESTOCK, LOOK_BACK = 91, 20


def stock_after(start: Column, ordered: Column) -> Column:
    """Stock after orders of ``ordered`` in total, each of at most 50, from a stock of ``start``.

    Each order takes its quantity, and 91 more come in if it is not less than the stock. In the range 1 to 91 that is
    subtraction modulo 91; a start above it goes down plainly until it is in range. So the outcome depends on the sum
    alone, whatever the order of the orders, and a very frequent item sums up in parts.
    """
    left = start - ordered
    return F.when(left > RESTOCK, left).otherwise(F.pmod(left - 1, F.lit(RESTOCK)) + 1)


def new_order_lines(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Amount of each line; an order with a line whose item is missing aborts. lines: order_id, number, item, supply_w, w, quantity."""
    return lines.join(items.select("item", "price"), "item", "left").select("order_id", "number", "item", "supply_w", "w", "quantity", (F.col("quantity") * F.col("price")).alias("amount"), F.col("price").isNull().alias("missing"))


def new_order(priced: DataFrame) -> DataFrame:
    """Each order: lines, total, whether all supply is local, and its status."""
    return priced.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("ol_cnt"), F.sum(F.coalesce("amount", F.lit(0))).alias("total"), F.bool_and(F.col("supply_w") == F.col("w")).alias("all_local"),
        F.when(F.bool_or("missing"), "ABORTED").otherwise("COMMITTED").alias("status"),
    )


def payment(customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Balance, paid sum and count of customers after their payments (customer, amount); those without stay."""
    paid = payments.groupBy("customer").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return customers.join(paid, "customer", "left").select(
        "customer", (F.col("balance") - F.coalesce("amount", F.lit(0))).alias("balance"), F.coalesce("amount", F.lit(0)).cast("long").alias("ytd_payment"), F.coalesce("n", F.lit(0)).cast("long").alias("payment_cnt")
    )


def order_status(orders: DataFrame, customers: DataFrame, lines: DataFrame) -> DataFrame:
    """An order with its customer and lines; what is missing is null."""
    return orders.join(customers, "customer", "left").join(lines, "order_id", "left")


def deliver(orders: DataFrame, lines: DataFrame, carrier: Column) -> DataFrame:
    """Orders delivered by a carrier: the sum of their lines, which goes to the customer's balance."""
    sums = lines.groupBy("order_id").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_lines"))
    return orders.join(sums, "order_id", "left").select("order_id", "customer", carrier.alias("carrier"), F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def stock_level(districts: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the orders before each district's next one: next_o - 20 up to next_o - 1."""
    near = lines.join(districts, "district")
    return near.where((F.col("o_id") < F.col("next_o")) & (F.col("o_id") >= F.col("next_o") - LOOK_BACK))


def first_error(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """New orders with the first of their errors in the order of reading: warehouse, customer, district, then line by
    line the item and its stock. orders: order_id, has_warehouse, has_customer, has_district; lines: order_id, number,
    has_item, has_stock. Reasons are empty for those that commit; an order without lines has only the first three.
    """
    item, stock = F.when(~F.col("has_item"), "The item does not exist"), F.when(~F.col("has_stock"), "Stock of the item does not exist")
    of_lines = lines.where("NOT has_item OR NOT has_stock").groupBy("order_id").agg(F.min(F.struct("number", F.col("has_item"), F.coalesce(item, stock).alias("error"))).alias("worst"))
    heads = F.coalesce(F.when(~F.col("has_warehouse"), "Warehouse does not exist"), F.when(~F.col("has_customer"), "The customer does not exist"), F.when(~F.col("has_district"), "The district does not exist"))
    reason = F.coalesce(heads, F.col("worst.error"))
    return orders.join(of_lines, "order_id", "left").select(
        "order_id", F.when(reason.isNull(), "COMMITTED").otherwise("ABORTED").alias("status"), F.coalesce(F.concat(F.lit("NewOrder Txn - "), reason), F.lit("")).alias("abort_reason")
    )


def next_order_ids(districts: DataFrame, committed: DataFrame) -> DataFrame:
    """Districts (w, d, next_o) after new orders (w, d): each that commits raises the next number by one."""
    n = committed.groupBy("w", "d").agg(F.count(F.lit(1)).alias("n"))
    return districts.join(n, ["w", "d"], "left").select("w", "d", (F.col("next_o") + F.coalesce("n", F.lit(0))).alias("next_o"))


def order_rows(orders: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that committed orders insert: no carrier yet (0), the count of lines and whether all supply is local."""
    return orders.join(done.where("status = 'COMMITTED'").select("order_id", "ol_cnt", "all_local"), "order_id").withColumn("carrier", F.lit(0))


def order_line_rows(priced: DataFrame, done: DataFrame, all_dist: Column) -> DataFrame:
    """Rows of lines that committed orders insert: no delivery yet (0), the first 24 characters of the stock's district texts."""
    rows = priced.join(done.where("status = 'COMMITTED'").select("order_id"), "order_id", "left_semi")
    return rows.select("order_id", "number", "item", "supply_w", F.lit(0).cast("long").alias("delivery_d"), "quantity", "amount", F.substring(all_dist, 1, 24).alias("dist_info"))


def paid_in(places: DataFrame, payments: DataFrame, key: list[str]) -> DataFrame:
    """Warehouses or districts with what was paid in added to their sum of the year (ytd)."""
    return places.join(payments.groupBy(*key).agg(F.sum("amount").alias("amount")), key, "left").select(*key, (F.col("ytd") + F.coalesce("amount", F.lit(0))).cast("long").alias("ytd"))


def history(payments: DataFrame, warehouses: DataFrame, districts: DataFrame) -> DataFrame:
    """History rows of payments; data is the warehouse's name, four spaces and the district's. One of a place or customer that is missing aborts elsewhere and leaves none."""
    named = payments.join(warehouses.select("w", "w_name"), "w").join(districts.select("w", "d", "d_name"), ["w", "d"])
    return named.select("history_id", "w", "d", "customer", "amount", F.concat("w_name", F.lit("    "), "d_name").alias("data"))


def delivered_customers(customers: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Customers (balance, delivery_cnt) after deliveries (customer, amount)."""
    sums = deliveries.groupBy("customer").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return customers.join(sums, "customer", "left").select("customer", (F.col("balance") + F.coalesce("amount", F.lit(0))).cast("long").alias("balance"), (F.col("delivery_cnt") + F.coalesce("n", F.lit(0))).cast("long").alias("delivery_cnt"))


def delivered_lines(lines: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Lines with the date of their order's delivery (order_id, date); others keep 0."""
    return lines.join(deliveries.select("order_id", "date"), "order_id", "left").withColumn("delivery_d", F.coalesce("date", F.lit(0))).drop("date")


# For each procedure its name in messages and how many arguments it takes, its own name among them.
PROCEDURES = {"new_order": ("NewOrder", 7), "payment": ("Payment", 9), "order_status": ("OrderStatus", 5), "deliver": ("Deliver", 7), "stock_level": ("StockLevel", 4)}
LINES, LINE_ARGS, STOCK_ITEMS = 10, 4, 200


def dispatched(calls: Column) -> Column:
    """Why a call (its procedures: arrays of arguments, the first with the name) is refused before it runs; empty if it is not.

    A null call, one without procedures and one whose first has no arguments are all invalid code.
    """
    head = F.get(calls, F.lit(0))
    name, n, more = F.get(head, F.lit(0)), F.size(head), F.size(calls)

    def bad(of: str, what: str) -> Column:
        return F.lit(f"{PROCEDURES[of][0]} Txn - Invalid number of {what}")

    right = {p: n == PROCEDURES[p][1] for p in PROCEDURES}
    why = F.when(calls.isNull() | (more <= 0) | head.isNull() | (n <= 0), "Invalid code")
    why = why.when((name == "new_order") & ~(right["new_order"] & (more == LINES + 1)), bad("new_order", "arguments"))
    why = why.when((name == "new_order") & F.exists(F.slice(calls, 2, LINES), lambda line: F.size(line) != LINE_ARGS), bad("new_order", "arguments for order line"))
    why = why.when((name == "stock_level") & ~(right["stock_level"] & (more == 2)), bad("stock_level", "arguments"))
    why = why.when((name == "stock_level") & (F.size(F.get(calls, F.lit(1))) != STOCK_ITEMS), bad("stock_level", "items"))
    for p in ("payment", "order_status", "deliver"):
        why = why.when((name == p) & ~right[p], bad(p, "arguments"))
    return why.when(name.isNull() | ~name.isin(*PROCEDURES), "Unknown procedure name").otherwise("")
