"""The keyed store: point reads, last-writer-wins upserts, deletes, and tables of grouped or single-column rows.

STORE has key, value, master, counter. A change appends a version; the state is the last version of each key, which is
one aggregation with partial results, so a very hot key is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_read(access: DataFrame, store: DataFrame) -> DataFrame:
    """Values of the keys that transactions declare; keys that the store lacks give no row."""
    return access.join(store.select("key", "value"), "key")


def last_versions(versions: DataFrame, position: Column) -> DataFrame:
    """The last version of each key by position: value, and whether it is a delete."""
    return versions.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), position).alias("v")).select("key", "v.value", "v.deleted")


def apply_versions(store: DataFrame, last: DataFrame) -> DataFrame:
    """The store with the last versions put in: changed, new and removed keys. existed: the key was there before."""
    old = store.select("key", F.col("value").alias("old"), F.lit(True).alias("existed"))
    both = old.join(last.withColumn("written", F.lit(True)), "key", "full_outer")
    kept = both.where(~F.coalesce("deleted", F.lit(False)))
    return kept.select("key", F.when(F.col("written"), F.col("value")).otherwise(F.col("old")).alias("value"), F.coalesce("existed", F.lit(False)).alias("existed"))


def to_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each column of a table whose columns are stored one by one; nulls have no cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(F.col(key).alias("key"), cells.alias("cell")).select("key", "cell.*").where(F.col("value").isNotNull())


def from_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Rows put together of their cells: a missing cell is null and shifts no other; no cell at all, no row."""
    return cells.groupBy("key").agg(*(F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns))


def update(rows: DataFrame, changes: DataFrame, key: str, column: str, new: Column) -> DataFrame:
    """Rows with a column changed where there is a change for the key; changes without a row do nothing."""
    return rows.join(changes, key, "left").withColumn(column, F.coalesce(new, F.col(column)))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def wrong_width(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows in which a text of fixed width has another one: what a typed table refuses."""
    bad = F.array_compact(F.array(*(F.when(F.length(c) != w, F.lit(c)) for c, w in widths.items())))
    return rows.withColumn("wrong", bad).where(F.size("wrong") > 0)


def read_write_set(uses: DataFrame) -> DataFrame:
    """The access list that a dry run of procedures records (txn_id, key, is_write): a write overrides a read."""
    return uses.groupBy("txn_id", "key").agg(F.bool_or("is_write").alias("is_write"))


def first_declared(access: DataFrame, position: Column) -> DataFrame:
    """Of a key that a transaction declares twice the first entry holds."""
    return access.groupBy("txn_id", "key").agg(F.min_by("is_write", position).alias("is_write"), F.count(F.lit(1)).alias("n_declared"))
