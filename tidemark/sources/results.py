"""Result files: CSV tables of transactions, events, summaries and metadata, and lines for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, folder: str, delimiter: str = ",") -> None:
    """With a header and without quotes; arrays are joined by ';'."""
    flat = rows.select(*(F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes))
    flat.write.option("header", True).option("sep", delimiter).option("quote", "").option("emptyValue", "").csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).option("quote", "").csv(folder)


def with_params(rows: DataFrame, params: dict[str, str]) -> DataFrame:
    """Metadata with a column wl:<name> for each parameter of the workload."""
    return rows.select("*", *(F.lit(str(v)).alias(f"wl:{k}") for k, v in sorted(params.items())))


def profile_line(txn: Column, keys: Column) -> Column:
    return F.concat_ws(" ", F.lit("txn"), txn.cast("string"), F.array_join(keys, " "))


def cells(*columns: str) -> Column:
    """A table's row as text, cells apart by bars."""
    return F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns))


def head(rows: DataFrame, n: int) -> DataFrame:
    """The first rows, for people; the limit is the feature."""
    return rows.limit(n)
