"""Sources of transactions, configurations, matrices and logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TXN = "read_set array<string>, write_set array<string>, code array<array<string>>, new_master int"


def json_txns(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of JSON files: keys (writes before reads) with whether they are written, code and new master."""
    rows = spark.read.schema(TXN).option("multiLine", True).json(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    none = F.array().cast("array<string>")
    key = lambda w: lambda k: F.struct(k.alias("key"), F.lit(w).alias("is_write"))
    keys = F.concat(F.transform(F.coalesce("write_set", none), key(True)), F.transform(F.coalesce("read_set", none), key(False)))
    return rows.select("file", keys.alias("keys"), "code", "new_master")


def accesses(txns: DataFrame) -> DataFrame:
    """A row for each declared key, in order."""
    return txns.select("file", F.posexplode("keys").alias("place", "k")).select("file", "place", "k.key", "k.is_write")


def procedures(txns: DataFrame) -> DataFrame:
    """A row for each command, in order: name and two arguments."""
    rows = txns.select("file", F.posexplode("code").alias("seq", "args"))
    return rows.select("file", "seq", *(F.get("args", i).alias(n) for i, n in enumerate(("command", "a", "b"))))


def simple_store(spark: SparkSession, n: int, record_size: int, partitions: int, regions: int) -> DataFrame:
    """Keys 0 to n - 1 as text, values of one letter repeated, placed by arithmetic."""
    from ..functions import placement as P

    return spark.range(n).select(F.col("id").cast("string").alias("key"), F.repeat(F.lit("a"), record_size).alias("value"), P.simple_home("id", partitions, regions).alias("master"), P.simple_partition("id", partitions).alias("part"))


def latency_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, ms) of files with a row of one-way milliseconds for each region; a row's number is in its order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit("([^\\n]+)"), F.lit(1))).alias("from", "line"))
    return rows.select("from", F.posexplode(F.split("line", ",")).alias("to", "ms")).select("from", "to", F.trim("ms").cast("double").alias("ms"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with more than three words, with the thread (the third word) and their place in the file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return rows.where(F.size(words) > 3).select("place", "line", F.element_at(words, 3).alias("thread"))


@dataclass(frozen=True)
class Configuration:
    """A cluster's shape and timing."""

    regions: int
    partitions: int
    replication_order: dict[int, list[int]] = field(default_factory=dict)
    replication_factor: int = 1
    hash_bytes: int = 0
    batch_us: int = 1000
    batch_size: int = 0
    execution: str = "KEY_VALUE"
    bypass_orderer: bool = False

    def __post_init__(self):
        if self.regions < 1 or self.partitions < 1:
            raise ValueError("there must be a region and a partition at least")
        if not 1 <= self.replication_factor <= self.regions:
            raise ValueError("replication factor must be from 1 to the number of regions")
        for home, order in self.replication_order.items():
            if len(order) != self.regions - 1 or set(order) | {home} != set(range(self.regions)):
                raise ValueError(f"replication order of region {home} must name every other region once")

    @classmethod
    def of(cls, values: dict) -> Configuration:
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)
