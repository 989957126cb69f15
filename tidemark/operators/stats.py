"""Statistics, sampling and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TENTHS = tuple(range(0, 101, 10))


def floor_percentiles(rows: DataFrame, group: list[str], value: str, percents=TENTHS) -> DataFrame:
    """For each group and percent p the value at place floor(p * (n - 1) / 100) of the sorted ones; no interpolation.

    Values are counted first, so a group is as many rows as it has different values; places are running counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*group)
    upto = F.sum("n").over(by.orderBy(value))
    placed = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(by))
    asked = placed.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("place", F.floor(F.col("percent") * (F.col("total") - 1) / 100))
    hit = asked.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return hit.select(*group, "percent", value)


def summary(txns: DataFrame, group: list[str]) -> DataFrame:
    """Counters of results: committed, aborted, single and multi-home, single and multi-partition, moves."""
    return txns.groupBy(*group).agg(
        F.count_if(F.col("status") == "COMMITTED").alias("committed"), F.count_if(F.col("status") == "ABORTED").alias("aborted"), F.count_if(F.col("status") == "NOT_STARTED").alias("not_started"),
        F.count_if(F.col("n_homes") == 1).alias("single_home"), F.count_if(F.col("n_homes") > 1).alias("multi_home"),
        F.count_if(F.col("n_parts") == 1).alias("single_partition"), F.count_if(F.col("n_parts") > 1).alias("multi_partition"), F.count_if("is_remaster").alias("remaster"),
    )


def average_rate(txns: DataFrame, generator: str, start: str, end: str) -> DataFrame:
    """Transactions a second of all generators: each its committed by its own elapsed time, summed and floored."""
    each = txns.groupBy(generator).agg(F.count_if(F.col("status") == "COMMITTED").alias("committed"), ((F.max(end) - F.min(start)) / 1e6).alias("seconds"))
    return each.agg(F.floor(F.sum(F.col("committed") / F.col("seconds"))).alias("avg_tps"), F.sum("committed").alias("committed"))


def rate_by_second(events: DataFrame, group: list[str], t_us: str, step_us: int = 1_000_000) -> DataFrame:
    """Events in each step of time, and the change against the step before that had any."""
    steps = events.groupBy(*group, F.floor(F.col(t_us) / step_us).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    last = Window.partitionBy(*group).orderBy("step")
    return steps.withColumn("change", F.col("n") - F.lag("n", 1, 0).over(last))


def sample_size(n: int, percent: int, least: int) -> int:
    """How many of n results are kept: a part of a hundred, ``least`` at least, and no more than there are."""
    return min(n, max(n * percent // 100, least))


def exact_sample(rows: DataFrame, number: Column, order: list[str], size: int, buckets: int = 4096) -> DataFrame:
    """A seeded sample of exactly ``size`` rows: those of the least numbers (0 to 2^31 - 1), equal ones by ``order``.

    Buckets of numbers are counted first, ``buckets`` rows. Rows of buckets that are taken whole stay where they are; only
    those of the bucket in which the sample ends are sorted.
    """
    bucket, taken = F.floor(number / ((1 << 31) // buckets)), 0
    for b, n in sorted(tuple(r) for r in rows.groupBy(bucket.alias("bucket")).count().collect()):
        if taken + n > size:
            return rows.where(bucket < b).unionByName(rows.where(bucket == b).orderBy(number, *order).limit(size - taken))
        taken += n
    return rows


def rate_between(events: DataFrame, group: list[str], t_ms: str, step_ms: int = 1000) -> DataFrame:
    """Events a second at the last event of each step: their number since the last of the step before, by the time between."""
    steps = events.groupBy(*group, F.floor(F.col(t_ms) / step_ms).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max(t_ms).alias("last"))
    took = F.col("last") - F.lag("last").over(Window.partitionBy(*group).orderBy("step"))
    return steps.withColumn("took_ms", took).withColumn("rate", F.floor(F.col("n") * 1000 / F.col("took_ms"))).where(F.col("took_ms") > 0).drop("last")


def throughput_text(n: Column, took_ms: Column) -> Column:
    """Transactions a second to three places, rounded half up; inf where no time has passed."""
    thousandths = F.floor((n * 2_000_000 + took_ms) / (took_ms * 2))
    text = F.concat(F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(thousandths, F.lit(1000)).cast("string"), 3, "0"))
    return F.when(took_ms == 0, "inf").otherwise(text)


def lcg(x, seed: int = 12345) -> Column:
    """A seeded integer hash that any engine can repeat, from 0 to 2^31 - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.pmod(F.pmod(x, F.lit(1 << 20)).cast("long") * F.lit(1103515245) + F.lit(seed), F.lit(1 << 31))


def masked(events: DataFrame, group: list[str], order: list[str], percent: int) -> DataFrame:
    """Events whose counter within the group falls on a set slot of a mask of 256: a part that is exact in every 256."""
    counter = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    slot = F.pmod(counter, F.lit(256))
    # the mask is a fixed shuffle of the slots; a slot is set if it comes early in it
    return events.withColumn("slot", slot.cast("long")).where(F.pmod(F.col("slot") * 167 + 13, F.lit(256)) < F.lit(256 * percent // 100))


def gated(events: DataFrame, names: list[str]) -> DataFrame:
    """Events of the named kinds; ALL lets everything through."""
    return events if "ALL" in names else events.where(F.col("event_type").isin(names))


def stages(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Time between each event and the one before it of the same transaction."""
    last = Window.partitionBy(group).orderBy(*order)
    return events.withColumn("from_event", F.lag("event_type").over(last)).withColumn("took_us", F.col("t") - F.lag("t").over(last)).where(F.col("from_event").isNotNull())
