"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row has an exponential key, ``-ln(u) / weight``: u comes from a hash of the whole row, the weight from its quality.
Within a source the rows of smallest keys come first. A source first gives as many complete epochs as its target holds,
and then, in key order, rows until the rest of the target is met.

The rest is found without sorting a source as a whole. Words are summed by (source, leading digits of the key), the sums
are prefix-summed, and the bucket in which the target falls is looked at by further digits, until it has at most
``EDGE_ROWS`` rows; these are sorted, equal rows as one with a count. What comes out of that is a row for each source
with a cut-off key, and how many of the rows that stand exactly there are taken. Every row is then held against it. Rows
that are equal in all columns are interchangeable, so those of a group that is taken in part come back from their count.
Texts are never shuffled while the sources are fewer than ``BROADCAST_SOURCES`` (beyond it: an ordinary join), but for
one text a source.

Defined results: a null text has no words and no weight in the targets; rows without words are taken like others but
count 0 words; a null source is one source, the last; equal rows are taken by number; extra columns pass through
untouched, whatever they are called, and count for a row's key; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 20
#: A key is a whole number below 2^63; how many digits go at each look, and rows in a bucket that is small enough.
ONE = 2.0**53
SHIFTS = (46, 34, 22, 10, 0)
EDGE_ROWS = 100_000
LEAST_WEIGHT = 0.05
#: A decision row for each source is broadcast up to this many sources, some 100 bytes each.
BROADCAST_SOURCES = 10_000
#: Rows that one row's count becomes in one task.
REPEATED = 10_000


def text_size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight() -> Column:
    """From 0.05 to 1: the part of words without a run of decorating symbols."""
    decorated = F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>!]+")), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - decorated / (text_size() + 1))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """row (all columns of ``docs``), src (null-safe), size, key and tie: rows of one key and tie are taken to be equal."""
    column = lambda c: F.col(f"`{c.replace('`', '``')}`")
    values = [F.to_json(F.struct(column(c))) if "map<" in kind else column(c) for c, kind in docs.dtypes]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return docs.select(
        F.struct(*map(column, docs.columns)).alias("row"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("src"), text_size().alias("size"),
        (-F.log(u) / quality_weight() * ONE).cast("long").alias("key"), F.xxhash64(F.lit(seed + 1), *values).alias("tie"),
    )


def numbered(by_source: DataFrame) -> DataFrame:
    """With ``place``, the rank of each source by code point, from 0: places in parts of the range, plus what is before."""
    ordered = cut(by_source.repartitionByRange("src").sortWithinPartitions("src"))
    placed = ordered.withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    starts, at = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):  # a row a partition
        starts.append((r["part"], at))
        at += r["count"]
    before = F.broadcast(ordered.sparkSession.createDataFrame(starts, "part int, before long"))
    return placed.join(before, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(by_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """src, source_size -> also target: shares of the whole by weight, none above ``cap`` times its source.

    What is above is shared anew until nothing is: each round is an aggregate over the sources and fills one at least.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = cut(numbered(by_source.select("src", "source_size")).select("src", "source_size", weight.alias("w")))
    most = cap * F.col("source_size").cast("double")
    total, left_w = table.agg(F.sum(F.col("source_size").cast("double")), F.sum("w")).first()
    level, full = (total or 0.0) / (left_w or 1.0), 0
    while True:
        over = F.col("w") * F.lit(level) > most
        now_full, filled, free_w = table.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("w")))).first()
        if not now_full or now_full == full or not free_w:
            break
        full, level = now_full, (total - filled) / free_w
    return table.select("src", "source_size", F.least(F.col("w") * F.lit(level), most).alias("target"))


def small(per_source: DataFrame) -> DataFrame:
    """Broadcast after a look at its size; a table of very many sources is joined in the ordinary way."""
    per_source = cut(per_source)
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def edges(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, int]:
    """src, edge, before: the bucket in which each source's rest ends, by key without ``shift`` digits; and shift."""
    edge, before_shift = None, 0
    for shift in SHIFTS:
        inside = rows
        if edge is not None:
            up = edge.select("src", F.col("edge").alias("up"), F.col("before").alias("base"))
            inside = rows.join(small(up), "src").where(F.shiftright("key", before_shift) == F.col("up"))
        else:
            inside = rows.withColumn("base", F.lit(0).cast("long"))
        sums = inside.groupBy("src", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("base").alias("base"))
        upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        met = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(upto), F.lit(0))).join(plan.select("src", "rest"), "src").where(F.col("before") <= F.col("rest"))
        found = met.groupBy("src").agg(F.max_by(F.struct("bucket", "before", "n"), "bucket").alias("e"))
        edge = cut(found.select("src", F.col("e.bucket").alias("edge"), "e.before", "e.n"))
        before_shift = shift
        if (edge.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
    return edge, before_shift


def decide(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: target, complete epochs, the key below which rows are taken once more (``low``), and the last
    group of equal rows from there on that is (key, tie, how many of how many)."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(targets(sizes, weights, cap).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    edge, shift = edges(rows, plan)
    at_edge = rows.join(small(edge.select("src", "edge", "before")), "src").where(F.shiftright("key", shift) == F.col("edge"))
    groups = at_edge.groupBy("src", "key", "tie", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"))
    inside = Window.partitionBy("src").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = groups.withColumn("begin", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))).join(plan.select("src", "rest"), "src")
    # a row is taken if at least half of it fits
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("begin")) / F.col("size") + 0.5)).when(F.col("begin") <= F.col("rest"), F.col("n")).otherwise(0)
    taken = begun.withColumn("m", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long")).where("m > 0")
    last = taken.groupBy("src").agg(F.max(F.struct("key", "tie", "size", "m", "n")).alias("last"))
    lows = edge.select("src", F.shiftleft("edge", shift).alias("low"))
    return cut(plan.join(lows, "src", "left").join(last, "src", "left").select("src", "source_size", "target", "epochs", "low", "last"))


def taken_rows(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with source_size, target and copies (how often the mix takes the row); and, if a source takes part of a
    group of equal rows, those groups: a row of each with ``n`` rows, of which ``more`` are taken once more than copies."""
    d = F.broadcast(decisions) if decisions.count() <= BROADCAST_SOURCES else decisions
    at = F.struct("key", "tie", "size")
    last = F.struct("last.key", "last.tie", "last.size")
    once_more = F.coalesce((F.col("key") < F.col("low")) | (at <= last), F.lit(False))
    split = F.coalesce((at == last) & (F.col("last.m") < F.col("last.n")), F.lit(False))
    every = rows.join(d, "src", "left").withColumn("copies", F.col("epochs") + once_more.cast("long"))
    whole = every.where(~split)
    if decisions.where("last.m < last.n").isEmpty():
        return every, None
    same = every.where(split).groupBy("src", "key", "tie").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), *(F.first(c).alias(c) for c in ("size", "source_size", "target", "epochs", "last")))
    return whole, same.select("src", "row", "size", "source_size", "target", F.col("epochs").alias("copies"), "n", F.col("last.m").alias("more"))


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row so many times; a large number is dealt to many tasks."""
    whole = rows.withColumn("times", times).where("times > 0")
    dealt = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATED))).alias("deal")).repartition("deal")
    here = F.least(F.lit(REPEATED), F.col("times") - F.col("deal") * REPEATED).cast("int")
    return dealt.withColumn("again", F.explode(F.array_repeat(F.lit(0), here))).drop("times", "deal", "again")


def digest(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows = cut(keyed(docs, seed).select(F.struct("row.doc_id").alias("row"), "src", "size", "key", "tie"))
    whole, split = taken_rows(rows, decide(rows, weights, cap))
    columns = ["row", "size", "source_size", "target", "copies"]
    out = whole.select(columns)
    if split is not None:
        more = repeated(split.withColumn("copies", F.col("copies") + 1), F.col("more"))
        out = out.unionByName(more.select(columns)).unionByName(repeated(split, F.col("n") - F.col("more")).select(columns))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    rows = keyed(docs, seed)
    # the hash of a text is cheap to compute again, a copy of all texts is not
    whole, split = taken_rows(rows, decide(cut(rows.select("src", "size", "key", "tie")), weights, cap))
    out = whole.where("copies > 0").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row")
    if split is not None:
        out = out.unionByName(repeated(split, F.col("n") * F.col("copies") + F.col("more")).select("row"))
    return out.select("row.*")


def op10_mixing(spark, sf_dir) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_mixing": op10_mixing}
#: XXH64 keys and their order are beyond SQL; the tests hold every row to a brute-force version.
ORACLE_SQL = {}
