"""A bounded sample of labelled documents for training, chosen alike at every size of the input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


@dataclass(frozen=True)
class Sample:
    texts: list[bytes]
    labels: list[int]
    #: Part of label 1 in all labelled rows that may be learned from; None without any.
    rate: float | None


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, per_class: int, max_bytes: int, favour: int = 0) -> Sample:
    """Up to ``per_class`` documents of each label, of the least keys by hashes of their ids, of 1 to ``max_bytes`` bytes.

    Documents shorter than ``favour`` bytes are drawn up to eight times as often, in proportion, as they are rare and
    say little each.

    The ids are chosen first, on rows without texts; then only the chosen texts come to the driver, at most
    ``2 * per_class * max_bytes`` bytes. Rows held out, without an id or without a label of 0 or 1 are never among
    them. A document labelled twice counts as 1 if any of its labels is; of several documents of one id the least text
    is taken.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), modulus))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).where(F.col("size") > 0)
    rows = known.join(sizes, "doc_id")
    total, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return Sample([], [], None)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") + 0.5) / F.lit(float(2**53))
    often = F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.lit(favour) / F.col("size")))
    fit = rows.where(F.col("size") <= max_bytes).groupBy("label", "doc_id").agg(F.min(-F.log(u) / often).alias("h"))
    chosen = [r for y in (0, 1) for r in fit.where(F.col("label") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    if not chosen:
        return Sample([], [], ones / total)
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], f"__id {docs.schema['doc_id'].dataType.simpleString()}, label int")
    found = (
        docs.select("doc_id", "text")
        .where((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # 2 * per_class rows
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
        .collect()
    )
    found.sort(key=lambda r: r["doc_id"])
    return Sample([r["text"].encode() for r in found], [r["label"] for r in found], ones / total)
