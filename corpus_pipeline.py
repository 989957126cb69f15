"""The corpus pipeline: documents in, token ids of a clean, deduplicated and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the next
stage's documents. All but the last return the columns of documents. A stage learns from the labelled rows among its
own documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality_cnn, simhash, toxicity
from tidemark.llm.common import checkpoint_dir


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.3 or more go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score under 0.7 go."""
    return quality_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of linked SimHash fingerprints: the one of the smallest id."""
    return simhash.dedup(docs)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, or up to three times."""
    return mixing.mix(docs)


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, and the digests of the ids and of the bytes they decode to."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Two trained classifiers, XXH64 fingerprints and BPE are beyond SQL; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs


QUERIES = {"pipeline": run}
