"""The queries of the training-data operators and of the pipeline, with SQL where SQL can express them."""

import corpus_pipeline

from . import bpe, flatgraph, katz, mixing, quality_cnn, quality_rules, sharding, simhash, toxicity, warc

MODULES = (flatgraph, toxicity, katz, quality_cnn, bpe, sharding, warc, quality_rules, simhash, mixing)


def queries() -> dict:
    return {k: f for m in (*MODULES, corpus_pipeline) for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
