"""Connected components of a table of links, by repeated hooking to the least neighbour.

Tasks that find links first reduce their own to a spanning forest (``forest``), so that a group of k copies leaves
about k rows and not k * k. The rounds over tables group with partial aggregates and join on the node; joins on a very
frequent node are split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The least index reachable for each of n nodes by links a[i]-b[i], continuing from ``labels``."""
    lab = np.arange(n) if labels is None else labels
    while len(a):
        x, y = lab[a], lab[b]
        differ = x != y
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        low, high = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
        np.minimum.at(lab, high, low)
        while True:  # to the root
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of one comparable type -> (node, component): the least node reachable, for nodes that have a link.

    Alternates large-star and small-star (every neighbour above a node, then every neighbour below it, is linked to the
    least), which ends in stars after about log n rounds.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    known = _print(edges)
    for _ in range(rounds):
        # what the joins need of each node is cut off first, so that both sides are plain exchanges, which adaptive
        # execution can split where a node has very many links
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, known = known, _print(edges)
        if known == before:
            break
    else:
        raise RuntimeError("components: not settled")
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _print(edges: DataFrame) -> tuple:
    """Number and combined hash of distinct links: equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
