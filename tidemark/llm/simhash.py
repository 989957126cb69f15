"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a linear code of length 64, chosen by the number of fingerprints from a nested family, so
that an anchor is the nearest one of about ``HOMES`` of them at most, however many there are. Up to dimension 10 it is a
subcode of the extended Kasami code: the affine functions on the field of 64 elements and their sums with the bent
functions Tr(a x^9). Beyond, it is two independent codes of length 32, one for each half of a fingerprint, each of
dimension 6 to 16: the affine functions on the field of 32 elements, then sums with Tr(a x^3), then with Tr(a x^5), which
together are the second-order Reed-Muller code. Each code contains the affine functions, so no word is farther than 28
from an anchor (12 in each half). Nearest codewords of a half are found in a table of its codewords alone.

A fingerprint is replicated to every anchor within its own distance to the code plus the threshold (at most the
covering radius plus the threshold). Of two fingerprints within the threshold, take the one nearer to the code: its
nearest anchor is within reach of the other. So each linked pair meets at the home anchor of one of both, and nothing
is missed, whatever the code. Fingerprints are distinct here: copies have collapsed. Anchors with many fingerprints are
cut into cells of bounded size, each compared by one task; a cell returns a spanning forest of its links, not its pairs.

Defined results: null and empty texts have fingerprint zero and link like others; fewer than three words are one
shingle; repeated rows share fingerprint and component; a null doc_id is never the smallest id of its component and
still gets its component; extra columns are ignored; an empty table gives an empty result. ``dedup`` keeps one row of each
component: of the smallest id (null ids last), of several of that id the one whose text has the least hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, document_text, free_name, text_slices
from .components import components, local_labels

SHINGLE = 3
THRESHOLD = 3
SEED = 42
COVERING_RADIUS = 28
#: Homes of an anchor that the code is chosen for; fingerprints in a cell: homes by all.
HOMES = 256
FEW_ANCHORS = 100_000  # a row an anchor is a broadcast up to this many
CELL = (2048, 8192)


def shingles(text: bytes, width: int = SHINGLE) -> list[bytes]:
    """Shingles of the words of a UTF-8 text, A-Z lower-cased; bytes.split knows exactly the six white spaces."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: bytes) -> int:
    """64 bits; each is 1 if it is set in over half of the shingles' XXH64."""
    grams = shingles(text)
    if not grams:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for part in text_slices(texts) for t in part], np.uint64).view(np.int64))


def _field(bits: int, modulus: int):
    """Multiplication in the field of 2^bits elements, and the trace to two elements."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a, b = a << 1, b >> 1
            a ^= modulus * (a >> bits)
        return out

    def power(a: int, n: int) -> int:
        out = 1
        for _ in range(n):
            out = times(out, a)
        return out

    return times, power


def _sum(items) -> int:
    out = 0
    for x in items:
        out ^= x
    return out


def _codewords(rows: list[list[int]], dimension: int) -> np.ndarray:
    """All sums of the first rows, as unsigned integers."""
    out = np.zeros(1, np.uint64)
    for r in rows[:dimension]:
        out = np.r_[out, out ^ np.uint64(sum(bit << i for i, bit in enumerate(r)))]
    return out


def _affine(bits: int) -> list[list[int]]:
    return [[1] * 2**bits] + [[x >> i & 1 for x in range(2**bits)] for i in range(bits)]


@lru_cache(maxsize=4)
def whole_code(dimension: int) -> np.ndarray:
    """Codewords of 64 bits: affine functions, then Tr(a x^9) from the field of 8 elements; dimension 7 to 10."""
    times, power = _field(6, 0b1000011)  # x^6 = x + 1
    eight = [a for a in range(64) if power(a, 8) == a]  # the subfield
    basis = [eight[2], eight[3]]
    basis.append(next(a for a in eight[2:] if a not in (*basis, basis[0] ^ basis[1])))
    # the trace from the subfield is a + a^2 + a^4
    bent = [[_sum(power(times(a, power(x, 9)), 2**i) for i in range(3)) & 1 for x in range(64)] for a in basis]
    return _codewords(_affine(6) + bent, dimension)


@lru_cache(maxsize=4)
def half_code(dimension: int) -> np.ndarray:
    """Codewords of 32 bits: affine functions, then Tr(a x^3), then Tr(a x^5); dimension 6 to 16."""
    times, power = _field(5, 0b100101)  # x^5 = x^2 + 1
    quadratic = [[_sum(power(times(1 << k, power(x, n)), 2**i) for i in range(5)) & 1 for x in range(32)] for n in (3, 5) for k in range(5)]
    return _codewords(_affine(5) + quadratic, dimension)


def dimension(fingerprints: int, homes: int | None = None) -> int:
    """Of the code for so many fingerprints: 2 to its power is the number of anchors."""
    wanted = max(1, fingerprints // (homes or HOMES)).bit_length()
    return min(32, max(7, wanted) if wanted <= 10 else wanted + wanted % 2)


def _near(part: np.ndarray, code: np.ndarray):
    """(row, codeword, how much farther than the nearest) of all within the threshold of that; the first nearest of each row."""
    rows, cols, more, first = [], [], [], []
    step = max(1, (1 << 22) // len(code))
    for at in range(0, len(part), step):
        far = np.bitwise_count(part[at : at + step, None] ^ code[None, :])
        own = far.min(axis=1)
        row, col = np.nonzero(far <= (own + THRESHOLD)[:, None])
        rows.append(row + at)
        cols.append(col)
        more.append(far[row, col] - own[row])
        first.append(far.argmin(axis=1))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(more), np.concatenate(first)


def reached(part: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is it the home) of every anchor in reach of fingerprints, for a code of dimension ``size``."""
    if size <= 10:
        row, col, _, first = _near(part, whole_code(size))
        return row, col.astype(np.int64), first[row] == col
    code = half_code(size // 2)
    (r1, c1, m1, f1), (r2, c2, m2, f2) = (_near(x, code) for x in (part & np.uint64(2**32 - 1), part >> np.uint64(32)))
    # every codeword of one half with every one of the other, as far as both together are in reach
    n2 = np.bincount(r2, minlength=len(part))
    begin = np.cumsum(n2) - n2
    left = np.repeat(np.arange(len(r1)), n2[r1])
    right = np.repeat(begin[r1] - (np.cumsum(n2[r1]) - n2[r1]), n2[r1]) + np.arange(len(left))
    some = m1[left] + m2[right] <= THRESHOLD
    left, right = left[some], right[some]
    row, anchor = r1[left], (c1[left].astype(np.int64) << 32) | c2[right]
    return row, anchor, anchor == ((f1.astype(np.int64) << 32) | f2)[row]


def replicate(size: int):
    """fp -> (anchor, fp, home): every anchor in reach; home at the nearest (the first of several)."""

    def rows(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1024):
                part = fps[at : at + 1024]
                row, anchor, home = reached(part, size)
                yield pa.record_batch([pa.array(anchor), pa.array(part[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return rows


def compare_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Links in a cell, as a spanning forest of (a, b)."""
    mine = rows["side"].to_numpy() == 0
    fp = rows["fp"].to_numpy().view(np.uint64)
    homes, others = np.unique(fp[mine]), np.unique(fp[~mine])
    nodes = np.union1d(homes, others)
    labels = np.arange(len(nodes))
    left, right = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    for at in range(0, len(homes), 128):
        i, j = np.nonzero(np.bitwise_count(homes[at : at + 128, None] ^ others[None, :]) <= THRESHOLD)
        labels = local_labels(len(nodes), left[at + i], right[j], labels)
    moved = np.nonzero(labels != np.arange(len(nodes)))[0]
    return pd.DataFrame({"a": nodes[moved].view(np.int64), "b": nodes[labels[moved]].view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """(a, b) that connect all linked fingerprints of a table of distinct ones."""
    placed = cut(fps.select("fp").mapInArrow(replicate(dimension(fps.count())), "anchor long, fp long, home boolean"))
    sizes = placed.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("total")).where("homes > 0")
    cells = cut(sizes.select("anchor", F.ceil(F.col("homes") / CELL[0]).cast("int").alias("across"), F.ceil(F.col("total") / CELL[1]).cast("int").alias("down")))
    dealt = placed.join(F.broadcast(cells) if cells.count() <= FEW_ANCHORS else cells, "anchor")
    hashed = F.pmod(F.xxhash64("fp"), F.lit(1 << 20))
    homes = dealt.where("home").select(
        "anchor", F.pmod(hashed, F.col("across")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), "fp", F.lit(0).alias("side")
    )
    others = dealt.select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), F.pmod(hashed, F.col("down")).cast("int").alias("j"), "fp", F.lit(1).alias("side")
    )
    return homes.unionByName(others).groupBy("anchor", "i", "j").applyInPandas(compare_cell, "a long, b long")


def components_of(rows: DataFrame) -> DataFrame:
    """fp, component (a fingerprint) of every fingerprint in ``rows``."""
    fps = cut(rows.select("fp").distinct())
    joined = components(links(fps)).select(F.col("node").alias("fp"), "component")
    return fps.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = cut(document_text(docs).select("doc_id", fingerprints("text").alias("fp")))
    of = cut(components_of(rows))
    # ids by fingerprint first, so that joins have a row for each of these
    first_ids = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    of = cut(of.join(first_ids, "fp"))
    first = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(first, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which one stays for each component, all columns as they were.

    It is the row of the smallest doc_id, null last, then of the least hash of its text; of rows equal in both, one of
    the least hash of all columns.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = cut(docs.select("doc_id", text_hash.alias("h"), fingerprints(F.coalesce("text", F.lit(""))).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = cut(rows.groupBy("fp").agg(F.min(order).alias("first")).join(components_of(rows), "fp"))
    stay = firsts.groupBy("component").agg(F.min("first").alias("s")).select("s.doc_id", "s.h")
    # of how many rows one stays: repeated ids and texts
    many = cut(rows.select("doc_id", "h").join(stay.select(F.col("doc_id").alias("i"), F.col("h").alias("g")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left_semi").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")))
    name_i, name_h, name_n = (free_name(docs, x) for x in ("stay_id", "stay_hash", "stay_n"))
    wanted = many.select(F.col("doc_id").alias(name_i), F.col("h").alias(name_h), F.col("n").alias(name_n))
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted[name_i]) & (text_hash == wanted[name_h]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if many.where("n > 1").isEmpty():
        return found.select(*columns)
    values = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns, docs.dtypes)]
    one = found.where(F.col(name_n) > 1).groupBy(name_i, name_h).agg(F.min_by(F.struct(*columns), F.xxhash64(*values)).alias(name_n)).select(f"{name_n}.*")
    return found.where(F.col(name_n) == 1).select(*columns).unionByName(one)


def op9_simhash(spark, sf_dir) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL = {}
