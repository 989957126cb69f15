"""Katz backoff language model of order three.

``P(w | h)`` is ``d * c(h w) / c(h)`` for a word seen after the history h in training, and ``alpha(h) * P(w | h')`` for
any other, h' being h without its first word; after an unseen history it is ``P(w | h')``. d is the Good-Turing discount
of counts up to ``K``, of each order by itself. alpha(h) shares out exactly what the seen words leave: ``(1 - sum of
their P(. | h)) / (1 - sum of their P(. | h'))``. A history whose words are all more frequent than ``K`` would leave
nothing; one is added to its count, which goes to what it hasn't seen. At the end, P(w) is ``d * c(w) / N``, and what
that leaves is shared among the words never seen by their spelling: a model of bytes given the byte before, learned from
the words seen once. So the probabilities of all words there can be never sum to more than one, and gibberish is as
unlikely as its spelling.

Tables. A vocabulary gives each training word its rank by frequency as its id, so ids are exact, and a word's count
follows from its id by a table of one row for each different count (at most the square root of 2 N rows). Documents are
encoded once, in blocks of about ``BLOCK_TOKENS`` tokens, by a join of each block's different words with the vocabulary.
Orders two and three each have a table partitioned by history into buckets of about ``BUCKET_TOKENS`` tokens: histories
with their backoff weights, words and counts, as packed arrays. Histories that alone would be half a bucket are spread
over all buckets by their following word; their totals are a broadcast, and so are the counts of n-grams as frequent,
which are scored where they stand. Both are at most ``MOST_SPREAD`` rows of some 32 bytes, by the way they are chosen.

Evaluation goes down the orders. A block sends each bucket the trigrams it has of it, once each, with the documents they
stand in; the bucket scores those it knows, and for the others adds the backoff weight and sends the pair on to the bucket
of the shorter history, which does likewise with single words. Sums by document come back a block at a time. A block
sends no more messages than it has histories, so what moves grows with the tokens, and a task holds a bucket and a
block's message at a time.

Defined results: a null or empty text is the end token alone; without training documents N and V are 0 and every word is
spelled (the end being an empty word) by equal chances; null ids are those of the text '' for holding out and keep their
rows; ids can be of any type; repeated rows each get a row; extra columns are ignored; an empty table gives an empty
result. A block is a million tokens, or one text if that has more. Over 2^32 - 2 different training words are refused.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, document_text, drop_folder, give_back, held_out, sparing

K = 5
ORDERS = (2, 3)
HELD_OUT = 7
#: The end of a text among words, none of which has white space; ids of what is not in the vocabulary, and of its start.
END = b"\n"
UNSEEN, START = np.uint32(2**32 - 1), np.uint32(2**32 - 2)
#: Tokens in a bucket of n-grams, about; tokens and documents in a block; bytes and documents split at once.
BUCKET_TOKENS, FEWEST_BUCKETS = 800_000, 12
BLOCK_TOKENS, BLOCK_DOCS, PIECE, PIECE_DOCS = 600_000, 60_000, 1 << 17, 5_000
#: Trigrams are scored in so many passes over the buckets, so that less of what is sent is on disk at once.
PASSES = 2
#: Histories and n-grams that are spread or scored where they stand, at most.
MOST_SPREAD = 1_000_000
#: Counts below this are ranked by one number; words of the vocabulary that a task of a join holds, at most about.
OFTEN, HELD_WORDS = 1 << 20, 500_000
EDGE = 256  # the byte before the first and after the last one of a word
LOW = np.uint64(2**32 - 1)
SHIFT = np.uint64(32)


# packed arrays


@lru_cache(maxsize=1)
def _squeezer():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value; bytes of equal weight stand together, as the high ones are mostly 0."""
    head = " ".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    # not .T.tobytes(), which goes value by value and takes some 17 times as long
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T) for a in arrays)
    return struct.pack("<I", len(head)) + head + _squeezer()[0].compress(planes)


def unpack(data: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<I", data)[0]
    planes, at, out = _squeezer()[1].decompress(data[4 + size :]), 0, []
    for kind in data[4 : 4 + size].decode().split():
        dtype, n = np.dtype(kind[:3]), int(kind[3:])
        values = np.empty((n, dtype.itemsize), np.uint8)
        for i, plane in enumerate(np.frombuffer(planes, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)):
            values[:, i] = plane
        out.append(values.view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batched(rows: Iterable[tuple], ddl: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some megabytes; the last column counts."""
    schema, part, size = _schema(ddl), [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1]) + 64 if isinstance(row[-1], bytes) else 64
        if size >= limit:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part, size = [], 0
            give_back()
    if part:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    give_back()
    return pa.Table.from_batches(list(_batched(rows, ddl)), schema=_schema(ddl))


def _bodies(table: pa.Table, column: str = "body") -> Iterator[list[np.ndarray]]:
    """The packed arrays of each row, of which no more than one row is unpacked at a time."""
    for value in table[column]:
        yield unpack(value.as_buffer().to_pybytes())


# the model


def discounts(of_counts: list[int], k: int = K) -> np.ndarray:
    """d[r] for counts 0..k (d[0] unused) from the number of events seen 1..k+1 times: Good-Turing as Katz scales it.

    Where the counts of counts give no discount between 0 and 1, as in small or odd samples, the count is reduced by a
    constant instead, ``n1 / (n1 + 2 n2)`` but at least a hundredth, so that every order leaves something over.
    """
    n = [0, *of_counts]
    flat = min(0.9, max(0.01, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.01))
    d = np.ones(k + 1)
    above = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        turned = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        katz = (turned - above) / (1 - above) if above < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else (r - flat) / r
    return d


def _none() -> np.ndarray:
    return np.zeros(0, np.uint64)


@dataclass
class Spread:
    """Histories of one order that are spread over all buckets, in order: totals, what counts are divided by, log10 of alpha."""

    history: np.ndarray = field(default_factory=_none)
    total: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Frequent:
    """N-grams of one order that are scored where they stand, in order of history and word: log10 of their P."""

    history: np.ndarray = field(default_factory=_none)
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Model:
    """Numbers of a trained model and where its tables are."""

    folder: str
    buckets: int = FEWEST_BUCKETS
    much: int = 0  # more tokens than this are too many for one place
    total: int = 0  # training tokens
    vocabulary: int = 0
    #: The first id of each count, and the counts, highest first.
    first_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end: int | None = None  # the id of the end of a text
    d: dict[int, np.ndarray] = field(default_factory=lambda: {n: np.ones(K + 1) for n in (1, *ORDERS)})
    below: int = 1  # what counts of words are divided by: N, one more if nothing is discounted
    unseen: float = 1.0  # the probability of all unseen words together
    spelling: np.ndarray = field(default_factory=lambda: np.full((257, 257), -np.log10(257)))
    spread: dict[int, Spread] = field(default_factory=lambda: {n: Spread() for n in ORDERS})
    frequent: dict[int, Frequent] = field(default_factory=lambda: {n: Frequent() for n in ORDERS})

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Training counts by id, 0 for unseen words."""
        if not len(self.count):
            return np.zeros(len(word), np.int64)
        at = np.searchsorted(self.first_id, word.astype(np.int64), side="right") - 1
        return np.where(word >= START, 0, self.count[at])

    def history_counts(self, word: np.ndarray) -> np.ndarray:
        """How often words are histories: as often as they are words, and the start as often as the end."""
        return self.counts(np.where(word == START, self.end, word.astype(np.int64)))

    def discounted(self, order: int, n: np.ndarray) -> np.ndarray:
        return n * np.where(n > K, 1.0, self.d[order][np.minimum(n, K)])

    def p1(self, word: np.ndarray) -> np.ndarray:
        """P(w) of words of the vocabulary."""
        return self.discounted(1, self.counts(word)) / self.below

    def bucket(self, order: int, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """By history; by both where the history is spread."""
        key = _mixed(history)
        some = _among(self.spread[order].history, history)[1]
        key[some] = _mixed(history[some] ^ _mixed(word[some].astype(np.uint64)))
        return (key % np.uint64(self.buckets)).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17)


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted one is among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _runs(key: np.ndarray) -> np.ndarray:
    """Where sorted keys begin to differ from the one before."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1]


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[begin, n])


# documents to blocks of ids

BLANK = re.compile(rb"[\x20\x09-\x0d]")


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, and all their words, A-Z lower-cased; Arrow knows exactly the six white spaces."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, begin = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a text have empty words beside them
    before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64))
    return np.diff(before[begin - begin[0]]), words.filter(some).dictionary_encode()


def stretches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[pa.DictionaryArray]]]:
    """Texts in runs of about ``PIECE`` bytes: how many, how many words each has, and their words. A longer one is a run
    by itself and is split piece by piece."""
    size, at = pc.binary_length(texts).to_numpy(), 0
    while at < len(size):
        if size[at] <= PIECE:
            long = np.nonzero(np.cumsum(size[at : at + PIECE_DOCS], dtype=np.int64) > PIECE)[0]
            n = int(long[0]) if len(long) else min(PIECE_DOCS, len(size) - at)
            lens, words = words_of(texts.slice(at, n))
            yield n, lens, [words]
        else:
            n, lens, words = 1, np.zeros(1, np.int64), []
            data, begin = texts[at].as_buffer(), 0
            while begin < len(data):
                blank = BLANK.search(data, begin + PIECE)
                end = blank.start() if blank else len(data)
                more, part = words_of(pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - begin], np.int32)), data.slice(begin, end - begin)))
                lens, begin = lens + more, end
                words.append(part)
            yield n, lens, words
        at += n


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of id, text, held in blocks: ids; how many tokens each has, held, and tokens as places in the block's own list
    of words; and those words with their counts in training documents."""
    kind, most = rows.schema["id"].dataType.simpleString(), BLOCK_TOKENS

    def emit(batches):
        task, k = TaskContext.get().partitionId(), 0
        ids, held, lens, words, n = [], [], [], [], 0

        def block():
            length, parts = np.concatenate(lens).astype(np.uint32), pa.chunked_array(words).unify_dictionaries().chunks
            number = pa.concat_arrays([parts[0].dictionary, pa.array([END], pa.binary())])
            ends = np.cumsum(length, dtype=np.int64) - 1
            flat, inside = np.full(n, len(number) - 1, np.uint32), np.ones(n, bool)
            inside[ends] = False
            flat[inside] = np.concatenate([p.indices.to_numpy() for p in parts])
            of_ids, out = pa.concat_arrays(ids), pa.concat_arrays(held).to_numpy(zero_copy_only=False)
            counts = np.bincount(flat[np.repeat(~out, length)], minlength=len(number))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([(task << 24) + k]), one(of_ids), pa.array([pack(length, out.astype(np.uint8), flat)], pa.binary()), one(number), one(pa.array(counts, pa.int64()))]
            return pa.record_batch(columns, names=["block", "ids", "body", "words", "n"])

        for batch in batches:
            at = 0
            for more, size, parts in stretches(pc.fill_null(batch.column("text"), "")):
                ids.append(batch.column("id").slice(at, more))
                held.append(batch.column("held").slice(at, more))
                lens.append(size + 1)
                words += parts
                n += int(size.sum()) + more
                at += more
                if n >= most or sum(map(len, lens)) >= BLOCK_DOCS:
                    yield block()
                    k += 1
                    ids, held, lens, words, n = [], [], [], [], 0
                    give_back()
        if lens:
            yield block()

    return rows.mapInArrow(emit, f"block long, ids array<{kind}>, body binary, words array<binary>, n array<long>")


def vocabulary(spark: SparkSession, folder: str) -> None:
    """word, c, id of every training word; ids are ranks by count, of equal ones by a hash: places in parts of the range,
    and what the parts before have. One number tells nearly all words apart, so that few are compared themselves: the
    count, highest first, and the hash; counts from ``OFTEN`` on follow it."""
    entries = spark.read.parquet(f"{folder}/blocks").select(F.explode(F.arrays_zip("words", "n")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.n").alias("n"))
    counts = entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    few = F.shiftleft(F.lit(OFTEN) - F.col("c"), 42).bitwiseOR(F.xxhash64("word").bitwiseAND(F.lit((1 << 42) - 1)))
    by = ["key", F.desc("c"), "word"]
    ranked = counts.withColumn("key", F.when(F.col("c") < OFTEN, few).otherwise(F.lit(0).cast("long"))).repartitionByRange(*by).sortWithinPartitions(*by)
    ranked.select("word", "c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")).write.parquet(f"{folder}/ranked")
    placed = spark.read.parquet(f"{folder}/ranked")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row a partition
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    before = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    placed.join(before, "part").select("word", "c", (F.col("before") + F.col("place")).alias("id")).write.parquet(f"{folder}/vocabulary")
    drop_folder(spark, f"{folder}/ranked")


def spelling(words: DataFrame) -> np.ndarray:
    """log10 P(byte | byte before) in words seen once, each pair counted once more than it was seen."""

    def count(batches):
        seen = np.zeros(257 * 257, np.int64)
        for batch in batches:
            symbols, _ = _symbols(batch.column(0).to_pylist())
            seen += np.bincount(symbols[:-1] * 257 + symbols[1:], minlength=257 * 257)
        some = np.nonzero(seen)[0]
        yield pa.record_batch([some, seen[some]], names=["pair", "n"])

    found = words.where((F.col("c") == 1) & (F.col("word") != F.lit(END))).select("word").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.ones(257 * 257)
    for r in found:
        n[r["pair"]] += r["n"]
    n = n.reshape(257, 257)
    return np.log10(n / n.sum(axis=1, keepdims=True))


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, apart by edges, in a row; and where each word's edge before it is."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int(lens.sum()) + len(words) + 1, EDGE, np.int64)
    inside = np.ones(len(out), bool)
    inside[begin] = inside[-1] = False
    out[inside] = np.frombuffer(b"".join(words), np.uint8)
    return out, begin


def spelled(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word's spelling; the end of a text is the empty word."""
    if not words:
        return np.zeros(0)
    symbols, begin = _symbols([b"" if w == END else w for w in words])
    return np.add.reduceat(table[symbols[:-1], symbols[1:]], begin)


def encode(model: Model):
    """A block with ids for its words, and each document's own sums: known tokens, the plain model's, unseen spellings."""

    def block(row: pa.Table, found: pa.Table) -> pa.Table:
        lens, held, tokens = next(_bodies(row))
        place, known = found["pos"].to_numpy(), found["unseen"].is_null().to_numpy()
        ids, own = np.full(len(place), UNSEEN, np.uint32), np.zeros(len(place))
        ids[place[known]] = found["id"].to_numpy()[known].astype(np.uint32)
        own[place[~known]] = np.log10(model.unseen) + spelled(found["unseen"].drop_null().to_pylist(), model.spelling)
        c = model.counts(ids)
        doc = np.repeat(np.arange(len(lens)), lens)
        sums = [np.bincount(doc, v[tokens], len(lens)) for v in ((c > 0).astype(float), np.log10(c + 1.0), own)]
        distinct, where = np.unique(np.append(ids, START), return_inverse=True)
        body = pack(lens, held, where[tokens].astype(np.uint32), distinct)
        return pa.table([row["block"], row["ids"], pa.array([body], pa.binary()), pa.array([pack(lens, held, *sums)], pa.binary())], names=["block", "ids", "body", "sums"])

    return block


# counts of n-grams


def _histories(tokens: np.ndarray, lens: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that."""
    first = np.cumsum(lens.astype(np.int64)) - lens
    one = np.roll(tokens, 1)
    one[first] = start
    two = np.roll(one, 1)
    two[first] = start
    return one, two


def _grams(order: int, body: list[np.ndarray], training: bool):
    """Local keys of a block's n-grams of an order, their documents, the key's bits, and its words' ids."""
    lens, held, tokens, ids = body
    doc = np.repeat(np.arange(len(lens), dtype=np.uint16), lens)
    one, two = _histories(tokens, lens, int(np.searchsorted(ids, START)))
    if training:
        some = np.repeat(held == 0, lens)
        doc, tokens, one, two = doc[some], tokens[some], one[some], two[some]
    bits = np.uint64(max(1, len(ids) - 1).bit_length())
    if order * int(bits) > 64:
        raise ValueError("a block has too many different words")
    key = (one.astype(np.uint64) << bits) | tokens.astype(np.uint64)
    if order == 3:
        key |= two.astype(np.uint64) << (bits + bits)
    return key, doc, bits, ids


def _global(key: np.ndarray, order: int, bits: np.uint64, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and word, by ids, of local keys."""
    low = (np.uint64(1) << bits) - np.uint64(1)
    word, history = ids[key & low], ids[(key >> bits) & low].astype(np.uint64)
    if order == 3:
        history |= ids[key >> (bits + bits)].astype(np.uint64) << SHIFT
    return history, word


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket, in their order."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by digits
    order = np.argsort(bucket, kind="stable")
    begin = _runs(bucket[order])
    for lo, n in zip(begin, _lengths(begin, len(order))):
        yield int(bucket[order[lo]]), order[lo : lo + n]


COUNTED = "bucket int, of_counts array<long>, body binary"


def training_messages(encoded: DataFrame, order: int, model: Model) -> DataFrame:
    """The n-grams of each block's training documents and their counts, a row a bucket."""

    def of_block(body):  # a function of its own, so that nothing of a block outlives it
        key, _, bits, ids = _grams(order, body, True)
        key.sort()
        begin = _runs(key)
        n = _lengths(begin, len(key)).astype(np.uint32)
        history, word = _global(key[begin], order, bits, ids)
        del key, begin
        for bucket, at in _dealt(model.bucket(order, history, word)):
            yield bucket, pack(history[at], word[at], n[at])

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of_block(unpack(batch.column(0)[i].as_py()))

    return encoded.select("body").mapInArrow(lambda b: _batched(rows(b), "bucket int, body binary"), "bucket int, body binary")


def merge_bucket(table: pa.Table) -> pa.Table:
    """All blocks' n-grams of one bucket, summed and in order; and how many have counts 1 to K + 1."""
    history, word, n = map(np.concatenate, zip(*_bodies(table)))
    histories, place = np.unique(history, return_inverse=True)
    key = (place.astype(np.uint64) << SHIFT) | word
    order = np.argsort(key)
    begin = _runs(key[order])
    n = np.add.reduceat(n[order].astype(np.int64), begin)
    key = key[order][begin]
    run = _lengths(_runs(key >> SHIFT), len(key)).astype(np.uint32)
    of_counts = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1 : K + 2]
    return _table([(table["bucket"][0].as_py(), of_counts.tolist(), pack(histories, run, (key & LOW).astype(np.uint32), n))], COUNTED)


WEIGHED = "bucket int, spread binary, body binary"


def _weighed(model: Model, order: int, bucket: int, body: list[np.ndarray], lower: np.ndarray) -> tuple:
    """A bucket's row with what counts are divided by and log10 of backoff weights; spread histories' part of their sums.

    lower: P of each n-gram's word after the shorter history.
    """
    history, run, word, n = body
    begin = np.cumsum(run.astype(np.int64)) - run
    total, used, under = (np.add.reduceat(x, begin) for x in (n, model.discounted(order, n), lower))
    below = (total + (used >= total)).astype(float)
    some = _among(model.spread[order].history, history)[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(some, 0.0, log_weight(used, below, under))
    return bucket, pack(history[some], used[some], under[some]), pack(history, run, word, n, below, alpha)


def log_weight(used, below, lower):
    """log10 of a backoff weight: what the seen words leave, over what they leave in the order below."""
    return np.log10(1 - used / below) - np.log10(np.maximum(1 - lower, 1e-300))


def weigh_pairs(counted: DataFrame, model: Model) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), _bodies(pa.table({"body": batch.column("body")}))):
                yield _weighed(model, 2, bucket, body, model.p1(body[2]))

    return counted.select("bucket", "body").mapInArrow(lambda b: _batched(rows(b), WEIGHED), WEIGHED)


def _shorter(body: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of a bucket with the shorter history, and which of them each n-gram has."""
    history, run, word, _ = body
    key, place = np.unique((np.repeat(history & LOW, run) << SHIFT) | word, return_inverse=True)
    return key >> SHIFT, (key & LOW).astype(np.uint32), place


ASKED, TOLD = "bucket int, asks int, body binary", "asks int, bucket int, body binary"


def ask(counted: DataFrame, model: Model) -> DataFrame:
    """The pairs of each bucket of trigrams, once each, for each bucket of pairs."""

    def rows(batches):
        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), _bodies(pa.table({"body": batch.column("body")}))):
                history, word, _ = _shorter(body)
                for b, at in _dealt(model.bucket(2, history, word)):
                    yield b, bucket, pack(history[at], word[at])

    return counted.select("bucket", "body").mapInArrow(lambda b: _batched(rows(b), ASKED), ASKED)


class Grams:
    """A bucket's table in memory: finds n-grams and histories."""

    def __init__(self, table: pa.Table, model: Model, order: int):
        self.model, self.order = model, order
        self.history, self.below, self.alpha, self.key, self.n = _none(), np.zeros(0), np.zeros(0), _none(), np.zeros(0, np.int64)
        for self.history, self.run, word, self.n, self.below, self.alpha in _bodies(table):
            self.key = (np.repeat(np.arange(len(self.history), dtype=np.uint64), self.run) << SHIFT) | word
            self.begin = np.cumsum(self.run, dtype=np.int64) - self.run
        at, some = _among(model.spread[order].history, self.history)
        self.below[some], self.alpha[some] = model.spread[order].below[at[some]], model.spread[order].alpha[at[some]]

    def find(self, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of histories and whether they are known; places of n-grams and whether they are seen."""
        at, known = _among(self.history, history)
        if not len(self.key):
            return at, known, at, known
        wanted = (at.astype(np.uint64) << SHIFT) | word
        place = self.begin[at]
        seen = known & (self.key[place] == wanted)
        # most histories have one word, which needs no search
        more = np.nonzero(known & ~seen & (self.run[at] > 1))[0]
        place[more], seen[more] = _among(self.key, wanted[more])
        return at, known, place, seen

    def signed(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of n-grams that are there, negative if one is added to their history's count."""
        at, _, place, _ = self.find(history, word)
        n = self.n[place]
        return np.where(self.below[at] > self.model.history_counts(history), -n, n)

    def values(self, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of n-grams seen, of others log10 of the backoff weight (0 after an unseen history); and which are seen."""
        at, known, place, seen = self.find(history, word)
        spread = self.model.spread[self.order]
        where, some = _among(spread.history, history)
        out = np.where(known, self.alpha[at], 0.0) if len(self.alpha) else np.zeros(len(history))
        out[some] = spread.alpha[where[some]]
        out[seen] = np.log10(self.model.discounted(self.order, self.n[place[seen]]) / self.below[at[seen]])
        return out, seen


def tell(model: Model):
    """Counts of the pairs asked for, all of which are there; negative if one is added to their history's count."""

    def bucket(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _schema(TOLD).empty_table()
        grams, own = Grams(known, model, 2), asked["bucket"][0].as_py()
        return _table([(asks, own, pack(grams.signed(*body))) for asks, body in zip(asked["asks"].to_pylist(), _bodies(asked))], TOLD)

    return bucket


def weigh_trigrams(model: Model):
    def bucket(told: pa.Table, counted: pa.Table) -> pa.Table:
        if not counted.num_rows:
            return _schema(WEIGHED).empty_table()
        body = next(_bodies(counted))
        history, word, place = _shorter(body)
        n, answers = np.zeros(len(word), np.int64), dict(zip(told["bucket"].to_pylist(), _bodies(told)))
        for b, at in _dealt(model.bucket(2, history, word)):
            n[at] = answers[b][0]
        p = model.discounted(2, np.abs(n)) / (model.history_counts(history) + (n < 0))
        return _table([_weighed(model, 3, counted["bucket"][0].as_py(), body, p[place])], WEIGHED)

    return bucket


def spread_sums(weighed: DataFrame, spread: Spread) -> Spread:
    """With what spread histories' counts are divided by, and their weights, from the sums of all buckets."""
    if not len(spread.history):
        return spread
    kinds = "history long, used double, lower double"

    def emit(batches):
        for batch in batches:
            for history, used, lower in _bodies(pa.table({"body": batch.column(0)})):
                yield pa.record_batch([history.view(np.int64), used, lower], schema=_schema(kinds))

    rows = weighed.select("spread").mapInArrow(emit, kinds).groupBy("history").agg(F.sum("used").alias("used"), F.sum("lower").alias("lower"))
    found = rows.toArrow()  # MOST_SPREAD at most
    at = np.searchsorted(spread.history, found["history"].to_numpy().view(np.uint64))
    used, lower = np.zeros(len(spread.history)), np.zeros(len(spread.history))
    used[at], lower[at] = found["used"].to_numpy(), found["lower"].to_numpy()
    below = (spread.total + (used >= spread.total)).astype(float)
    return Spread(spread.history, spread.total, below, log_weight(used, below, lower))


def frequent(weighed: DataFrame, model: Model, order: int) -> tuple[Frequent, np.ndarray]:
    """N-grams of more than ``model.much`` tokens, whose histories are spread ones; and their counts."""
    kinds = "history long, word long, n long"

    def emit(batches):
        for batch in batches:
            for history, run, word, n, *_ in _bodies(pa.table({"body": batch.column(0)})):
                some = n > model.much
                yield pa.record_batch([np.repeat(history, run)[some].view(np.int64), word[some].astype(np.int64), n[some]], schema=_schema(kinds))

    found = weighed.select("body").mapInArrow(emit, kinds).toArrow()  # MOST_SPREAD at most
    history, word, n = found["history"].to_numpy().view(np.uint64), found["word"].to_numpy().astype(np.uint32), found["n"].to_numpy()
    order_ = np.lexsort((word, history))
    history, word, n = history[order_], word[order_], n[order_]
    at, _ = _among(model.spread[order].history, history)
    value = np.log10(model.discounted(order, n) / model.spread[order].below[at]) if len(n) else np.zeros(0)
    return Frequent(history, word, value), n


def look_frequent(some: Frequent, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of n-grams that are scored where they stand, 0 for others; and which those are."""
    if not len(some.word):
        return np.zeros(len(word)), np.zeros(len(word), bool)
    begin = _runs(some.history)
    at, known = _among(some.history[begin], history)
    key = (np.repeat(np.arange(len(begin), dtype=np.uint64), _lengths(begin, len(some.word))) << SHIFT) | some.word
    place, found = _among(key, (at.astype(np.uint64) << SHIFT) | word)
    found &= known
    return np.where(found, some.value[place], 0.0), found


def train(rows: DataFrame, folder: str) -> Model:
    """Encode, count, discount and weigh; tables go to ``folder``. rows: id, text, held (rows held out are left aside)."""
    spark = rows.sparkSession
    blocks(rows).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    vocabulary(spark, folder)
    words = spark.read.parquet(f"{folder}/vocabulary")
    model = Model(folder)
    of = {r["c"]: r["n"] for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # sqrt(2 N) at most
    if of:
        model.count = np.array(sorted(of, reverse=True), np.int64)
        sizes = np.array([of[int(c)] for c in model.count], np.int64)
        model.first_id = np.cumsum(sizes) - sizes
        model.total, model.vocabulary = int((model.count * sizes).sum()), int(sizes.sum())
        if model.vocabulary > int(START):
            raise ValueError(f"{model.vocabulary} different words are more than ids of 32 bits can tell apart")
        model.buckets = max(FEWEST_BUCKETS, -(-model.total // BUCKET_TOKENS))
        model.much = max(BUCKET_TOKENS // 2, model.total // MOST_SPREAD)  # fewer than MOST_SPREAD histories have more
        model.d[1] = discounts([of.get(r, 0) for r in range(1, K + 2)])
        freed = float(sum(r * of.get(r, 0) * (1 - model.d[1][r]) for r in range(1, K + 1)))
        model.below = model.total + (not freed)
        model.unseen = (freed or 1.0) / model.below
        model.spelling = spelling(words)
        model.end = words.where(F.col("word") == F.lit(END)).first()["id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.vocabulary // HELD_WORDS))
    held = words.select("word", "id").repartition(parts, "word").hint("shuffle_hash")  # each word once, so parts are even
    asked = spark.read.parquet(f"{folder}/blocks").select("block", F.posexplode("words").alias("pos", "word")).repartition(parts, "word").join(held, "word", "left")
    asked.select("block", "pos", "id", F.when(F.col("id").isNull(), F.col("word")).alias("unseen")).write.option("compression", "zstd").parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    kept = spark.read.parquet(f"{folder}/blocks").select("block", "ids", "body")
    kind = kept.schema["ids"].dataType.simpleString()
    encoded = kept.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(encode(model), f"block long, ids {kind}, body binary, sums binary")
    encoded.write.parquet(f"{folder}/encoded")
    drop_folder(spark, f"{folder}/blocks")
    drop_folder(spark, f"{folder}/asked")
    drop_folder(spark, f"{folder}/vocabulary")
    if not model.total:
        return model
    encoded = spark.read.parquet(f"{folder}/encoded")
    texts = int(model.counts(np.array([model.end]))[0])
    often = np.arange(int(np.concatenate([model.first_id, [model.vocabulary]])[(model.count > model.much).sum()]), dtype=np.uint64)
    often = often[often != np.uint64(model.end)]
    count = model.counts(often)
    if texts > model.much:
        often, count = np.append(often, np.uint64(START)), np.append(count, texts)
    model.spread[2] = Spread(often, count, count.astype(float), np.zeros(len(often)))
    for order in ORDERS:
        at, table = f"{folder}/counts{order}", f"{folder}/grams{order}"
        training_messages(encoded, order, model).groupBy("bucket").applyInArrow(merge_bucket, COUNTED).write.parquet(at)
        counted = spark.read.parquet(at)
        of_counts = counted.select(F.posexplode("of_counts").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()
        model.d[order] = discounts([r["n"] for r in of_counts])
        if order == 2:
            weigh_pairs(counted, model).write.parquet(table)
        else:
            pairs = spark.read.parquet(f"{folder}/grams2")
            told = ask(counted, model).groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(tell(model), TOLD)
            told.groupBy("asks").cogroup(counted.groupBy("bucket")).applyInArrow(weigh_trigrams(model), WEIGHED).write.parquet(table)
        drop_folder(spark, at)
        weighed = spark.read.parquet(table)
        model.spread[order] = spread_sums(weighed, model.spread[order])
        model.frequent[order], n = frequent(weighed, model, order)
        if order == 2:
            # a frequent pair is a history that must be spread, and so is the start of so many texts
            some = model.frequent[2].word != model.end
            history, n = ((model.frequent[2].history << SHIFT) | model.frequent[2].word)[some], n[some]
            if texts > model.much:
                history, n = np.append(history, (np.uint64(START) << SHIFT) | np.uint64(START)), np.append(n, texts)
            by = np.argsort(history)
            model.spread[3] = Spread(history[by], n[by], n[by].astype(float), np.zeros(len(by)))
    return model


# scoring

SENT = "bucket int, block long, body binary"  # a negative bucket: sums of a block's documents


def _message(history, word, n, doc, of, blocks_) -> bytes:
    """N-grams, how many places each has, and for each place its document and the place of its block among ``blocks_``."""
    return pack(history, word, n.astype(np.uint32), doc, of, blocks_)


def _by_document(doc: np.ndarray, value: np.ndarray) -> bytes:
    """Sums by document, of those that have any."""
    some = np.nonzero(np.bincount(doc))[0]
    return pack(some.astype(np.uint16), np.bincount(doc, value)[some])


def scoring_messages(encoded: DataFrame, model: Model, turn: int, turns: int) -> DataFrame:
    """Trigrams of each block with the documents they stand in, a row a bucket; and sums of those very frequent. Of every
    ``turns`` buckets one is sent its part; with the first, sums."""

    def of_block(block, body):
        key, doc, bits, ids = _grams(3, body, False)
        by = np.argsort(key)
        key, doc = key[by], doc[by]
        begin = _runs(key)
        n = _lengths(begin, len(key))
        history, word = _global(key[begin], 3, bits, ids)
        del key, by
        value, here = look_frequent(model.frequent[3], history, word)
        if turn == 0 and here.any():
            at = np.repeat(here, n)
            yield -1 - block % model.buckets, block, _by_document(doc[at], np.repeat(value[here], n[here]))
        away = np.nonzero(~here)[0]
        to = model.bucket(3, history[away], word[away])
        away, to = away[to % turns == turn], to[to % turns == turn]
        for bucket, at in _dealt(to):
            at = away[at]
            of = doc[_places(begin[at], n[at])]
            yield bucket, block, _message(history[at], word[at], n[at], of, np.zeros(len(of), np.uint8), np.array([block]))

    def rows(batches):
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                yield from of_block(block, unpack(batch.column("body")[i].as_py()))

    return encoded.select("block", "body").mapInArrow(lambda b: _batched(rows(b), SENT), SENT)


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each run."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def score_bucket(model: Model, order: int):
    """Scores of the n-grams that the bucket knows; backoff weights of the others, which go on to the order below."""

    def bucket(sent: pa.Table, table: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return _schema(SENT).empty_table()
        if sent["bucket"][0].as_py() < 0:
            return sent.select(["bucket", "block", "body"]).cast(_schema(SENT))
        grams, sums, lost = Grams(table, model, order), defaultdict(list), []
        for history, word, n, doc, of, blocks_ in _bodies(sent):
            value, seen = grams.values(history, word)
            if order == 2:
                known = ~seen & (word < START)  # the spelling of the others is in their documents' own sums
                value[known] += np.log10(model.p1(word[known]))
            else:
                away = np.nonzero(~seen)[0]
                pair, found = look_frequent(model.frequent[2], history[away] & LOW, word[away])
                value[away] += pair
                away = away[~found]
                at = _places((np.cumsum(n.astype(np.int64)) - n)[away], n[away].astype(np.int64))
                lost.append((history[away] & LOW, word[away], n[away], doc[at], blocks_[of[at]]))
            value = np.repeat(value, n)
            if len(blocks_) > 1:
                by = np.argsort(of, kind="stable")
                doc, value, of = doc[by], value[by], of[by]
            begin = _runs(of)
            for at, more in zip(begin, _lengths(begin, len(of))):
                sums[int(blocks_[of[at]])].append((doc[at : at + more], value[at : at + more]))
        out = [(-1, block, _by_document(*map(np.concatenate, zip(*parts)))) for block, parts in sums.items()]
        if lost:
            history, word, n, doc, block = map(np.concatenate, zip(*lost))
            begin = np.cumsum(n.astype(np.int64)) - n
            for b, at in _dealt(model.bucket(2, history, word)):
                place = _places(begin[at], n[at].astype(np.int64))
                # places by block, so that each block's stand together
                which, of = np.unique(block[place], return_inverse=True)
                out.append((b, -1, _message(history[at], word[at], n[at], doc[place], of.astype(np.uint32), which)))
        return _table(out, SENT)

    return bucket


def sum_block(sums: pa.Table, encoded: pa.Table) -> pa.Table:
    """A block's documents with the sums of their tokens."""
    lens, held, known, base, score = next(_bodies(encoded, "sums"))
    for doc, value in _bodies(sums):
        score[doc] += value
    out = [encoded["ids"].combine_chunks().flatten(), pa.array(held.astype(bool)), pa.array(lens.astype(np.int64)), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)]
    return pa.table(out, names=["id", "held_out", "n_tokens", "n_known", "base", "score"])


def score(spark: SparkSession, model: Model) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every encoded row."""
    encoded = spark.read.parquet(f"{model.folder}/encoded")
    kind = encoded.schema["ids"].dataType.elementType.simpleString()
    parts, sent = [], None
    if model.total:
        for order in reversed(ORDERS):
            table = spark.read.parquet(f"{model.folder}/grams{order}").select("bucket", "body")
            turns = PASSES if order == 3 else 1
            for turn in range(turns):
                sent = scoring_messages(encoded, model, turn, turns) if order == 3 else sent
                mine = table.where(F.pmod("bucket", F.lit(turns)) == turn)
                sent.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(score_bucket(model, order), SENT).write.mode("append").parquet(f"{model.folder}/scored{order}")
            scored = spark.read.parquet(f"{model.folder}/scored{order}")
            parts.append(scored.where("bucket < 0").select("block", "body"))
            sent = scored.where("bucket >= 0")
    sums = parts[0] if parts else spark.createDataFrame([], "block long, body binary")
    for more in parts[1:]:
        sums = sums.unionByName(more)
    out = sums.groupBy("block").cogroup(encoded.select("block", "ids", "sums").groupBy("block"))
    out = out.applyInArrow(sum_block, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    of_all = F.log10(F.lit(float(model.total + model.vocabulary + 1)))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * of_all).alias("base_score"), "score")


def language_model(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = document_text(docs).select(F.col("doc_id").alias("id"), "text", held_out(F.col("doc_id"), HELD_OUT).alias("held"))
    folder = f"{checkpoint_dir(spark)}/katz-{uuid.uuid4().hex}"
    with sparing(spark):
        score(spark, train(rows, folder)).withColumnRenamed("id", "doc_id").write.parquet(f"{folder}/result")
    for table in ("encoded", *(f"{name}{order}" for name in ("grams", "scored") for order in ORDERS)):
        drop_folder(spark, f"{folder}/{table}")
    return spark.read.parquet(f"{folder}/result")


def op3_katz(spark, sf_dir) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Katz tables of packed arrays are beyond SQL; a brute-force model in the tests gives the same scores.
QUERIES = {"op3_katz": op3_katz}
ORACLE_SQL = {}
