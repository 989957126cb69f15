"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are bags of their character n-grams (3 to 6 bytes, with the spaces around a word as its ends), hashed into a
table of embeddings, so a misspelling that was never seen shares most vectors with the word that was. A text is cut
into windows of ``WINDOW`` words; the n-gram vectors of a window are averaged and go through a linear softmax; the
text's score is that of its most toxic window, so that a few words count in a text of any length. Embeddings and
softmax are learned together from labelled documents: first from windows drawn at random, then from the window of each
document that scores highest.

As all is linear after the look-up, scoring needs one number for each n-gram bucket, which tasks get as a broadcast of
``4 << BITS`` bytes. It is done on many texts at once; long texts are cut where a window of words begins, so that no
score depends on how they are cut (a piece is longer than meant only if three words are).

Defined results: a null, empty or blank text has the score of no n-grams, at most the rate of label 1; without labels of
both kinds every score is the rate of label 1 (0 without labels); repeated rows get equal scores; null ids are scored
(held out is that of the text ''); extra columns are ignored by the query and kept by the filter; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import held_out, text_slices
from .labelled import Sample, training_sample

GRAMS = (3, 4, 5, 6)
BITS = 17
DIM = 8
WINDOW = 3
HELD_OUT = 4
THRESHOLD = 0.3
#: Bounds of the training sample: documents a label, bytes a document.
PER_CLASS, MAX_BYTES = 1500, 6000
EPOCHS, WARM_UP, BATCH, RATE = 14, 3, 128, 0.15
#: A small sample is gone through more often, for so many batches of windows.
STEPS, MOST_EPOCHS = 900, 80
#: Bytes scored at once, so that arrays stay within caches.
PIECE = 1 << 17


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # logit of each n-gram bucket
    bias: float
    empty: float  # logit of a text without n-grams


def _grams(text: np.ndarray):
    """For each n: the bucket at each place, and whether an n-gram starts there (no white space within)."""
    space = (text == 32) | ((text >= 9) & (text <= 13))
    low = np.where(space, np.uint8(32), text + 32 * ((text >= 65) & (text <= 90)).astype(np.uint8)).astype(np.uint32)
    spaces = np.cumsum(space, dtype=np.int32)
    h = low.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + low[n - 1 :]
        if n in GRAMS:
            yield ((h + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BITS), spaces[n - 2 : len(space) - 1] == spaces[: len(h)]


def _window_end(text: bytes, at: int, limit: int) -> int:
    """Where to cut a text after ``at``, where a window begins: before the last window that begins within ``limit`` bytes."""
    while at + limit < len(text):
        part = np.frombuffer(text, np.uint8, limit, at)
        space = (part == 32) | ((part >= 9) & (part <= 13))
        begins = np.nonzero(np.r_[True, space[:-1]] & ~space)[0]
        last = (len(begins) - 1) // WINDOW * WINDOW
        if last > 0:
            return at + int(begins[last]) - 1  # the white space before it
        limit *= 2
    return len(text)


def _pieces(texts: list[bytes], limit: int | None = None):
    """Blocks of (text number, piece) of about ``limit`` bytes; a longer text is cut where a window begins."""
    limit = limit or PIECE
    block, size = [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = _window_end(t, at, limit)
            block.append((k, t[at:end]))
            size += end - at
            at = end
            if size >= limit:
                yield block
                block, size = [], 0
    if block:
        yield block


def _windows(block, width: int = WINDOW):
    """The bytes of a block, the place where each window of words starts, and its text's number."""
    text = np.frombuffer(b"\n" + b"\n".join(p for _, p in block) + b"\n    ", np.uint8)
    space = (text == 32) | ((text >= 9) & (text <= 13))
    begins = np.nonzero(space[:-1] & ~space[1:])[0]  # the white space before a word
    ends = np.cumsum([len(p) + 1 for _, p in block])
    piece = np.searchsorted(ends, begins, side="right")
    first = np.searchsorted(piece, np.arange(len(block)))
    starts = (np.arange(len(begins)) - first[piece]) % width == 0
    return text, begins[starts], np.array([k for k, _ in block])[piece[starts]]


def score(texts: list[bytes], model: Model) -> np.ndarray:
    """Logit of each text: that of its highest window."""
    out = np.full(len(texts), -np.inf)
    for block in _pieces(texts):
        text, starts, owner = _windows(block)
        if not len(starts):
            continue
        value, count = np.zeros(len(text), np.float32), np.zeros(len(text), np.int32)
        for bucket, valid in _grams(text):
            value[: len(bucket)] += model.table[bucket] * valid
            count[: len(bucket)] += valid
        total, n = np.add.reduceat(value, starts), np.add.reduceat(count, starts)
        some = n > 0
        np.maximum.at(out, owner[some], total[some] / n[some] + model.bias)
    return np.where(np.isneginf(out), model.empty, out)


def _features(texts: list[bytes]):
    """Flat buckets of all windows, in their order; where each begins; its text's number."""
    ids, sizes, owners = [], [], []
    for block in _pieces(texts):
        text, starts, owner = _windows(block)
        if not len(starts):
            continue
        place, bucket = map(np.concatenate, zip(*((np.nonzero(valid)[0], b[valid]) for b, valid in _grams(text))))
        inside = place >= starts[0]
        window = np.searchsorted(starts, place[inside], side="right") - 1
        ids.append(bucket[inside][np.argsort(window, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(window, minlength=len(starts)))
        owners.append(owner)
    size, owner = np.concatenate(sizes), np.concatenate(owners)
    some = size > 0
    return np.concatenate(ids), (np.cumsum(size) - size)[some], size[some], owner[some]


def train(sample: Sample, seed: int = 7) -> Model:
    """Embeddings and softmax by row-wise Adagrad; the sample's balance is undone in the bias."""
    y = np.array(sample.labels)
    if sample.rate is None or len(set(sample.labels)) < 2:
        rate = min(max(sample.rate or 0.0, 1e-9), 1 - 1e-9)
        at = float(np.log(rate / (1 - rate)))
        return Model(np.zeros(1 << BITS, np.float32), at, at)
    rng = np.random.default_rng(seed)
    ids, begin, size, owner = _features(sample.texts)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_soft, seen_bias = np.full(1 << BITS, 1e-8, np.float32), np.full((2, DIM), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    first = np.r_[True, owner[1:] != owner[:-1]]
    doc_start = np.nonzero(first)[0]
    doc_of = np.cumsum(first) - 1
    many = np.diff(np.r_[doc_start, len(owner)])
    epochs = min(MOST_EPOCHS, max(EPOCHS, STEPS * BATCH // (2 * len(doc_start))))
    for epoch in range(epochs):
        drawn = doc_start + (rng.random(len(doc_start)) * many).astype(int)
        if epoch < WARM_UP * epochs / EPOCHS:
            more = [doc_start + (rng.random(len(doc_start)) * many).astype(int) for _ in range(5)]
            chosen = np.unique(np.concatenate([drawn, *more]))
        else:
            table = embed @ (soft[1] - soft[0])
            logit = np.add.reduceat(table[ids], begin) / size
            best = np.lexsort((logit, doc_of))[np.r_[doc_start[1:], len(owner)] - 1]
            clean = drawn[y[owner[drawn]] == 0]
            chosen = np.unique(np.concatenate([best, clean]))
        rng.shuffle(chosen)
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(chosen), BATCH):
            w = chosen[at : at + BATCH]
            n = size[w]
            offset = np.cumsum(n) - n
            flat = ids[np.repeat(begin[w] - offset, n) + np.arange(n.sum())]
            mean = np.add.reduceat(embed[flat], offset) / n[:, None]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(w)), y[owner[w]]] -= 1
            p /= len(w)
            back = (p @ soft / n[:, None]).astype(np.float32)
            rows, where = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            spread = np.repeat(np.arange(len(w)), n)
            for d in range(DIM):
                grad[:, d] = np.bincount(where, back[spread, d], len(rows))
            seen[rows] += (grad * grad).mean(axis=1)
            embed[rows] -= rate * grad / np.sqrt(seen[rows])[:, None]
            g = p.T @ mean
            seen_soft += g * g
            soft -= rate * g / np.sqrt(seen_soft)
            seen_bias += p.sum(axis=0) ** 2
            bias -= rate * p.sum(axis=0) / np.sqrt(seen_bias)
    prior = np.log(sample.rate / (1 - sample.rate)) - np.log(y.mean() / (1 - y.mean()))
    shift = float(bias[1] - bias[0] + prior)
    return Model((embed @ (soft[1] - soft[0])).astype(np.float32), shift, min(shift, float(np.log(sample.rate / (1 - sample.rate)))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(training_sample(docs, labels, "toxic", HELD_OUT, PER_CLASS, MAX_BYTES))


def scorer(spark, model: Model, text: Column) -> Column:
    """The probability of label 1 for a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        z = np.concatenate([score(part, shared.value) for part in text_slices(texts)] or [np.zeros(0)])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return toxicity(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", scorer(docs.sparkSession, fit(docs, labels), F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    return docs.where(scorer(docs.sparkSession, fit(docs, labels), F.col("text")) < THRESHOLD)


def op2_toxicity(spark, sf_dir) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL = {}
