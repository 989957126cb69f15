"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded, filters of ``3 * STRIDE`` bytes slide over the whole text by ``STRIDE``, and their highest values
are pooled over chunks of ``2 * HALF`` bytes that overlap by half. A text of any length has as many chunks as it needs;
the mean and the maximum of its chunks, with its length, go through one hidden layer into one probability. Embedding,
filters and layers are learned together by Adam from a bounded sample of labelled documents.

Defined results: a null or empty text is one chunk of padding, scored like any other; without labels of both kinds
every score is the rate of label 1 (1 without labels); repeated rows get equal scores; null ids are scored (held out is
that of the text ''); extra columns are ignored by the query and kept by the filter; an empty table gives an empty
result. Bytes of texts longer than ``PIECE`` are read piece by piece, with the overlap that the filters need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import held_out, text_slices
from .labelled import Sample, training_sample

EMBED, FILTERS, HIDDEN = 8, 32, 16
STRIDE, TAPS, HALF = 2, 3, 128
HELD_OUT = 4
THRESHOLD = 0.7
#: Bounds of the training sample: documents a label, bytes a document.
PER_CLASS, MAX_BYTES = 1300, 12_000
#: Below so many bytes, shorter documents are drawn more often.
FAVOUR = 800
EPOCHS, BATCH, RATE = 12, 48, 0.004
#: A small sample is gone through more often, for so many steps.
STEPS, MOST_EPOCHS = 400, 80
PIECE = 1 << 16
CONTEXT = STRIDE * (TAPS - 1)


def _blocks(texts: list[bytes], limit: int):
    """(text numbers, halves of each, bytes): whole halves, so padded that no filter sees two pieces.

    The pieces of a long text are whole halves too; the bytes that filters at its end look ahead to follow it.
    """
    who, halves, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while at == 0 or at < len(t):
            part = t[at : at + limit]
            n = max(1, -(-len(part) // HALF))
            ahead = t[at + limit : at + limit + CONTEXT]
            who.append(k)
            halves.append(n)
            parts.append(part.ljust(n * HALF, b"\0") + ahead.ljust(CONTEXT, b"\0"))
            size += len(parts[-1])
            at += limit
            if size >= limit:
                yield who, halves, parts
                who, halves, parts, size = [], [], [], 0
    if who:
        yield who, halves, parts


def _convolve(parts: list[bytes], halves: list[int], net: dict):
    """Values of filters at every place of a block, (halves, places, filters), and the embedded bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    rows = net["embed"][data].reshape(-1, STRIDE * EMBED)
    z = rows[: len(rows) - TAPS + 1] @ net["filters"][0]
    for k in range(1, TAPS):
        z += rows[k : len(rows) - TAPS + 1 + k] @ net["filters"][k]
    # the places of each part, without those over its look-ahead
    per, skip = HALF // STRIDE, CONTEXT // STRIDE
    n = np.array(halves) * per
    if len(n) == 1:
        where = None
        z = z[: n[0]]
    else:
        begin = np.cumsum(n + skip) - (n + skip)
        where = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        z = z[where]
    return z.reshape(-1, per, FILTERS), rows, data, where


def _chunks(pooled: np.ndarray, first: np.ndarray):
    """Each half with the next of its text, if there is one: chunks that overlap by half. Also which of both is higher."""
    last = np.r_[first[1:], len(pooled)] - 1
    following = np.minimum(np.arange(len(pooled)) + 1, len(pooled) - 1)
    following[last] = last
    use_next = pooled[following] > pooled
    # the last half is a chunk of its own only where it is the only one
    single = np.ones(len(pooled), bool)
    single[last[last > first]] = False
    return np.where(use_next, pooled[following], pooled), use_next, following, single


def _features(halves: np.ndarray, first: np.ndarray, sizes: np.ndarray, net: dict):
    """Mean and maximum over chunks and the length of each text, from the pooled halves."""
    chunk, use_next, following, single = _chunks(np.maximum(halves + net["bias"], 0), first)
    weight = single.astype(np.float32)[:, None]
    n = np.add.reduceat(weight, first)
    mean = np.add.reduceat(chunk * weight, first) / n
    top = np.maximum.reduceat(chunk, first)
    x = np.concatenate([mean, top, np.log1p(sizes)[:, None] / 10], axis=1).astype(np.float32)
    return x, (chunk, use_next, following, weight, n, top)


def _head(x: np.ndarray, net: dict):
    hidden = np.tanh(x @ net["w1"] + net["b1"])
    return hidden @ net["w2"] + net["b2"], hidden


def score(texts: list[bytes], net: dict) -> np.ndarray:
    """Logit of each text."""
    if "rate" in net:
        return np.full(len(texts), net["rate"])
    pools, owners = [], []
    for who, halves, parts in _blocks(texts, PIECE):
        pools.append(_convolve(parts, halves, net)[0].max(axis=1))
        owners.append(np.repeat(who, halves))
    if not pools:
        return np.zeros(0)
    owner = np.concatenate(owners)
    first = np.searchsorted(owner, np.arange(len(texts)))
    x, _ = _features(np.concatenate(pools), first, np.array(list(map(len, texts))), net)
    return _head(x, net)[0] + net["shift"]


def _gradients(texts: list[bytes], y: np.ndarray, net: dict) -> dict:
    """Gradients of the mean cross-entropy of a batch of short texts."""
    halves, parts = [], []
    for _, h, p in _blocks(texts, 1 << 40):
        halves, parts = halves + h, parts + p
    z, rows, data, where = _convolve(parts, halves, net)
    place = z.argmax(axis=1)
    pooled = np.take_along_axis(z, place[:, None], axis=1)[:, 0]
    first = np.cumsum(halves) - halves
    x, (chunk, use_next, following, weight, n, top) = _features(pooled, first, np.array(list(map(len, texts))), net)
    logit, hidden = _head(x, net)
    d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    g = {"w2": hidden.T @ d, "b2": np.array(d.sum())}
    dh = np.outer(d, net["w2"]) * (1 - hidden**2)
    g |= {"w1": x.T @ dh, "b1": dh.sum(axis=0)}
    dx = dh @ net["w1"].T
    text = np.repeat(np.arange(len(texts)), halves)
    is_top = chunk == top[text]
    ties = np.add.reduceat(is_top.astype(np.float32), first)
    dchunk = (dx[:, :FILTERS] / n)[text] * weight + is_top * (dx[:, FILTERS : 2 * FILTERS] / ties)[text]
    dhalf = np.where(use_next, 0, dchunk)
    np.add.at(dhalf, following, np.where(use_next, dchunk, 0))
    dhalf *= pooled + net["bias"] > 0
    g["bias"] = dhalf.sum(axis=0)
    per = HALF // STRIDE
    at = place + np.arange(len(place))[:, None] * per
    at = at if where is None else where[at]
    g["filters"], g["embed"] = np.zeros_like(net["filters"]), np.zeros_like(net["embed"])
    seen = data.reshape(-1, STRIDE)
    for k in range(TAPS):
        g["filters"][k] = np.einsum("hf,hfk->kf", dhalf, rows[at + k])
        back = dhalf[:, :, None] * net["filters"][k].T[None]
        for j in range(STRIDE):
            ids = seen[at + k, j].ravel()
            for e in range(EMBED):
                g["embed"][:, e] += np.bincount(ids, back[:, :, j * EMBED + e].ravel(), 256)
    return g


def train(sample: Sample, seed: int = 5) -> dict:
    """A network learned by Adam; the sample's balance is undone in the score."""
    if sample.rate is None or len(set(sample.labels)) < 2:
        rate = min(max(1.0 if sample.rate is None else sample.rate, 1e-9), 1 - 1e-9)
        return {"rate": float(np.log(rate / (1 - rate)))}
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = {
        "embed": normal(0.5, 256, EMBED), "filters": normal(0.3, TAPS, STRIDE * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "w1": normal(0.15, 2 * FILTERS + 1, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(0.3, HIDDEN), "b2": np.zeros((), np.float32),
    }
    y, texts = np.array(sample.labels, np.float32), sample.texts
    m, v, step = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    epochs = min(MOST_EPOCHS, max(EPOCHS, STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            part, step = order[at : at + BATCH], step + 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * epoch / epochs)
            for k, g in _gradients([texts[i] for i in part], y[part], net).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net["shift"] = float(np.log(sample.rate / (1 - sample.rate)) - np.log(y.mean() / (1 - y.mean())))
    return net


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return train(training_sample(docs, labels, "quality", HELD_OUT, PER_CLASS, MAX_BYTES, FAVOUR))


def scorer(spark, net: dict, text: Column) -> Column:
    """The probability of label 1 for a text."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf(DoubleType())
    def quality(texts: pa.Array) -> pa.Array:
        z = np.concatenate([score(part, shared.value) for part in text_slices(texts)] or [np.zeros(0)]).astype(np.float64)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return quality(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", scorer(docs.sparkSession, fit(docs, labels), F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they were."""
    return docs.where(scorer(docs.sparkSession, fit(docs, labels), F.col("text")) >= THRESHOLD)


def op5_quality(spark, sf_dir) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL = {}
