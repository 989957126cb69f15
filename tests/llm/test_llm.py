"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, components, flatgraph, katz, mixing, quality_cnn, quality_rules, registry, sharding, simhash, toxicity, warc
from tidemark.llm.common import SPACE
from tidemark.llm.labelled import Sample

from ..conftest import SMALL
from ..test_queries import rows
from .helpers import SCHEMA, clashing, documents, empty, prose


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_what_its_sql_says(name, spark, duck):
    found, wanted = registry.queries()[name](spark, SMALL).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


# 1: embeddings


def planted(seed=2, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for at, size in ((10, 60), (100, 5), (120, 2)):
        x[at : at + size] = x[at] + rng.normal(scale=0.22, size=(size, d)) * (np.arange(size)[:, None] > 0)
    return x.astype(np.float32)


@pytest.mark.parametrize("cell, per_cell", [(60, flatgraph.PER_CELL), (15, 100)])  # the latter's cells are split again
def test_graph_finds_the_links_of_brute_force(spark, monkeypatch, cell, per_cell):
    monkeypatch.setattr(flatgraph, "CELL", cell)
    monkeypatch.setattr(flatgraph, "PER_CELL", per_cell)
    x = planted()
    x[300:320] = x[300]  # copies
    ids = list(range(len(x)))
    extra = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [1.0] * 15 + [None]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, x[300].tolist())]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + extra, "vec_id long, embedding array<float>").withColumn("links", F.lit(1)).withColumn("node", F.lit("x"))
    found = {r.vec_id: r for r in flatgraph.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    degree = near.sum(1) - 1
    degree[300:320] += 1  # the row without an id
    have = np.array([found[i].n_links for i in ids])
    assert (have <= degree).all() and have.sum() >= 0.97 * degree.sum()
    label = components.local_labels(len(x), *np.nonzero(near))
    assert [found[i].component_id for i in ids] == label.tolist()
    assert all(found[i].kept == (found[i].component_id == i) for i in ids)
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i in (900, 901, 902, 903, 904))
    assert found[906].component_id == 905 and found[None].component_id == 300 and not found[None].kept
    assert found[0].audited_recall > 0.9


def test_wide_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 15)
    x = planted()
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "node long, copies long, embedding array<float>")
    rows = flatgraph.split_wide(flatgraph.place(nodes, flatgraph.centres(x, 4)), nodes).collect()
    sizes = Counter(r.cell for r in rows)
    assert len(rows) == flatgraph.OVERLAP * len(x) and len(sizes) > 12 and max(sizes.values()) < 200
    for r in rows:
        assert r.cell in r.cells and len(set(r.cells)) == flatgraph.OVERLAP
    home = {r.node: r.near for r in rows if r.cell == r.cells[0]}
    assert all(r.near <= home[r.node] for r in rows)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_links_of_few_vectors_count_once(spark, n):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(n)] + [(9, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.n_links for r in flatgraph.near_duplicates(df).collect()} == {**dict.fromkeys(range(n), n - 1), 9: 0}


def test_a_low_recall_at_many_cells_is_searched_again(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 10)
    monkeypatch.setattr(flatgraph, "PER_CELL", 4)
    monkeypatch.setattr(flatgraph, "OVERLAP", 1)  # no cell shares a member with another
    x = np.random.default_rng(8).normal(size=(600, 6)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    degree = (u @ u.T >= 0.9).sum(1) - 1
    rows = flatgraph.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    have = np.array([r.n_links for r in sorted(rows, key=lambda r: r.vec_id)])
    assert (have <= degree).all() and have.sum() >= flatgraph.LEAST_RECALL * degree.sum()
    assert (have[degree > 0] / degree[degree > 0]).mean() >= flatgraph.LEAST_RECALL
    # where more overlap isn't allowed, all is compared with all
    monkeypatch.setattr(flatgraph, "MOST_OVERLAP", 1)
    monkeypatch.setattr(flatgraph, "SAMPLE_BYTES", 40_000)
    rows = flatgraph.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert [r.n_links for r in sorted(rows, key=lambda r: r.vec_id)] == degree.tolist()
    label = components.local_labels(len(x), *np.nonzero(u @ u.T >= 0.9))
    assert {r.vec_id: r.component_id for r in rows} == dict(enumerate(label.tolist()))


def test_queries_move_on_around_a_whole_circle(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 5)
    monkeypatch.setattr(flatgraph, "PER_CELL", 4)
    monkeypatch.setattr(flatgraph, "ASKED", 7)  # asks of a cell are dealt
    n = 150
    turn = np.arange(n) * 2 * np.pi / n
    rows = flatgraph.near_duplicates(spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)], "vec_id long, embedding array<float>")).collect()
    each = 2 * int(np.arccos(0.9) / (2 * np.pi / n))
    have = [r.n_links for r in rows]
    assert max(have) <= each and sum(have) >= flatgraph.LEAST_RECALL * n * each and {r.component_id for r in rows} == {0}


def test_audit_refuses_too_many_links_and_averages_queries(spark):
    rows = [([1.0, 0.001 * i], 1, 9) for i in range(10)] + [([0.0, 1.0], 2, 1), ([-1.0, 0.0], 1, 0), ([-1.0, 0.01], 1, 0)]
    schema = "embedding array<float>, copies long, n_links long"
    assert flatgraph.audit(spark.createDataFrame(rows, schema)) == pytest.approx(11 / 13)
    assert flatgraph.audit(spark.createDataFrame(rows[-2:-1], schema)) is None
    with pytest.raises(RuntimeError, match="more links"):
        flatgraph.audit(spark.createDataFrame([*rows, ([0.0, -1.0], 1, 1)], schema))


def test_graph_of_no_vectors(spark):
    assert flatgraph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_vector_is_reached_from_the_medoid():
    x = flatgraph.matrix(__import__("pyarrow").array(planted().tolist()))
    adjacent, medoid = flatgraph.build(x)
    reached, front = {medoid}, [medoid]
    while front:
        front = [int(v) for u in front for v in adjacent[u] if v >= 0 and v not in reached and not reached.add(int(v))]
    assert len(reached) == len(x)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[100 + i] == 100 for i in range(80))


# 2 and 5: classifiers

TOXIC = ["grumblex", "snarvot", "plinthor"]


def labelled(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        w = prose(i + 1, rng.randint(20, 120)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        out.append((" ".join(w).encode(), int(toxic)))
    return out


def test_toxic_words_and_their_misspellings_are_found():
    data = labelled()
    model = toxicity.train(Sample([t for t, _ in data[:180]], [y for _, y in data[:180]], 1 / 3))
    p = 1 / (1 + np.exp(-toxicity.score([t for t, _ in data[180:]], model)))
    assert ((p >= toxicity.THRESHOLD) == np.array([y == 1 for _, y in data[180:]])).mean() > 0.9
    calm, rude = toxicity.score([prose(999, 2000).encode(), (prose(998, 1000) + " grumbblex " + prose(997, 1000)).encode()], model)
    assert rude > calm


def naive_toxicity(text, model):
    """One n-gram after the other of each window of three words, by the plain rule."""
    best, w = None, [b" " + x + b" " for x in text.split()]
    for k in range(0, len(w), toxicity.WINDOW):
        values = []
        for x in w[k : k + toxicity.WINDOW]:
            x = x.lower()
            for n in toxicity.GRAMS:
                for i in range(len(x) - n + 1):
                    h = x[i]
                    for c in x[i + 1 : i + n]:
                        h = (h * 0x01000193 + c) % 2**32
                    values.append(model.table[(h + n) * 2654435769 % 2**32 >> 32 - toxicity.BITS])
        if values:
            z = np.sum(values, dtype=np.float64) / len(values) + model.bias
            best = z if best is None else max(best, z)
    return model.empty if best is None else best


def test_toxicity_is_that_of_the_naive_scorer_whatever_the_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.5, -2.0)
    texts = [b"", b"  \n", b"x", b"ab cd", b"x" * 3000, b"One two\tTHREE\n\nfour  five", *(t for t, _ in labelled(12)), prose(5, 800).encode(), b" " * 700 + b"a word" + b" " * 700 + b"z" * 900 + b" end of it"]
    wanted = [naive_toxicity(t, model) for t in texts]
    for piece in (64, 512, 1 << 17):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(toxicity.score(texts, model), wanted, atol=1e-4), piece


def junk(i):
    return " ".join(w + "%%%" for w in prose(i + 1, 60).split())


def test_junk_is_told_from_prose():
    texts = [(junk(i) if i % 2 else prose(i + 1, 60)).encode() for i in range(160)]
    net = quality_cnn.train(Sample(texts[:120], [1 - i % 2 for i in range(120)], 0.8))
    p = 1 / (1 + np.exp(-quality_cnn.score(texts[120:], net)))
    assert ((p >= quality_cnn.THRESHOLD) == np.array([i % 2 == 0 for i in range(120, 160)])).mean() > 0.95


def test_network_gradients_are_those_of_differences():
    texts = [prose(i, 20 + 9 * i).encode() for i in range(6)]
    y, rng = np.array([1, 0, 1, 0, 1, 1], np.float32), np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in {
        "embed": rng.normal(0, 0.5, (256, quality_cnn.EMBED)), "filters": rng.normal(0, 0.3, (quality_cnn.TAPS, quality_cnn.STRIDE * quality_cnn.EMBED, quality_cnn.FILTERS)), "bias": rng.normal(0, 0.1, quality_cnn.FILTERS),
        "w1": rng.normal(0, 0.1, (2 * quality_cnn.FILTERS + 1, quality_cnn.HIDDEN)), "b1": np.zeros(quality_cnn.HIDDEN), "w2": rng.normal(0, 0.3, quality_cnn.HIDDEN), "b2": np.zeros(()),
    }.items()}

    def loss():
        z = quality_cnn.score(texts, {**net, "shift": 0.0})
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = quality_cnn._gradients(texts, y, net)
    for key, at in (("w2", (3,)), ("w1", (5, 2)), ("bias", (4,)), ("filters", (1, 3, 7)), ("embed", (ord("a"), 2))):
        keep, e = net[key][at], 1e-4
        net[key][at] = keep + e
        up = loss()
        net[key][at] = keep - e
        down = loss()
        net[key][at] = keep
        assert g[key][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_network_reads_a_long_text_in_pieces_as_a_whole(monkeypatch):
    texts = [prose(i, 300).encode() for i in range(4)]
    net = quality_cnn.train(Sample([*texts, *[junk(i).encode() for i in range(4)]], [1] * 4 + [0] * 4, 0.5))
    whole = quality_cnn.score(texts, net)
    monkeypatch.setattr(quality_cnn, "PIECE", 512)
    assert np.allclose(whole, quality_cnn.score(texts, net), atol=1e-5)


def test_network_is_the_naive_one(monkeypatch):
    rng = np.random.default_rng(3)
    q = quality_cnn
    net = {
        "embed": rng.normal(0, 0.5, (256, q.EMBED)), "filters": rng.normal(0, 0.3, (q.TAPS, q.STRIDE * q.EMBED, q.FILTERS)), "bias": rng.normal(0, 0.1, q.FILTERS),
        "w1": rng.normal(0, 0.1, (2 * q.FILTERS + 1, q.HIDDEN)), "b1": rng.normal(size=q.HIDDEN), "w2": rng.normal(0, 0.3, q.HIDDEN), "b2": np.array(0.3), "shift": 0.1,
    }

    def naive(text):
        halves = max(1, -(-len(text) // q.HALF))
        data = text + b"\0" * (halves * q.HALF + q.CONTEXT - len(text))
        pooled = []
        for k in range(halves):
            places = []
            for at in range(k * q.HALF, (k + 1) * q.HALF, q.STRIDE):
                places.append(sum(net["embed"][data[at + t * q.STRIDE + j]] @ net["filters"][t][j * q.EMBED : (j + 1) * q.EMBED] for t in range(q.TAPS) for j in range(q.STRIDE)))
            pooled.append(np.maximum(np.max(places, axis=0) + net["bias"], 0))
        chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:])] or pooled
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [np.log1p(len(text)) / 10]])
        return float(np.tanh(x @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"] + net["shift"])

    texts = [b"", b"a", prose(1, 9).encode(), prose(2, 60).encode(), "Übung 日本".encode(), prose(3, 150).encode()]
    for piece in (512, 1 << 16):
        monkeypatch.setattr(q, "PIECE", piece)
        assert np.allclose(q.score(texts, net), [naive(t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_classifiers_on_awkward_rows(module, spark):
    docs = clashing(documents(spark))
    labels = spark.createDataFrame([(i, i % 4 != 0, int(i % 3 == 0)) for i in range(40)] + [(None, True, 1), (3, None, None)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")
    found = module.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in found)
    assert module.classify(docs, labels.limit(0)).count() == docs.count()
    assert module.classify(empty(spark), labels).count() == 0
    keep = module.keep_clean if module is toxicity else module.keep_good
    assert keep(docs, labels.limit(0)).columns == docs.columns and keep(docs, labels.limit(0)).count() == docs.count()


# 3: language model


def brute_katz(docs):
    """The model as its module describes it, by dictionaries; probabilities of a word by order and history."""
    split = lambda t: (t or "").encode().lower().split()
    tokens = [(i, [*split(text), None], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, text in docs]
    grams = {n: Counter() for n in (1, 2, 3)}
    for _, w, held in tokens:
        if not held:
            padded = [START, START, *w]
            for n in grams:
                grams[n].update(tuple(padded[i + 3 - n : i + 3]) for i in range(len(w)))
    total, v = sum(grams[1].values()), len(grams[1])
    d = {n: katz.discounts([sum(c == r for c in grams[n].values()) for r in range(1, katz.K + 2)]) for n in grams}
    less = lambda n, c: c * (d[n][c] if c <= katz.K else 1.0)
    freed = sum(c - less(1, c) for c in grams[1].values())
    below = total + (not freed)
    seen = {n: defaultdict(dict) for n in (2, 3)}
    for n in seen:
        for g, c in grams[n].items():
            seen[n][g[:-1]][g[-1]] = c
    pairs = np.ones((257, 257))
    for (w,), c in grams[1].items():
        if c == 1 and w is not None:
            for x, y in zip([256, *w], [*w, 256]):
                pairs[x, y] += 1
    pairs /= pairs.sum(axis=1, keepdims=True)

    def p(n, history, w):
        if n == 1:
            if grams[1][w,]:
                return less(1, grams[1][w,]) / below
            return ((freed or 1) / below if total else 1.0) * math.prod(pairs[x, y] for x, y in zip([256, *(w or b"")], [*(w or b""), 256]))
        f = seen[n].get(history)
        if f is None:
            return p(n - 1, history[1:], w)
        if (n, history) not in kept:
            used = sum(less(n, c) for c in f.values())
            under = sum(f.values()) + (used >= sum(f.values()))
            kept[n, history] = under, (1 - used / under) / (1 - sum(p(n - 1, history[1:], x) for x in f))
        under, alpha = kept[n, history]
        return less(n, f[w]) / under if w in f else alpha * p(n - 1, history[1:], w)

    kept, out = {}, []
    for i, w, held in tokens:
        padded = [START, START, *w]
        score = sum(math.log10(p(3, tuple(padded[k : k + 2]), x)) for k, x in enumerate(w))
        base = sum(math.log10((grams[1][x,] + 1) / (total + v + 1)) for x in w)
        out.append((i, held, len(w), sum(grams[1][x,] > 0 for x in w), total, base, score))
    for n in seen:
        for h in list(seen[n])[:15]:
            # known words, and whatever is spelled otherwise
            assert sum(p(n, h, w) for w, in grams[1]) + kept[n, h][1] * (1 if n == 2 else kept[2, h[1:]][1]) * (freed or 1) / below == pytest.approx(1)
    return out


START = ("start",)


def katz_rows(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r[:5])) + (round(r[6], 4),))


@pytest.mark.parametrize("bucket, block", [(2_000_000, 1_000_000), (300, 2000)])
def test_katz_is_the_brute_force_model(bucket, block, spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    # n-grams that alone would fill a bucket, frequent words in new company, unseen words, and many starts
    often = [(3000 + i, "of the " * 900 + f"new{i} the end{i} of of new{i % 3} the", "en", "s0", 1) for i in range(12)]
    short = [(4000 + i, "same start", "en", "s0", 1) for i in range(300)]
    docs = clashing(documents(spark).unionByName(spark.createDataFrame([*often, *short], SCHEMA)))
    found = katz_rows(tuple(r) for r in katz.language_model(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    wanted = katz_rows(brute_katz([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    for a, b in zip(found, wanted, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_katz_takes_ids_of_any_type_and_leaves_no_setting(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    docs = spark.createDataFrame([("a", "some words"), ("b", None), (None, "some words more"), ("b", "x" * 2_000_000)], "doc_id string, text string")
    found = {(r.doc_id, r.n_tokens) for r in katz.language_model(docs).collect()}
    assert found == {("a", 3), ("b", 1), (None, 4), ("b", 2)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_gibberish_is_less_likely_than_prose(spark):
    rng = random.Random(4)
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12))) for _ in range(200))
    new = next(i for i in range(9_000_000, 9_000_100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(new, gibberish)], "doc_id long, text string"))
    held = {r.doc_id: r.score / r.n_tokens for r in katz.language_model(docs).where("held_out and n_tokens > 20").collect()}
    assert held.pop(new) < np.percentile(list(held.values()), 1)


def test_katz_ranks_words_by_one_number_and_more(spark, monkeypatch):
    monkeypatch.setattr(katz, "OFTEN", 4)  # counts from four on are ranked as the very frequent are
    monkeypatch.setattr(katz, "HELD_WORDS", 10)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 40)))) for i in range(60)]
    found = katz_rows(tuple(r) for r in katz.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for a, b in zip(found, katz_rows(brute_katz(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_katz_splits_texts_as_bytes_do():
    every = "".join(map(chr, range(1, 0x250)))
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(["A b  c ", "", " \t ", "é " + "Word " * 60_000 + every, "x" * 300_000, "\x0bz\x1cz\x85z", every, *["q w"] * 6000], kind)
        found = []
        for n, lens, parts in katz.stretches(texts):
            tokens = [w for p in parts for w in p.to_pylist()]
            assert n == len(lens) <= katz.PIECE_DOCS and lens.sum() == len(tokens)
            ends = np.cumsum(lens)
            found += [tokens[e - k : e] for e, k in zip(ends, lens)]
        assert found == [t.encode().lower().split() for t in texts.to_pylist()]


def test_katz_packs_without_going_value_by_value():
    x = np.sort(np.random.default_rng(3).integers(0, 1 << 52, 300_000).astype(np.uint64))
    arrays = [x, x.astype(np.uint16), x / 3, x[:0]]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()

    def seconds(f):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    # packing once did this and compressed what came of it
    assert seconds(lambda: katz.pack(x)) < 0.7 * seconds(lambda: x.view(np.uint8).reshape(-1, 8).T.tobytes())


def test_katz_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.language_model(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(-12 * math.log10(257))
    assert katz.language_model(empty(spark)).count() == 0


# 4: sharding


def test_shards_keep_every_row_through_compaction(spark, tmp_path):
    docs = documents(spark)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=1 << 20, smallest=1 << 10)
    for k in range(5):
        store.append(docs.repartition(2))
    before = store.latest()
    assert store.read().count() == 5 * docs.count()
    after = store.compact()
    assert after == before + 1 and len(store.entries()) < len(store.entries(before))
    assert store.read().exceptAll(docs.unionAll(docs).unionAll(docs).unionAll(docs).unionAll(docs)).count() == 0
    assert store.read(1).count() == docs.count()
    store.vacuum()
    assert store.read().count() == 5 * docs.count()
    assert sum(e["rows"] for e in store.entries()) == 5 * docs.count()


def test_tiers_are_merged_upon_tiers(spark, tmp_path):
    docs = clashing(spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("text")))
    store, log = sharding.ShardStore(spark, str(tmp_path / "s"), target=400_000, smallest=4_000), []

    def settle():
        before = store.entries()
        for run in store.plan(before):
            assert len(run) >= store.fan_in and len({e["tier"] for e in run}) == 1 and all(e["bytes"] < store.target / 2 for e in run)
        store.settle()
        after = store.entries()
        log.append((before, after))
        assert not store.plan(after) and store.versions() == [store.latest()]
        counts = Counter(e["tier"] for e in after if e["bytes"] < store.target / 2)
        assert all(n < store.fan_in for n in counts.values())
        assert all(e["tier"] == sharding.tier(e["bytes"], 4_000) for e in after)

    store.append_waves(docs.repartition(3), F.pmod("doc_id", F.lit(8)), settle)
    assert len(log) == 8 and store.read().exceptAll(docs).count() == 0 and store.read().count() == 4000
    assert [sum(e["rows"] for e in after) for _, after in log] == [sum(1 for i in range(4000) if i % 8 <= k) for k in range(8)]
    # files of a merge have been merged again
    made = {e["file"]: e["added"] for _, after in log for e in after}
    gone = [set(e["file"] for e in a) - set(e["file"] for e in b) for (_, a), (_, b) in zip(log, log[1:])]
    assert any(f in made for g in gone for f in g)
    real = {e["file"]: e["rows"] for e in store.entries()}
    seen = store.read().groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    assert {r.f: r["count"] for r in seen} == real


def test_of_two_writers_one_must_look_again(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(documents(spark))
    with pytest.raises(sharding.Conflict):
        store.commit([], documents(spark).schema.json(), 0)
    store.append_waves(empty(spark), F.lit(0))
    assert store.read().count() == documents(spark).count()


def test_sharding_query_has_every_document_whole(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    found = sharding.op4_sharding(spark, SMALL)
    assert found.select("doc_id", "text_sha256").exceptAll(docs).count() == 0 and found.count() == docs.count()


# 6: BPE


@pytest.fixture(scope="module")
def codec():
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(vocabulary)}
    return bpe.Codec(vocabulary, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "It's 12345 o'clock", "日本語 テスト 🎉🎉", "▁ ▁x <unk> <s>", "a" * 3000, "\x00\x01\x7f\u0080ÿ", "don't\tstop  now \n", "áé́ ﬁ №"])
def test_tokens_are_those_of_the_reference_encoder(codec, text):
    own, known = codec
    assert own.encode(text) == known.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_long_texts_are_encoded_in_parts_and_little_is_remembered(codec, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 800)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 2000)
    text = prose(3, 900) + " " + "ab" * 3000 + "\n\n  日本語 " + prose(4, 900)
    assert codec[0].encode(text) == codec[1].encode_ordinary(text)
    assert codec[0].chars < 12_000


def test_digests_of_all_documents(spark, codec):
    docs = clashing(documents(spark))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = codec[1].encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest(docs).collect()) == want
    model = bpe.production_model(spark)
    back = docs.where("doc_id = 1004").select(bpe.decode(bpe.encode(F.col("text"), model), model).cast("string").alias("t"), "text").first()
    assert back.t == back.text
    assert bpe.digest(empty(spark)).count() == 0


# 7: WARC


def test_archives_give_back_every_page(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "http://a/\r\nx", big, 1), (1, None, big, 2), (2, "u", "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (6, "u", "", 6), (None, "u", big, 7), (7, "u", "é" * 60, 8), (1, "v", big, 9)], "page_id long, url string, html string, record_type int")
    folder = f"file://{tmp_path}/w"
    warc.write(pages, folder, warc.sample_dictionary(pages))
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, folder).collect()}
    digest = lambda t: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest())
    assert found == {
        ("3", "revisit", "1", *digest(big)), ("1", "response", None, *digest(big)), ("2", "response", None, *digest("short")), ("4", "response", None, *digest("short")), ("5", "response", None, *digest("")),
        ("6", "response", None, *digest("")), (None, "revisit", "1", *digest(big)), ("7", "response", None, *digest("é" * 60)),
    }
    payload = warc.read(spark, folder, with_payload=True).where("page_id = '7'").first().payload
    assert bytes(payload).decode() == "é" * 60


def test_archives_begin_with_their_dictionary_and_leavings_are_not_read(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    folder = f"file://{tmp_path}/w"
    words_ = warc.sample_dictionary(pages)
    warc.write(pages, folder, words_)
    archives = list((tmp_path / "w/archives").glob("*.warc.zst"))
    assert all(a.read_bytes().startswith(warc.opening(words_)) for a in archives) and words_
    (tmp_path / "w/archives/part-0-lost.warc.zst").write_bytes(archives[0].read_bytes())
    assert warc.read(spark, folder).count() == pages.count()


def test_ids_and_pages_of_any_text_come_back(spark, tmp_path):
    long = "é" * 1_500_000
    pages = spark.createDataFrame([("", "u", "a"), ("a\r\nWARC-Type: x>", "u\n", "b"), (None, None, None), ("ü %41", "u", long), ("z", "u", long)], "page_id string, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write(clashing(pages), folder, warc.sample_dictionary(pages))
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder).collect()}
    assert found == {("", "response", None, 1), ("a\r\nWARC-Type: x>", "response", None, 1), (None, "response", None, 0), ("z", "response", None, 3_000_000), ("ü %41", "revisit", "z", 3_000_000)}


def test_archives_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"file://{tmp_path}/w", warc.sample_dictionary(none))
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


# 8: quality rules


def test_rules_on_awkward_rows(spark):
    docs = clashing(documents(spark))
    out = quality_rules.judge(docs)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    texts = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in texts:
        w = words(r.text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeat = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want[r.doc_id, len(w), sum(map(len, w)), sum((r.text or "").count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)] += 1
    assert Counter(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == want
    assert quality_rules.judge(empty(spark)).count() == 0


def test_rules_name_what_a_text_fails(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}#" for i in range(60))), (2, prose(1, 80) + " the of and")], "doc_id long, text string")
    failed = {r.doc_id: set(r.failed) for r in quality_rules.judge(df).collect()}
    assert {"symbols", "stop_words"} <= failed[1] and "symbols" not in failed[2]


# 9: SimHash


def brute_fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_are_those_of_brute_force(spark):
    docs = clashing(documents(spark))
    texts = docs.select("doc_id", "text").collect()
    near = [(2000 + i, prose(3, 1500) + f" extra{i}") for i in range(30)]
    extra = spark.createDataFrame(near, "doc_id long, text string")
    every = [(r.doc_id, r.text) for r in texts] + near
    fp = [brute_fingerprint(t) for _, t in every]
    i, j = np.nonzero(np.bitwise_count(np.array(fp, np.uint64)[:, None] ^ np.array(fp, np.uint64)[None, :]) <= 3)
    label = components.local_labels(len(fp), i, j)
    first = {}
    for (doc, _), k in zip(every, label):
        if doc is not None:
            first[k] = min(first.get(k, doc), doc)
    want = Counter((doc, f, first.get(k)) for (doc, _), f, k in zip(every, fp, label))
    found = simhash.cluster(docs.unionByName(extra, allowMissingColumns=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found.collect()) == want
    assert simhash.cluster(empty(spark)).count() == 0


def test_no_near_pair_is_missed_at_any_distance(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", (8, 16))
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(120)]
    pairs = [(b, b ^ sum(1 << k for k in rng.sample(range(64), d))) for b in base for d in (1, 2, 3)]
    fps = sorted({x for p in pairs for x in p} | {0, 2**64 - 1})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    found = {r.node % 2**64: r.component for r in components.components(simhash.links(df)).collect()}
    assert all(found[a] == found[b] for a, b in pairs)


@pytest.mark.parametrize("size", [7, 10, 12, 14, 24])
def test_no_near_pair_is_missed_with_any_code(size):
    rng = random.Random(size)
    base = [rng.getrandbits(64) for _ in range(40)]
    pairs = [(b, b ^ sum(1 << k for k in rng.sample(range(64), d))) for b in base for d in (0, 1, 2, 3, 3, 3)]
    fps = np.array(sorted({x for p in pairs for x in p}), np.uint64)
    row, anchor, home = simhash.reached(fps, size)
    assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
    at, homes = defaultdict(set), {}
    for r, k, h in zip(row.tolist(), anchor.tolist(), home.tolist()):
        at[int(fps[r])].add(k)
        if h:
            homes[int(fps[r])] = k
    assert all(homes[a] in at[b] or homes[b] in at[a] for a, b in pairs)


def test_anchors_cover_and_are_different():
    far = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for k in (7, 10):
        code = simhash.whole_code(k)
        assert len(set(code.tolist())) == 2**k
        assert np.bitwise_count(far[:, None] ^ code[None, :]).min(axis=1).max() <= simhash.COVERING_RADIUS
    for k in (6, 11, 16):
        code = simhash.half_code(k)
        assert len(set(code.tolist())) == 2**k and int(code.max()) < 2**32
        assert np.bitwise_count((far[:200, None] >> np.uint64(32)) ^ code[None, :]).min(axis=1).max() <= 12


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000])
def test_rows_and_comparisons_of_random_fingerprints_grow_in_proportion(n):
    """Counted for a sample of fingerprints against what n of them would be, as each anchor is alike."""
    size = simhash.dimension(n)
    fps = np.random.default_rng(n).integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    row, _, _ = simhash.reached(fps, size)
    copies, homes = len(row) / len(fps), n / 2**size
    assert copies < 60 and homes <= simhash.HOMES
    assert copies * homes < 12_000  # comparisons of a fingerprint


def test_one_document_of_a_group_stays(spark):
    docs = documents(spark)
    kept = simhash.dedup(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 1005 not in ids and 1000 in ids and 1001 not in ids and None not in ids


def test_rows_of_one_id_and_rows_without_ids_follow_the_same_rule(spark):
    rows = [(1, prose(1, 90)), (1, prose(2, 90)), (2, prose(3, 90)), (9, prose(3, 90)), (9, prose(4, 90)), (None, prose(5, 90)), (None, prose(5, 90)), (None, prose(1, 90)), *[(7, prose(6, 90))] * 200]
    kept = Counter((r.doc_id, r.text) for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter([(1, prose(1, 90)), (1, prose(2, 90)), (2, prose(3, 90)), (9, prose(4, 90)), (None, prose(5, 90)), (7, prose(6, 90))])


# 10: mixing


def test_targets_are_those_of_repeated_resharing(spark):
    rng = random.Random(9)
    sizes = {f"s{i:02d}": rng.choice([0, 5, 100, 3000, 90_000]) for i in range(14)}
    found = {r.src: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
    names = sorted(sizes)
    w, cap, total = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    free, target = set(names), {}
    while True:
        left = total - sum(cap[s] for s in names if s not in free)
        target = {s: w[s] * left / sum(w[x] for x in free) if s in free else cap[s] for s in names}
        over = {s for s in free if target[s] > cap[s]}
        if not over:
            break
        free -= over
    assert found == pytest.approx(target)


def brute_mix(rows, targets):
    """Copies of each row (src, size, key, tie): whole epochs, then one row after the other by key."""
    out, by = {}, defaultdict(list)
    for r in rows:
        by[r.src].append((r.key, r.tie, r.size, r.row))
    for src, group in by.items():
        total = sum(g[2] for g in group)
        epochs = int(targets[src] // total) if total else 0
        rest, at = targets[src] - epochs * total, 0
        out[src] = Counter()
        for key, tie, size, row in sorted(group, key=lambda g: g[:3]):
            out[src][key, tie] += epochs + (at + size / 2 <= rest)
            at += size
    return out


@pytest.mark.parametrize("edge", [100_000, 3])
def test_mix_takes_what_the_plain_rule_takes(spark, monkeypatch, edge):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    rng = random.Random(2)
    rows = [(i, prose(i % 150, rng.randint(1, 80)), "en", rng.choice(["a", "b", "c", "d", None]), 1) for i in range(600)]
    rows += [(5000, prose(1, 50), "en", "copies", 1)] * 200 + [(6000 + i, "#$%* " * 40, "en", "symbols", 1) for i in range(300)] + [(7000, None, "en", "none", 0)] * 3
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    keyed = mixing.keyed(docs).collect()
    sizes = Counter()
    for r in keyed:
        sizes[r.src] += r["size"]
    targets = {r.src: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
    want = brute_mix(keyed, targets)
    text = {(r.key, r.tie): (r.row["doc_id"], r.row["text"]) for r in keyed}
    taken = Counter()
    for src, copies in want.items():
        for k, n in copies.items():
            taken[text[k]] += n
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("__mix_size <> 'x'").count() == 0
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +taken
    a, b = mixing.digest(docs).collect(), mixing.digest(docs.repartition(7)).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b)) and len(a) == len(rows)
    by_id = Counter()
    for r in a:
        by_id[r.doc_id] += r.copies
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    want_by_id = Counter()
    for (i, _), n in taken.items():
        want_by_id[i] += n
    assert +by_id == +want_by_id
    # equal rows are taken by number, so that their source meets its target
    got = sum(r.taken for r in a if r.doc_id == 5000)
    assert abs(got - targets["=copies"]) <= 25
    assert mixing.digest(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_rows_repeated_very_often_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATED", 7)
    rows = spark.createDataFrame([("a", 100), ("b", 0), ("c", 6), ("d", 14)], "x string, k long")
    assert {r.x: r["count"] for r in mixing.repeated(rows, F.col("k")).groupBy("x").count().collect()} == {"a": 100, "c": 6, "d": 14}


# the pipeline


def test_pipeline_keeps_columns_and_encodes_what_it_kept(spark, codec):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    d, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SMALL)
        assert d.columns == docs.columns, name
        d = d.checkpoint()
        seen.append(d.count())
    assert seen[2] <= seen[1] <= seen[0] <= docs.count()
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert len(out) == seen[3]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == codec[1].encode_ordinary(text[r.doc_id]) for r in out[:20])


def test_pipeline_keeps_what_each_stage_by_itself_says(spark, codec):
    """Each stage by hand over what the one before kept: scores, groups and copies by brute force."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    frame = lambda ids: docs.where(F.col("doc_id").isin(list(ids)))
    ids = sorted(text)
    model = toxicity.fit(docs, labels)
    ids = [i for i in ids if 1 / (1 + math.exp(-naive_toxicity(text[i].encode(), model))) < 0.3]
    net = quality_cnn.fit(frame(ids), labels)
    ids = [i for i, z in zip(ids, quality_cnn.score([text[i].encode() for i in ids], net)) if 1 / (1 + math.exp(-z)) >= 0.7]
    fp = np.array([brute_fingerprint(text[i]) for i in ids], np.uint64)
    label = components.local_labels(len(ids), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3))
    ids = [i for k, i in enumerate(ids) if label[k] == k]
    keyed = mixing.keyed(frame(ids)).collect()
    sizes = Counter()
    for r in keyed:
        sizes[r.src] += len(words(text[r.row["doc_id"]]))
    targets = {r.src: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
    copies = {k: n for c in brute_mix(keyed, targets).values() for k, n in c.items()}
    want = Counter({r.row["doc_id"]: copies[r.key, r.tie] for r in keyed})
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in out) == +want
    assert all(r.ids == codec[1].encode_ordinary(text[r.doc_id]) for r in out)


def test_very_long_texts_go_through_every_operator(spark):
    rows = [(0, prose(1, 150_000)), (1, "x" * 1_000_000), (2, "a b " * 500_000), (3, prose(2, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).count() == quality_cnn.classify(docs, labels).count() == 4
    assert {r.doc_id: r.fp % 2**64 for r in simhash.cluster(docs).collect()} == {i: brute_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r["size"] for r in mixing.digest(docs).collect()} == {i: len(words(t)) for i, t in rows}
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs).collect()} == {i: len(words(t)) for i, t in rows}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.digest(docs).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in katz.language_model(docs).collect()} == {i: len(words(t)) + 1 for i, t in rows}


def test_operators_leave_no_setting_behind(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    docs = documents(spark, 9)
    katz.language_model(docs).count()
    bpe.digest(docs).count()
    simhash.cluster(docs).count()
    assert before == {k: spark.conf.get(k) for k in before}


def test_pipeline_on_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.count() > 0, name
    none = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SMALL).checkpoint()
        assert none.count() == 0, name
