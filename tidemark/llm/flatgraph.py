"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors that are equal collapse first, so copies cost nothing later. Centres of cells come from a bounded sample, split
in halves again and again, so that a dense region gets many cells and none takes in a hot group as a whole. Every
vector belongs to its ``OVERLAP`` nearest cells, the first being its home. A cell builds its part of the graph: nearest
members and some drawn at random, robust-pruned, with reverse edges and every member reachable from the medoid. The
adjacency lists of a vector's cells are united into one. Cells that have more members than ``WIDEST`` times what is
meant, as all have where vectors are more than one sample can tell apart, are split again, each by a bounded sample of its
own members, level after level; a vector then belongs to the nearest of all parts that its cells came to.

The search is on that united graph, a cell at a time: from the medoid greedily to the query, then expanding over
whatever is within ``SLACK`` of the threshold. Cells meet in their shared members: a query that finds a vector whose
home it has not searched goes on there from that vector, round after round, until no query moves. A found vector counts
in its home cell alone, so none counts twice. Every link is verified in double precision. Tasks return counts and a
spanning forest of their links, not pairs.

``audit`` holds the counts against brute force for a bounded set of queries. Below ``LEAST_RECALL`` everything is searched
again on cells that overlap twice as much; where ``MOST_OVERLAP`` isn't enough either, links are found by comparing a block
of vectors after the other with all (``exact_links``), which takes as long as that takes and misses nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; equal vectors link; a null vec_id is never a component's
smallest id, and is not kept unless its component has no other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, local_labels

THRESHOLD = 0.9
OVERLAP = 3
CELL = 1000  # homes of a cell, about
WIDEST, FAN, LEVELS = 8, 64, 8  # when a cell is split, into how many parts at most, and how often
DEALT = 20_000  # members of a wide cell that a task deals to its parts
FEW_CELLS = 100_000  # wide cells are a broadcast up to this many
SAMPLE, SAMPLE_BYTES, PER_CELL = 200_000, 64 << 20, 16
DEGREE, NEAREST, DRAWN, ALPHA = 24, 40, 16, 1.2
MOST = 3 * DEGREE  # edges of a vector within a cell, reverse ones included
BEAM, STEPS, ENTRIES, SLACK = 32, 80, 4, 0.1
SEEDS = 16  # vectors from which a query goes on in another cell
ASKED = 20_000  # queries that a task searches a cell for
AUDITED = 2000  # of all vectors, and of those that have links
LEAST_RECALL, MOST_OVERLAP = 0.95, 48
CLOSE = 1e-9  # products so close to the threshold are links or not, as rounding has it
QUERIES_AT_ONCE = 128


def valid(embedding: Column) -> Column:
    """True for vectors that can have a direction."""
    numbers = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & numbers & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Unit vectors in double precision, from a column of lists of equal length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centres of ``cells`` parts: the largest part is halved along its two-means direction until there are enough."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < cells:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        x = sample[part]
        a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
        for _ in range(6):
            near_a = x @ (a - b) > np.median(x @ (a - b))
            if near_a.all() or not near_a.any():
                break
            a, b = x[near_a].mean(axis=0), x[~near_a].mean(axis=0)
        along = np.argsort(x @ (a - b), kind="stable")
        parts += [part[along[: len(x) // 2]], part[along[len(x) // 2 :]]]
    middle = np.array([sample[p].mean(axis=0) for p in parts if len(p)])
    norm = np.linalg.norm(middle, axis=1, keepdims=True)
    return (middle / np.where(norm > 0, norm, 1)).astype(np.float32)


def prune(x: np.ndarray, candidates: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Robust pruning for many vectors at once: (n, DEGREE) of candidates, -1 where there are fewer.

    The nearest candidate left is taken and those go that are ALPHA times nearer to it than to the vector.
    """
    y = x[candidates]
    far = np.maximum(2 - 2 * np.einsum("nd,ncd->nc", x[here], y), 0)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    y = np.take_along_axis(y, order[:, :, None], 1)
    between = np.maximum(2 - 2 * y @ y.transpose(0, 2, 1), 0)
    twice = np.zeros(candidates.shape, bool)
    twice[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    alive = ~twice & (candidates != here[:, None])
    out = np.full((len(here), DEGREE), -1)
    rows = np.arange(len(here))
    for k in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        best = alive.argmax(axis=1)
        out[some, k] = candidates[rows[some], best[some]]
        alive &= ALPHA**2 * between[rows, best] > far
        alive[rows, best] = False
    return out


def build(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, int]:
    """Adjacency (n, MOST), -1 where there is no edge, and the medoid, from which every vector can be reached."""
    n, rng = len(x), np.random.default_rng(seed)
    x = x.astype(np.float32)
    medoid = int((x @ x.mean(axis=0)).argmax())
    near = min(NEAREST, n - 1)
    adjacent = np.full((n, MOST), -1)
    if n == 1:
        return adjacent, medoid
    for at in range(0, n, 256):
        here = np.arange(at, min(n, at + 256))
        close = x[here] @ x.T
        close[np.arange(len(here)), here] = -9
        nearest = np.argpartition(-close, near - 1, axis=1)[:, :near]
        drawn = rng.integers(0, n, (len(here), DRAWN))
        adjacent[here, :DEGREE] = prune(x, np.concatenate([nearest, drawn], axis=1), here)
    # reverse edges, the nearest first where there are many
    a, k = np.nonzero(adjacent[:, :DEGREE] >= 0)
    b = adjacent[a, k]
    order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), b))
    a, b = a[order], b[order]
    first = np.r_[0, np.nonzero(np.diff(b))[0] + 1]
    rank = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
    fits = rank < MOST - DEGREE - 2
    adjacent[b[fits], DEGREE + rank[fits]] = a[fits]
    # what the medoid does not reach hangs on its nearest vector that is reached
    reached = np.zeros(n, bool)
    front = np.array([medoid])
    while True:
        while len(front):
            reached[front] = True
            following = adjacent[front]
            following = np.unique(following[following >= 0])
            front = following[~reached[following]]
        lost = np.nonzero(~reached)[0]
        if not len(lost):
            return adjacent, medoid
        known = np.nonzero(reached)[0]
        one = lost[0]
        order = known[np.argsort(-(x[known] @ x[one]))]
        free = next((v for v in order if adjacent[v, -1] < 0 or adjacent[v, -2] < 0), order[0])
        adjacent[free, -1 if adjacent[free, -1] < 0 else -2] = one
        front = np.array([one])


def search(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) of cosine ``threshold`` or more in double precision, for blocks of queries.

    Greedy with a beam from each query's starts, until the beam is expanded or the query itself is found; then
    over every vector within SLACK of the threshold and its neighbours. starts: (queries, k), -1 for none.
    """
    small, n = x.astype(np.float32), len(x)
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        q64 = queries[at : at + QUERIES_AT_ONCE]
        q, rows = q64.astype(np.float32), np.arange(len(q64))
        seen = np.zeros((len(q), n), bool)
        ids = np.sort(starts[at : at + QUERIES_AT_ONCE], axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # a start counts once
        near = np.where(ids >= 0, np.einsum("qd,qkd->qk", q, small[ids]), -9).astype(np.float32)
        r, k = np.nonzero(ids >= 0)
        seen[r, ids[r, k]] = True
        done = ids < 0
        everything_q, everything_v, everything_s = [r], [ids[r, k]], [near[r, k]]
        for _ in range(STEPS):
            open_ = np.where(done, -9, near)
            best = open_.argmax(axis=1)
            go = (open_[rows, best] > -9) & (near.max(axis=1) < 1 - 1e-6)
            if not go.any():
                break
            act = rows[go]
            done[act, best[go]] = True
            nb = adjacent[ids[act, best[go]]]
            new = (nb >= 0) & ~seen[act[:, None], nb]
            s = np.where(new, np.einsum("qd,qkd->qk", q[act], small[nb]), -9).astype(np.float32)
            r, k = np.nonzero(new)
            seen[act[r], nb[r, k]] = True
            everything_q.append(act[r])
            everything_v.append(nb[r, k])
            everything_s.append(s[r, k])
            all_ids, all_s = np.full((len(q), ids.shape[1] + nb.shape[1]), -1), np.full((len(q), ids.shape[1] + nb.shape[1]), -9, np.float32)
            all_done = np.ones(all_ids.shape, bool)
            all_ids[:, : ids.shape[1]], all_s[:, : ids.shape[1]], all_done[:, : ids.shape[1]] = ids, near, done
            all_ids[act, ids.shape[1] :], all_s[act, ids.shape[1] :], all_done[act, ids.shape[1] :] = nb, s, ~new
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
            ids, near, done = (np.take_along_axis(y, top, 1) for y in (all_ids, all_s, all_done))
        fq, fv, fs = map(np.concatenate, (everything_q, everything_v, everything_s))
        found_q, found_v = [fq[fs >= threshold - 1e-4]], [fv[fs >= threshold - 1e-4]]
        wide = fs >= threshold - SLACK
        front = list(zip(np.array_split(fq[wide], 1 + wide.sum() // 8192), np.array_split(fv[wide], 1 + wide.sum() // 8192)))
        while front:
            cq, cv = front.pop()
            nb = adjacent[cv]
            r, k = np.nonzero((nb >= 0) & ~seen[cq[:, None], nb])
            pair = np.unique(cq[r] * n + nb[r, k])
            pq, pv = pair // n, pair % n
            seen[pq, pv] = True
            s = np.einsum("nd,nd->n", q[pq], small[pv])
            hit, wide = s >= threshold - 1e-4, s >= threshold - SLACK
            found_q.append(pq[hit])
            found_v.append(pv[hit])
            if wide.any():
                front += zip(np.array_split(pq[wide], 1 + wide.sum() // 8192), np.array_split(pv[wide], 1 + wide.sum() // 8192))
        fq, fv = np.concatenate(found_q), np.concatenate(found_v)
        exact = np.concatenate([np.einsum("nd,nd->n", q64[fq[i : i + 65536]], x[fv[i : i + 65536]]) for i in range(0, len(fq), 65536)] or [np.zeros(0)])
        yield at + fq[exact >= threshold], fv[exact >= threshold]


def place(nodes: DataFrame, middle: np.ndarray, overlap: int = OVERLAP) -> DataFrame:
    """A row for each node and each of its cells, how near its centre is; cells: all of them, the home first."""
    shared = nodes.sparkSession.sparkContext.broadcast(middle)
    kind = nodes.schema["embedding"].dataType.simpleString()

    def cells(batches):
        c = shared.value
        for batch in batches:
            x = matrix(batch.column("embedding"))
            close = x.astype(np.float32) @ c.T
            near = np.argsort(-close, axis=1, kind="stable")[:, :overlap]
            n, k = near.shape
            close = np.take_along_axis(close, near, 1)
            take = pa.array(np.repeat(np.arange(n), k))
            yield pa.record_batch(
                [batch.column("node").take(take), pa.array(near.ravel()), pa.array(close.ravel()), pa.array(np.repeat(near, k, axis=0).tolist(), pa.list_(pa.int64())), batch.column("copies").take(take), batch.column("embedding").take(take)],
                names=["node", "cell", "near", "cells", "copies", "embedding"],
            )

    return nodes.select("node", "copies", "embedding").mapInArrow(cells, f"node long, cell long, near float, cells array<long>, copies long, embedding {kind}")


def part_centres(key: tuple, drawn: pa.Table) -> pa.Table:
    """Centres of the parts of one wide cell, from those of its members that were drawn."""
    drawn = drawn.sort_by("node")
    middle = centres(matrix(drawn["embedding"]).astype(np.float32), drawn["parts"][0].as_py())
    n = len(middle)
    return pa.table([[key[0].as_py()] * n, pa.array(range(n), pa.int32()), pa.array(middle.tolist(), pa.list_(pa.float32()))], names=["cell", "part", "centre"])


def nearest_parts(overlap: int):
    """node, cell, near: the ``overlap`` nearest parts of a wide cell for some of its members."""

    def nearest(members: pa.Table, middles: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("cell", pa.int64()), ("near", pa.float32())])
        if not members.num_rows:
            return schema.empty_table()
        cell = members["cell"][0].as_py()
        if not middles.num_rows:
            return pa.table([members["node"], [cell * FAN] * len(members), members["near"]], schema=schema)
        middles = middles.sort_by("part")
        close = matrix(members["embedding"]).astype(np.float32) @ np.array(middles["centre"].to_pylist(), np.float32).T
        best = np.argsort(-close, axis=1, kind="stable")[:, :overlap]
        return pa.table([np.repeat(members["node"].to_numpy(), best.shape[1]), cell * FAN + best.ravel(), np.take_along_axis(close, best, 1).ravel()], schema=schema)

    return nearest


def split_wide(placed: DataFrame, nodes: DataFrame, overlap: int = OVERLAP) -> DataFrame | None:
    """``placed`` anew with every wide cell split; None if there is none. Cell c becomes FAN * c and what follows."""
    sizes = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, overlap / OVERLAP) * WIDEST * CELL))
    n_wide = sizes.count()
    if not n_wide:
        return None
    parts = F.least(F.lit(FAN), F.ceil(F.col("n") / (overlap * CELL))).cast("int")
    wide = sizes.select("cell", "n", parts.alias("parts"), F.ceil(F.col("n") / DEALT).cast("int").alias("deals"))
    marked = placed.join(F.broadcast(wide) if n_wide <= FEW_CELLS else wide, "cell", "left")
    mine = marked.where("parts is not null")
    drawn = mine.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.col("parts") * PER_CELL / F.col("n") * (1 << 20)).select("cell", "node", "parts", "embedding")
    middles = cut(drawn.groupBy("cell").applyInArrow(part_centres, "cell long, part int, centre array<float>"))
    every = middles.join(wide, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "part", "centre")
    dealt = mine.select("cell", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("deals")).cast("int").alias("deal"), "node", "near", "embedding")
    split = dealt.groupBy("cell", "deal").cogroup(every.groupBy("cell", "deal")).applyInArrow(nearest_parts(overlap), "node long, cell long, near float")
    as_it_was = marked.where("parts is null").select("node", (F.col("cell") * FAN).alias("cell"), "near")
    # at most ``overlap`` parts of each of as many cells
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("near", "cell")))), 1, overlap)
    chosen = split.unionByName(as_it_was).groupBy("node").agg(best.alias("best"))
    rows = chosen.select("node", F.col("best.cell").alias("cells"), F.explode("best").alias("b")).select("node", "b.cell", "b.near", "cells")
    return cut(rows.join(nodes.select("node", "copies", "embedding"), "node"))


def adjacency(members: DataFrame) -> DataFrame:
    """node -> neighbours, united over the node's cells."""

    def cell(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        order = np.argsort(node)
        node = node[order]
        adjacent, medoid = build(matrix(table["embedding"])[order])
        lists = [node[a[a >= 0]] for a in adjacent]
        return pa.table([pa.array(node), pa.array(lists, pa.list_(pa.int64())), pa.array(np.arange(len(node)) == medoid)], names=["node", "nbrs", "medoid"])

    part = members.select("cell", "node", "embedding").groupBy("cell").applyInArrow(cell, "node long, nbrs array<long>, medoid boolean")
    return part.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


FOUND = "kind int, node long, links long, other long, cell long, seeds array<long>, visited array<long>"


def search_cell(threshold: float):
    """Searches of one round in one cell: counts (kind 0), forest of links (1) and queries that go on elsewhere (2)."""

    def cell(asked: pa.Table, members: pa.Table) -> pa.Table:
        schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("cell", pa.int64()), ("seeds", pa.list_(pa.int64())), ("visited", pa.list_(pa.int64()))])
        if not asked.num_rows or not members.num_rows:
            return schema.empty_table()
        node = members["node"].to_numpy()
        order = np.argsort(node)
        node, x = node[order], matrix(members["embedding"])[order]
        here = members["cell"][0].as_py()
        cells = [members["cells"][int(i)].as_py() for i in order]
        home = np.array([c[0] for c in cells])
        copies = members["copies"].to_numpy()[order]
        lists = [np.array(members["nbrs"][int(i)].as_py() or (), np.int64) for i in order]
        owner, flat = np.repeat(np.arange(len(node)), [len(v) for v in lists]), np.concatenate(lists)
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        inside = node[at] == flat
        owner, at = owner[inside], at[inside]
        degree = np.bincount(owner, minlength=len(node))
        adjacent = np.full((len(node), max(1, degree.max())), -1)
        adjacent[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)] = at
        medoid = int((x @ x.mean(axis=0)).argmax())
        q_node, q = asked["node"].to_numpy(), matrix(asked["embedding"])
        visited = asked["visited"].to_pylist()
        starts = np.full((len(q), max(ENTRIES + 1, SEEDS)), -1)
        starts[:, 0] = medoid
        starts[:, 1 : ENTRIES + 1] = np.linspace(0, len(node) - 1, ENTRIES).astype(int)
        for i, seeds in enumerate(asked["seeds"].to_pylist()):
            if seeds:
                s = np.searchsorted(node, seeds[:SEEDS])
                starts[i, :] = -1
                starts[i, : len(s)] = s
        links, nodes = np.zeros(len(q), np.int64), np.union1d(node, q_node)
        q_at, v_at, labels = np.searchsorted(nodes, q_node), np.searchsorted(nodes, node), np.arange(len(nodes))
        onward: dict[tuple[int, int], list[int]] = {}
        for fq, fv in search(x, adjacent, starts, q, threshold):
            other = q_node[fq] != node[fv]
            fq, fv = fq[other], fv[other]
            mine = home[fv] == here
            links += np.bincount(fq[mine], copies[fv[mine]], len(q)).astype(np.int64)
            labels = local_labels(len(nodes), q_at[fq], v_at[fv], labels)
            for i, v in zip(fq[~mine].tolist(), fv[~mine].tolist()):
                if home[v] not in visited[i]:
                    seeds = onward.setdefault((i, int(home[v])), [])
                    if len(seeds) < SEEDS:
                        seeds.append(int(node[v]))
        out = [pa.table([[0] * len(q), q_node, links, *[pa.nulls(len(q), f.type) for f in list(schema)[3:]]], schema=schema)]
        moved = np.nonzero(labels != np.arange(len(nodes)))[0]
        out.append(pa.table([[1] * len(moved), nodes[moved], pa.nulls(len(moved), pa.int64()), nodes[labels[moved]], *[pa.nulls(len(moved), f.type) for f in list(schema)[4:]]], schema=schema))
        by_query: dict[int, list[int]] = {}
        for i, c in onward:
            by_query.setdefault(i, []).append(c)
        go = list(onward.items())
        out.append(
            pa.table(
                [[2] * len(go), [int(q_node[i]) for (i, _), _ in go], pa.nulls(len(go), pa.int64()), pa.nulls(len(go), pa.int64()), [c for (_, c), _ in go], [s for _, s in go], [visited[i] + by_query[i] for (i, _), _ in go]],
                schema=schema,
            )
        )
        return pa.concat_tables(out)

    return cell


def search_round(ask: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Searches of all queries in the cells that they ask for; a cell that very many ask for is searched by several tasks."""
    deals = F.ceil(F.col("n") / ASKED).cast("int")
    much = cut(ask.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ASKED).select("cell", deals.alias("deals")))
    few = F.broadcast(much) if much.count() <= FEW_CELLS else much
    n = F.coalesce("deals", F.lit(1))
    asked = ask.join(few, "cell", "left").withColumn("deal", F.pmod(F.xxhash64(F.lit(2), "node"), n).cast("int")).drop("deals")
    there = members.join(few, "cell", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), n - 1))).drop("deals")
    there = there.toDF(*there.columns)  # columns of its own, as both come from the same rows
    return asked.groupBy("cell", "deal").cogroup(there.groupBy("cell", "deal")).applyInArrow(search_cell(threshold), FOUND)


def exact_links(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """As ``link``, by brute force: blocks of vectors, of ``SAMPLE_BYTES`` at most, one by one against all rows."""
    total = nodes.count()
    width = nodes.select(F.size("embedding")).first()[0] if total else 1
    blocks = -(-total * 8 * width // (SAMPLE_BYTES // 4))
    counts, edges = [], []
    for k in range(max(1, blocks)):
        rows = nodes.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(max(1, blocks))) == k).select("node", "embedding").toArrow()
        if not rows.num_rows:
            continue
        shared = nodes.sparkSession.sparkContext.broadcast((rows["node"].to_numpy(), matrix(rows["embedding"])))

        def compare(batches, shared=shared):
            q_node, q = shared.value
            for batch in batches:
                x, node, copies = matrix(batch.column("embedding")), batch.column("node").to_numpy(), batch.column("copies").to_numpy()
                both = np.union1d(q_node, node)
                q_at, v_at, labels, links = np.searchsorted(both, q_node), np.searchsorted(both, node), np.arange(len(both)), np.zeros(len(q), np.int64)
                for at in range(0, len(x), 512):
                    i, j = np.nonzero(q @ x[at : at + 512].T >= threshold)
                    i, j = i[q_node[i] != node[at + j]], at + j[q_node[i] != node[at + j]]
                    links += np.bincount(i, copies[j], len(q)).astype(np.int64)
                    labels = local_labels(len(both), q_at[i], v_at[j], labels)
                some, moved = np.nonzero(links)[0], np.nonzero(labels != np.arange(len(both)))[0]
                yield pa.record_batch(
                    [pa.array([0] * len(some) + [1] * len(moved), pa.int32()), np.r_[q_node[some], both[moved]], np.r_[links[some], np.zeros(len(moved), np.int64)], np.r_[np.zeros(len(some), np.int64), both[labels[moved]]]],
                    names=["kind", "node", "links", "other"],
                )

        found = cut(nodes.select("node", "copies", "embedding").mapInArrow(compare, "kind int, node long, links long, other long"))
        counts.append(found.where("kind = 0").select("node", "links"))
        edges.append(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
        shared.unpersist()
    links, forest = nodes.select("node", F.lit(0).cast("long").alias("links")), nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    for c, e in zip(counts, edges):
        links, forest = links.unionByName(c), forest.unionByName(e)
    return links.groupBy("node").agg(F.sum("links").alias("links")), forest


def link(nodes: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (a, b) of a forest of the links, for distinct vectors of one length."""
    spark = nodes.sparkSession
    total = nodes.count()
    width = nodes.select(F.size("embedding")).first()[0] if total else 1
    bound = max(1000, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    # by hash, so that no task sends more than its part
    share = min(1.0, 0.95 * bound / max(total, 1)) if total > bound else 1.0
    drawn = nodes.select("node", "embedding").where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(bound).toArrow().sort_by("node")
    n_cells = max(1, min(-(-total // CELL), drawn.num_rows // PER_CELL))
    middle = centres(matrix(drawn["embedding"]).astype(np.float32), n_cells) if drawn.num_rows else np.zeros((1, width), np.float32)
    placed = cut(place(nodes, middle, overlap))
    for _ in range(LEVELS):
        again = split_wide(placed, nodes, overlap)
        if again is None:
            break
        placed = again
    members = cut(placed.join(adjacency(placed), "node", "left"))
    vectors = nodes.select("node", "embedding")
    ask = members.select("cell", "node", "embedding", F.lit(None).cast("array<long>").alias("seeds"), F.col("cells").alias("visited"))
    counts, edges = [], []
    while True:  # a query never goes to a cell twice
        found = cut(search_round(ask, members, threshold))
        counts.append(found.where("kind = 0").select("node", "links"))
        edges.append(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
        # one search of a query in a cell, however many of its cells led there
        seen = found.where("kind = 2").groupBy("node", "cell").agg(F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds"))
        were = found.where("kind = 2").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("visited"))).alias("visited"))
        ask = cut(seen.join(were, "node").join(vectors, "node").select("cell", "node", "embedding", F.slice("seeds", 1, SEEDS).alias("seeds"), "visited"))
        if ask.isEmpty():
            break
    links = counts[0]
    for c in counts[1:]:
        links = links.unionByName(c)
    forest = edges[0]
    for e in edges[1:]:
        forest = forest.unionByName(e)
    return links.groupBy("node").agg(F.sum("links").alias("links")), forest


def audit(named: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED) -> float | None:
    """Part of the links that was found: distinct vectors with their copies and n_links, held against brute force.

    Queries are drawn by hash, of all vectors and once more of those with links; of either draw, links are taken together
    and as an average a query, and the lowest of these figures counts. None if no query has a link. Too many links raise.
    """
    spark = named.sparkSession
    total, linked, width = named.agg(F.count(F.lit(1)), F.count_if(F.col("n_links") > 0), F.max(F.size("embedding"))).first()
    draws = []
    for rows, n in ((named, total), (named.where("n_links > 0"), linked)):
        if n:
            most = min(queries, max(1, SAMPLE_BYTES // (8 * max(1, width))))
            by_hash = F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) <= int(min(1.0, most / n) * (1 << 20))
            draws.append(rows.where(by_hash).limit(2 * most).select("embedding", "n_links").toArrow())
    if not draws:
        return None
    drawn = pa.concat_tables(draws).combine_chunks()
    lengths = drawn["embedding"].combine_chunks().value_lengths().to_numpy()
    by_length = {int(k): np.nonzero(lengths == k)[0] for k in np.unique(lengths)}
    shared = spark.sparkContext.broadcast({k: (ids, matrix(drawn["embedding"].take(pa.array(ids)))) for k, ids in by_length.items()})

    def count(batches):
        sure, most = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for batch in batches:
            of = batch.column("embedding").value_lengths().to_numpy()
            for k in np.unique(of):
                if int(k) in shared.value:
                    ids, q = shared.value[int(k)]
                    some = pa.array(np.nonzero(of == k)[0])
                    copies = batch.column("copies").take(some).to_numpy()
                    cosine = q @ matrix(batch.column("embedding").take(some)).T
                    sure[ids] += (cosine >= threshold + CLOSE) @ copies
                    most[ids] += (cosine >= threshold - CLOSE) @ copies
        yield pa.record_batch([pa.array(range(len(sure)), pa.int64()), pa.array(sure), pa.array(most)], names=["i", "sure", "most"])

    truth = named.select("embedding", "copies").mapInArrow(count, "i long, sure long, most long").groupBy("i").agg(F.sum("sure").alias("sure"), F.sum("most").alias("most"))
    truth = truth.toArrow().sort_by("i")
    sure, most, have = truth["sure"].to_numpy() - 1, truth["most"].to_numpy() - 1, drawn["n_links"].to_numpy()
    if (have > most).any():
        raise RuntimeError(f"flatgraph: {(have > most).sum()} of {len(have)} audited vectors have more links than there are")
    figures, at = [], 0
    for draw in draws:
        has, want = have[at : at + draw.num_rows], sure[at : at + draw.num_rows]
        at += draw.num_rows
        has, want = np.minimum(has, want)[want > 0], want[want > 0]
        if len(want):
            figures += [has.sum() / want.sum(), (has / want).mean()]
    return float(min(figures)) if figures else None


def joined_links(nodes: DataFrame, lengths: list[int], threshold: float, overlap: int | None) -> DataFrame:
    """Distinct vectors with copies, n_links and component_id; without an overlap, by brute force."""
    alike = [nodes.where(F.size("embedding") == n) for n in sorted(lengths)]
    parts = [link(x, threshold, overlap) if overlap else exact_links(x, threshold) for x in alike]
    if not parts:
        return nodes.select("embedding", "copies", F.lit(0).cast("long").alias("n_links"), F.col("first_id").alias("component_id"))
    links, forest = parts[0]
    for more_links, more in parts[1:]:
        links, forest = links.unionByName(more_links), forest.unionByName(more)
    joined = cut(nodes.join(links, "node", "left").join(components(forest), "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = cut(joined.groupBy("component").agg(F.min("first_id").alias("component_id")))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return cut(joined.join(first, "component").select("embedding", "copies", n_links.alias("n_links"), "component_id"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, and the audited recall (null if no audited vector has a link)."""
    rows = vectors.select("vec_id", "embedding").withColumn("ok", valid(F.col("embedding")))
    good = rows.where("ok")
    nodes = cut(
        good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    )
    lengths = [r[0] for r in nodes.select(F.size("embedding").alias("n")).distinct().collect()]
    overlap = OVERLAP
    while True:
        named = joined_links(nodes, lengths, threshold, overlap)
        recall = audit(named, threshold)
        if overlap is None or recall is None or recall >= LEAST_RECALL:
            break
        overlap = 2 * overlap if overlap < MOST_OVERLAP else None
    found = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = cut(found.unionByName(alone))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))


def op1_flatgraph(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_flatgraph": op1_flatgraph}
#: SQL would compare all pairs; the tests hold the result to brute force instead.
ORACLE_SQL = {}
