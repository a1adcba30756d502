"""Embedding near-dedup with a robust-pruned flat graph.

1. Equal vectors of a label are collapsed to one node with a count.
2. Centroids are fitted on a bounded sample; each node joins the shards of its nearest centroids
   (its home and ``overlap - 1`` more). A shard with more than ``block`` members is dealt into
   salted blocks, so no task holds more than a block of one shard and the home nodes that ask it.
3. In every block the nearest candidates of each node are pruned robustly: a kept neighbour removes
   the candidates that are alpha times closer to it than to the node. Nodes that the medoid does
   not reach get an edge from their nearest reached node.
4. The adjacency lists of the overlapping shards are united by node.
5. Each home node runs a greedy beam search from the block's medoid over the united lists; from
   every node found in range (with some slack) the search expands until no new one is in range.
6. What is found is verified by cosine in double precision; links below the threshold never count.
7. Recall is audited: a bounded set of nodes is compared with all rows. Below ``min_recall`` the
   search is repeated with twice the overlap.

A node counts a block's members once, since the blocks of its home shard are disjoint. Links are
returned as counts and spanning forests per block, so a group of thousands of near copies gives
rows in proportion to its members, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

THRESHOLD = 0.93
#: Documented bounds: rows on which centroids are fitted, centroids, audited nodes.
SAMPLE, MAX_CENTROIDS, AUDITED = 20_000, 4096, 256
#: Home nodes a shard is meant to have, members of a block, shards that a node joins.
SHARD, BLOCK, OVERLAP = 1024, 6144, 4
DEGREE, CANDIDATES, ALPHA, BEAM, SLACK = 24, 64, 1.2, 48, 0.1
MIN_RECALL = 0.97


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that can link: label and vector not null, every component finite, not all zero."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    got = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))
    return got.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by the largest component first so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(col) -> np.ndarray:
    return unit(np.stack([np.asarray(v, float) for v in col])) if len(col) else np.zeros((0, 1))


def centroids(nodes: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By dimension, centroids of a bounded sample of the nodes by spherical k-means; one dimension only gets more than one."""
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    k = int(min(MAX_CENTROIDS, max(1, -(-most // shard))))
    rows = nodes.select("v").where("size(v) > 0").orderBy(F.xxhash64("v")).limit(min(sample, 40 * k)).collect() if k > 1 else []
    if not rows:
        return {}
    sizes = pd.Series([len(r["v"]) for r in rows])
    dim = int(sizes.mode()[0])
    x = unit(np.array([r["v"] for r in rows if len(r["v"]) == dim], float))
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.abs(total).max(axis=1) > 0
        c[full] = unit(total[full])
    return {dim: c}


def assign(nodes: DataFrame, cents: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``(label, dim, shard, home, node, n, v)``: each node in its home shard and the next nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["v"].map(len)
            for dim, part in pdf.groupby(dims):
                c = cents.get(dim)
                m = 1 if c is None else min(overlap, len(c))
                near = np.zeros((len(part), 1), int) if c is None else np.argsort(-(_matrix(part["v"]) @ c.T), axis=1, kind="stable")[:, :m]
                rep = part.loc[part.index.repeat(m)]
                yield pd.DataFrame({"label": rep["label"], "dim": dim, "shard": near.ravel(), "home": np.tile(np.arange(m) == 0, len(part)), "node": rep["node"], "n": rep["n"], "v": rep["v"]})

    return nodes.mapInPandas(run, "label string, dim int, shard int, home boolean, node long, n long, v array<double>")


def prune(x: np.ndarray, degree: int = DEGREE, cands: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of each row's nearest candidates; -1 fills short lists."""
    n = len(x)
    k = min(cands, n - 1)
    out = np.full((n, degree), -1)
    if k < 1:
        return out
    for lo in range(0, n, 512):
        sim = x[lo : lo + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sim, near, 1), 0))
        alive, row = np.ones(near.shape, bool), np.arange(len(near))
        for d in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            first = alive.argmax(axis=1)
            p = near[row, first]
            out[lo + row[has], d] = p[has]
            gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", x[near], x[p]), 0))
            alive &= alpha * gap > dist
            alive[row, first] = False
    return out


def reach(x: np.ndarray, adj: list[np.ndarray], start: int) -> list[np.ndarray]:
    """``adj`` with an edge to every node that ``start`` doesn't reach, from its nearest reached node."""
    seen = np.zeros(len(x), bool)
    todo = [start]
    seen[start] = True
    while True:
        while todo:
            fresh = np.unique(np.concatenate([adj[i] for i in todo]) if todo else np.zeros(0, int)).astype(int)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            todo = fresh.tolist()
        if seen.all():
            return adj
        u = int(np.flatnonzero(~seen)[0])
        known = np.flatnonzero(seen)
        near = int(known[(x[known] @ x[u]).argmax()])
        adj[near] = np.append(adj[near], u)
        seen[u] = True
        todo = [u]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, start: int, threshold: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, node row) in range: greedy beam search from ``start``, then range expansion.

    ``adj`` has the neighbours of each node in a row, filled with -1.
    """
    q, n = len(queries), len(x)
    seen = np.zeros((q, n), bool)
    ids, sims = np.full((q, beam), -1), np.full((q, beam), -3.0)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, queries @ x[start], False, True
    rows = np.arange(q)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def note(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        hits.append((a[s >= threshold - slack], b[s >= threshold - slack]))

    note(rows, ids[:, 0], sims[:, 0])
    while True:
        open_ = ~done
        act = rows[open_.any(axis=1)]
        if not len(act):
            break
        pos = open_[act].argmax(axis=1)  # beams are sorted, so the first open one is the best
        done[act, pos] = True
        nb = adj[ids[act, pos]]
        ok = nb >= 0
        ok &= ~seen[act[:, None], np.where(ok, nb, 0)]
        a, b = np.broadcast_to(act[:, None], nb.shape)[ok], nb[ok]
        seen[a, b] = True
        s = np.full(nb.shape, -3.0)
        s[ok] = np.einsum("ij,ij->i", queries[a], x[b])
        note(a, b, s[ok])
        all_s, all_i = np.concatenate([sims[act], s], 1), np.concatenate([ids[act], nb], 1)
        all_d = np.concatenate([done[act], ~ok], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        sims[act], ids[act], done[act] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_d, top, 1)
    front = tuple(np.concatenate(h) for h in zip(*hits, strict=True))
    found = [front]
    while len(front[0]):
        nexts = []
        for lo in range(0, len(front[0]), 20_000):
            nb = adj[front[1][lo : lo + 20_000]]
            a, b = np.broadcast_to(front[0][lo : lo + 20_000, None], nb.shape)[nb >= 0], nb[nb >= 0]
            key = np.unique(a[~seen[a, b]] * n + b[~seen[a, b]])
            a, b = key // n, key % n
            seen[a, b] = True
            s = np.einsum("ij,ij->i", queries[a], x[b])
            nexts.append((a[s >= threshold - slack], b[s >= threshold - slack]))
        front = tuple(np.concatenate(h) for h in zip(*nexts, strict=True))
        found.append(front)
    a, b = (np.concatenate(h) for h in zip(*found, strict=True))
    exact = np.einsum("ij,ij->i", queries[a], x[b]) >= threshold
    return a[exact], b[exact]


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """For each linked node the least node of its group, by repeated minima over the links."""
    ids, inv = np.unique(np.r_[a, b], return_inverse=True)
    a, b = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    order = np.argsort(nodes[ids], kind="stable")
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        old = root.copy()
        m = np.minimum(root[a], root[b])
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        if (old == root).all():
            break
    least = nodes[ids][order]
    return [(int(x), int(least[r])) for x, r in zip(nodes[ids], root, strict=True) if x != least[r]]


def blocks(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` with the number of blocks of its shard and the block that each member falls in."""
    key = ["label", "dim", "shard"]
    many = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).select(*key, F.ceil(F.col("_m") / block).cast("int").alias("blocks"))
    return placed.join(many, key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))


def adjacency(placed: DataFrame) -> DataFrame:
    """``(node, near)``: the pruned neighbours of a node, united over the shards that it is in."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        x, nodes = _matrix(pdf["v"]), pdf["node"].to_numpy()
        adj = prune(x)
        lists = reach(x, [r[r >= 0] for r in adj], medoid(x))
        return pd.DataFrame({"node": nodes, "near": [nodes[r] for r in lists]})

    per_shard = placed.groupBy("label", "dim", "shard", "block").applyInPandas(build, "node long, near array<long>")
    return per_shard.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def range_search(placed: DataFrame, near: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """``(kind, node, value)``: 'n' rows count the vectors a node links to in a block, 'f' rows are forest links.

    ``exact`` compares each asker with all members of the block instead of searching the graph.
    """
    members = placed.join(near, "node")
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), (b == F.col("block")).alias("member")))
    dealt = members.withColumn("ask", F.explode(F.when(F.col("home"), asks).otherwise(F.array(F.struct(F.col("block"), F.lit(True).alias("member"))))))
    # Home nodes ask every block of their shard; a salt keeps the askers of one task to a block's size.
    split = F.when(F.col("ask.member"), F.lit(None)).otherwise(F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    dealt = dealt.select("label", "dim", "shard", "blocks", F.col("ask.block").alias("b"), F.col("ask.member").alias("member"), "home", split.alias("part"), "node", "n", "v", "near")
    # Members of a block go to each part that asks it; askers of its own block are part -1.
    parts = F.when(F.col("member"), F.sequence(F.lit(-1), F.when(F.col("blocks") > 1, F.col("blocks") - 1).otherwise(F.lit(-1)))).otherwise(F.array("part"))
    dealt = dealt.withColumn("part", F.explode(parts))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        mem = pdf[pdf["member"]]
        own = (pdf["part"].iat[0]) == -1
        ask = mem[mem["home"]] if own else pdf[~pdf["member"]]
        out: list[tuple[str, int, int]] = []
        if len(mem) and len(ask):
            x, nodes, n = _matrix(mem["v"]), mem["node"].to_numpy(), mem["n"].to_numpy()
            at = {v: i for i, v in enumerate(nodes.tolist())}
            lists = [] if exact else reach(x, [np.array([at[v] for v in r if v in at], int) for r in mem["near"]], medoid(x))
            adj = np.full((len(x), max([1, *map(len, lists)])), -1)
            for i, r in enumerate(lists):
                adj[i, : len(r)] = r
            q, q_nodes = _matrix(ask["v"]), ask["node"].to_numpy()
            start, links = medoid(x), np.empty((0, 2), np.int64)
            for lo in range(0, len(q), 256):
                a, b = np.nonzero(q[lo : lo + 256] @ x.T >= threshold) if exact else search(x, adj, q[lo : lo + 256], start, threshold)
                other = q_nodes[lo + a] != nodes[b]
                a, b = a[other] + lo, b[other]
                total = np.bincount(a, weights=n[b], minlength=len(q)).astype(int)
                out += [("n", int(q_nodes[i]), int(total[i])) for i in np.flatnonzero(total)]
                # Pairs of a chunk are reduced to a forest at once, so a block of near copies holds no square of itself.
                every, inv = np.unique(np.r_[links[:, 0], q_nodes[a], links[:, 1], nodes[b]], return_inverse=True)
                half = len(inv) // 2
                links = np.array(_forest(every, inv[:half], inv[half:]), np.int64).reshape(-1, 2)
            out += [("f", int(u), int(v)) for u, v in links]
        return pd.DataFrame(out, columns=["kind", "node", "value"])

    return dealt.groupBy("label", "dim", "shard", "b", "part").applyInPandas(run, "kind string, node long, value long")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """Links that ``counts`` has over all links there are, of ``audited`` nodes, drawn by hash alone, compared with every row."""
    some = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(audited)
    asked = [(r["node"], r["label"], np.array(r["v"], float)) for r in nodes.join(F.broadcast(some), "node").select("node", "label", "v").collect()]
    if not asked:
        return 1.0
    groups = {}
    for node, label, v in asked:
        groups.setdefault((label, len(v)), []).append((node, unit(v[None])[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[int, int] = {}
            for (label, dim), part in pdf.groupby([pdf["label"], pdf["v"].map(len)]):
                for node, v in groups.get((label, dim), ()):
                    hit = (_matrix(part["v"]) @ v >= threshold) & (part["node"].to_numpy() != node)
                    total[node] = total.get(node, 0) + int(part["n"].to_numpy()[hit].sum())
            yield pd.DataFrame({"node": list(total), "links": list(total.values())}, dtype="int64")

    true = nodes.mapInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    got = true.join(counts, "node", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0)))), F.sum("true")).first()
    return (got[0] or 0) / got[1] if got[1] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK, overlap: int = OVERLAP, min_recall: float = MIN_RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)`` for every row of ``vectors`` (vec_id, embedding, label).

    ``recall`` is what the last audit measured. Below ``min_recall`` the nodes go to twice as many
    shards; once every node is in all shards of its label, each block is compared exactly instead.

    Null, zero and non-finite vectors, vectors with a null component, and rows with a null label
    link with nothing: n_links 0, component_id their own vec_id. Vectors of different length never
    link. Rows that repeat a vec_id are taken as one vector each for the counts, and all get the
    result of the id. A null vec_id stays a row with no links and null component. Empty tables give
    empty results; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = usable(rows)
    # One node for each distinct vector of a label, named by its smallest vec_id.
    copies = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    cents, exact = centroids(copies, shard), False
    while True:
        placed = cut(blocks(assign(copies, cents, overlap), block))
        found = cut(range_search(placed, adjacency(placed), threshold, exact))
        counts = found.where("kind = 'n'").groupBy("node").agg(F.sum("value").alias("links"))
        widest = max([1, *map(len, cents.values())])
        recall = audit(copies, counts, threshold)
        if recall >= min_recall or exact:
            break
        overlap, exact = min(2 * overlap, max(widest, overlap)), overlap >= widest
    comp = connected_components(found.where("kind = 'f'").select(F.col("node").alias("a"), F.col("value").alias("b")))
    node = copies.join(counts, "node", "left").join(comp, "node", "left")
    node = node.select("label", "v", F.col("node").alias("_node"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    by_id = good.join(node, ["label", "v"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(by_id, "vec_id", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == comp_id, F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), kept.alias("kept"), F.lit(recall).cast("double").alias("recall"))
