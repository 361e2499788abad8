"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Equal vectors are one node. Nodes are dealt by hash to shards of one size,
however many there are. A shard's graph starts from random neighbours; each
round, a Spark join of the graph with itself proposes neighbours of neighbours
(either way round, at least one of the two links new), and each shard keeps the
nearest of what it had and what was proposed, until few links change. A query walks every shard's graph from the same entries:
it expands its nearest unexpanded nodes until these are all farther than the
``beam`` nearest it has seen. The nearest of all shards, with the members of their
nodes, are the answer, by Euclidean distance in double precision.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without id, take no part, neither as queries nor as
candidates. Vectors of another length are no candidates. Rows with equal ids are
rows of their own as candidates and one query, by the least of their vectors. Other columns are not read, so their names can't clash. With fewer candidates than asked for, all found are returned.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseledger.llm.near_vectors import usable
from caseledger.session import materialize

#: Nodes of a shard, and queries that one task asks a shard, at most, about.
SHARD_NODES, QUERY_ROWS = 8192, 8192
#: Neighbours of a node, nearest nodes that point to it.
DEGREE, REVERSE = 16, 16
#: NN-descent ends with a round that changes no more than this share of the links.
CHANGED = 0.01
BEAM, ENTRIES, EXPAND = 256, 32, 8
_PAIRS = 1 << 15


class Index(NamedTuple):
    nodes: DataFrame    # (shard, dim, node, embedding), stored
    graph: DataFrame    # (shard, dim, node, nb), stored
    members: DataFrame  # (node, vec_id), stored


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node ids and their vectors."""
    col = table["embedding"].combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(col), len(x) // max(1, len(col)))
    ids = table["node"].to_numpy()
    order = np.argsort(ids)
    return ids[order], x[order]


def _distance(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for i in range(0, len(a), _PAIRS):
        d = x[a[i:i + _PAIRS]] - x[b[i:i + _PAIRS]]
        out[i:i + _PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def _in_order(diff: np.ndarray) -> np.ndarray:
    """Sums of squares of the rows, added from the first component to the last."""
    total = np.zeros(len(diff))
    for column in np.square(diff).T:
        total += column
    return total


def _first(key: np.ndarray, d: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` least ``d`` of each key."""
    order = np.lexsort((d, key))
    k = key[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    rank = np.arange(len(k)) - np.repeat(head, np.diff(np.r_[head, len(k)]))
    return order[rank < many]


_SIDES = "shard long, dim int, node long, nb long, forward boolean, fresh boolean"


def _sides(key, ids: np.ndarray, x: np.ndarray, u: np.ndarray, v: np.ndarray, old: np.ndarray) -> pa.Table:
    """Nearest neighbours of each node among the proposed (u, v), and the nearest
    nodes that point to it. ``old``: sorted keys of the links there were."""
    n = len(ids)
    pair = np.unique(np.minimum(u, v) * n + np.maximum(u, v))
    u, v = pair // n, pair % n
    u, v = u[u != v], v[u != v]
    d = _distance(x, u, v)
    u, v, d = np.r_[u, v], np.r_[v, u], np.r_[d, d]
    pair = u * n + v
    keep = _first(u, d, DEGREE) if len(u) else np.zeros(0, np.int64)
    u, v, d, pair = u[keep], v[keep], d[keep], pair[keep]
    fresh = ~np.isin(pair, old)
    back = _first(v, d, REVERSE) if len(u) else keep
    two = np.isin(v[back] * n + u[back], pair)  # there already
    back = back[~two]
    node, nb = np.r_[u, v[back]], np.r_[v, u[back]]
    fwd = np.r_[np.ones(len(u), bool), np.zeros(len(back), bool)]
    return pa.table({"shard": np.full(len(node), key[0].as_py()), "dim": np.full(len(node), key[1].as_py(), np.int32),
                     "node": ids[node], "nb": ids[nb], "forward": fwd, "fresh": np.r_[fresh, fresh[back]]})


def _start(key, table):
    ids, x = _vectors(table)
    n = len(ids)
    rng = np.random.default_rng([abs(key[0].as_py()), n])
    u = np.repeat(np.arange(n), DEGREE)
    return _sides(key, ids, x, u, rng.integers(0, n, len(u)), np.zeros(0, np.int64))


def _improve(key, nodes, proposed):
    ids, x = _vectors(nodes)
    n = len(ids)
    u, v = (np.searchsorted(ids, proposed[c].to_numpy()) for c in ("u", "v"))
    had = proposed["had"].to_numpy(zero_copy_only=False)
    return _sides(key, ids, x, u, v, np.sort(u[had] * n + v[had]))


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = 11) -> Index:
    """Index all usable vectors. ``most``: members of a node to know, one more
    than the neighbours ever asked for."""
    plain = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()) \
        .select(F.col(vec_id).cast("long").alias("vec_id"), plain.alias("embedding")) \
        .select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2"))
    first = materialize(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.first("embedding").alias("embedding")))
    # only the least ids of a node can be among the nearest
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.select("k1", "k2", "vec_id").withColumn("r", rank).where(F.col("r") <= most)
    members = materialize(few.join(first.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "vec_id"))
    shards = max(1, -(-first.count() // SHARD_NODES))
    nodes = materialize(first.select(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).alias("shard"),
                                     F.size("embedding").alias("dim"), "node", "embedding"))
    keys = ["shard", "dim"]
    sides = materialize(nodes.groupBy(*keys).applyInArrow(_start, _SIDES))
    while True:
        links = sides.where("forward").agg(F.count("*"), F.count_if("fresh")).first()
        if links[1] <= CHANGED * links[0]:
            break
        s = sides.select(*keys, "node", F.col("nb").alias("u"), F.col("fresh").alias("fu"))
        t = sides.select(*keys, "node", F.col("nb").alias("v"), F.col("fresh").alias("fv"))
        near = s.join(t, [*keys, "node"]).where((F.col("u") < F.col("v")) & (F.col("fu") | F.col("fv"))) \
            .select(*keys, "u", "v", F.lit(False).alias("had"))
        had = sides.where("forward").select(*keys, F.col("node").alias("u"), F.col("nb").alias("v"), F.lit(True).alias("had"))
        sides = materialize(nodes.groupBy(*keys).cogroup(near.unionByName(had).groupBy(*keys)).applyInArrow(_improve, _SIDES))
    return Index(nodes, sides.select(*keys, "node", "nb"), members)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
    """Squared distances [query, node] of the nodes that each query has seen
    (infinite for others). ``links`` [node, any]: neighbours, -1 for none."""
    n = len(x)
    seen = np.full((len(q), n + 1), np.inf)  # the last column takes the -1
    done = np.zeros((len(q), n + 1), bool)
    done[:, n] = True

    def look(who: np.ndarray, at: np.ndarray) -> None:
        new = np.unique(who * (n + 1) + at)
        who, at = new // (n + 1), new % (n + 1)
        fresh = (at < n) & np.isinf(seen[who, at])
        who, at = who[fresh], at[fresh]
        for i in range(0, len(who), _PAIRS):
            d = q[who[i:i + _PAIRS]] - x[at[i:i + _PAIRS]]
            seen[who[i:i + _PAIRS], at[i:i + _PAIRS]] = np.einsum("ij,ij->i", d, d)

    live = np.arange(len(q))
    look(np.repeat(live, len(entries)), np.tile(entries, len(live)))
    step, wide = min(EXPAND, n), min(beam, n)
    while len(live):
        d = seen[live]
        bound = np.partition(d, wide - 1, 1)[:, wide - 1]
        d[done[live]] = np.inf
        pick = np.argpartition(d, step - 1, 1)[:, :step]
        near = np.take_along_axis(d, pick, 1)
        good = (near <= bound[:, None]) & np.isfinite(near)
        rows, cols = np.nonzero(good)
        live_rows, nodes = live[rows], pick[rows, cols]
        done[live_rows, nodes] = True
        to = links[nodes]
        look(np.repeat(live_rows, to.shape[1]), np.where(to < 0, n, to).ravel())
        live = live[good.any(1)]
    return seen[:, :n]


def _adjacency(ids: np.ndarray, table: pa.Table) -> np.ndarray:
    u, v = (np.searchsorted(ids, table[c].to_numpy()) for c in ("node", "nb"))
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    at = np.arange(len(u)) - np.searchsorted(u, u)
    out = np.full((len(ids), max(1, int(at.max(initial=0)) + 1)), -1, np.int64)
    out[u, at] = v
    return out


def _search(k: int, beam: int):
    def run(key, left, queries):
        points = left.filter(pa.compute.is_valid(left["embedding"]))
        ids, x = _vectors(points)
        out = []
        if len(ids) and queries.num_rows:
            links = _adjacency(ids, left.filter(pa.compute.is_valid(left["nb"])))
            qid, q = _vectors(queries)
            rng = np.random.default_rng(len(ids))
            entries = rng.permutation(len(ids))[:ENTRIES]
            for i in range(0, len(q), 256):
                d = walk(x, links, q[i:i + 256], entries, beam)
                for j, row in enumerate(d):
                    best = np.lexsort((ids, row))[:k]
                    best = best[np.isfinite(row[best])]
                    out.append((np.full(len(best), qid[i + j]), ids[best], _in_order(x[best] - q[i + j])))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": cols[0].astype(np.int64), "node": cols[1].astype(np.int64), "d2": cols[2]})
    return run


def ask(index: Index, queries: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(shard, dim, part, node, embedding): every query for every shard of its
    length, dealt by hash to parts of bounded rows; and the number of parts."""
    plain = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    q = queries.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()) \
        .select(F.col(vec_id).cast("long").alias("node"), plain.alias("embedding")) \
        .groupBy("node").agg(F.min("embedding").alias("embedding"))
    q = materialize(q.select("node", "embedding", F.size("embedding").alias("dim")))
    parts = max(1, -(-q.count() // QUERY_ROWS))
    q = q.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(parts)).cast("int"))
    shards = materialize(index.nodes.select("shard", "dim").distinct())
    return q.join(shards, "dim").select("shard", "dim", "part", "node", "embedding"), parts


def search(index: Index, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
           beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row,
    its own row left out."""
    asked, parts = ask(index, queries, vec_id, embedding)
    none = index.graph.select("shard", "dim", "node", F.lit(None).cast("array<double>").alias("embedding"), "nb")
    left = index.nodes.select("shard", "dim", "node", "embedding", F.lit(None).cast("long").alias("nb")).unionByName(none)
    # a shard goes to each part of the queries
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["shard", "dim", "part"]
    near = left.groupBy(*keys).cogroup(asked.groupBy(*keys)) \
        .applyInArrow(_search(k + 1, beam), "query long, node long, d2 double")
    order = Window.partitionBy("query").orderBy("d2", "node")
    near = materialize(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))
    found = near.join(index.members, "node").where(F.col("query") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id",
        F.sqrt("d2").alias("score"))
