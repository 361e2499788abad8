"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Vectors with equal label, length and components are one class, kept as one
representative and a count. A table hashes a vector by two random rotations
(three rounds of random signs and a Hadamard transform each); the hash is the
nearest signed axis of both. A vector is a member of its bucket and visits the
buckets of its next best axes (multiprobe), so two near vectors meet where one
is a member and the other a member or visitor. Every pair that meets is verified
once, in the first bucket where it meets, by cosine in double precision.

Buckets are worked on in blocks of bounded rows. A bucket with more rows is cut
into parts, and each pair of parts is a block. Blocks return sums and a spanning
forest, never pairs, so a large group of near copies costs rows in proportion to
its size.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label or id, link with nothing and come back alone.
Rows with equal ids are rows of their own. Other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm.components import components
from caseledger.session import materialize

COSINE = 0.93
TABLES, ROTATIONS, PROBES = 10, 2, 4
#: Rows of a block, about, and components of its vectors; a greater bucket is cut
#: into parts of half as many.
BLOCK_ROWS, BLOCK_VALUES = 16384, 1 << 20


def usable(vector: Column) -> Column:
    """True for vectors that have a direction."""
    d = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(d, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def hashes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 29) -> np.ndarray:
    """Buckets [row, table, 1 + probes] of unit rows: the own bucket, then the
    visited ones (-1 for none), by the loss of the axis they give up."""
    n, dim = x.shape
    size = 1 << max(1, int(dim - 1).bit_length())
    rng = np.random.default_rng([seed, size])
    out = np.full((n, tables, 1 + probes), -1, np.int64)
    padded = np.zeros((n, size), np.float32)
    padded[:, :dim] = x
    at = np.arange(n)[:, None]
    width = min(1 + probes, size)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(ROTATIONS):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), size)) / np.float32(size ** 0.5)
            best = np.argsort(-np.abs(y), 1, kind="stable")[:, :width]
            v = y[at, best]
            axes.append(2 * best + (v < 0))
            loss.append(np.abs(v[:, :1]) - np.abs(v))
        base = 2 * size
        own = axes[0][:, 0] * base + axes[1][:, 0]
        other = np.concatenate([axes[0][:, 1:] * base + axes[1][:, :1], axes[0][:, :1] * base + axes[1][:, 1:]], 1)
        cost = np.concatenate([loss[0][:, 1:], loss[1][:, 1:]], 1)
        near = np.argsort(cost, 1, kind="stable")[:, :probes]
        out[:, t, 0] = own
        out[:, t, 1:1 + near.shape[1]] = other[at, near]
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), len(flat) // max(1, len(col)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hash_classes(classes: DataFrame) -> DataFrame:
    """Adds ``codes`` (flat [table, 1 + probes]) to the classes."""
    kind = T.StructType([*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    names = [f.name for f in kind.fields]

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes = np.zeros((len(dims), TABLES * (1 + PROBES)), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                codes[at] = hashes(_unit(_matrix(b.column("embedding").take(pa.array(at))))).reshape(len(at), -1)
            flat = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names)

    return classes.mapInArrow(run, kind)


def meeting_place(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First table and bucket where each pair of rows with codes ``p`` and ``q``
    ([pair, table, 1 + probes]) meets: the least bucket there that is the own one
    of either and is held by the other. Table -1 if they never meet."""
    none = np.iinfo(p.dtype).max
    in_q = (q == p[:, :, :1]).any(2)
    in_p = (p == q[:, :, :1]).any(2)
    bucket = np.minimum(np.where(in_q, p[:, :, 0], none), np.where(in_p, q[:, :, 0], none))
    met = in_p | in_q
    first = met.argmax(1)
    return np.where(met.any(1), first, -1), bucket[np.arange(len(p)), first]


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place of each component when links a-b join those that ``root``
    gives. Greater roots hang on lesser ones and paths are halved by pointer
    jumping, so a long chain takes few passes."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            return root
        a, b = low[live], high[live]
        root = root.copy()
        np.minimum.at(root, b, a)
        while not np.array_equal(root, up := root[root]):
            root = up


def _before(p: np.ndarray, q: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """[i, j]: rows with codes ``p[i]`` and ``q[j]`` meet in an earlier table, or
    in a lesser bucket of this one (as ``meeting_place``, for all pairs of a tile)."""
    out = np.zeros((len(p), len(q)), bool)
    for t in range(table + 1):
        in_q, in_p = np.zeros_like(out), np.zeros_like(out)
        for k in range(p.shape[2]):
            in_q |= p[:, t, :1] == q[:, t, k]
            in_p |= p[:, t, k:k + 1] == q[:, t, 0]
        if t == table:
            in_q &= p[:, t, :1] < bucket
            in_p &= q[:, t, 0] < bucket
        out |= in_q | in_p
    return out


_LINKED = "rep long, n_links long, root long"
#: Rows of a tile, links kept before they join the forest.
_TILE, _LINKS = 512, 1 << 18


def _block(table: pa.Table) -> pa.Table:
    """Verified links of a block: for each linked row the number of vectors
    linked here first, and the least row it hangs together with. A bucket is
    worked on in tiles, so memory is bounded by the block's rows also where all
    of them link."""
    table = table.combine_chunks().sort_by([("bucket", "ascending"), ("rep", "ascending")])
    bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
    member, rep = table["member"].to_numpy(zero_copy_only=False), table["rep"].to_numpy()
    count = table["n"].to_numpy().astype(np.float64)  # sums stay exact below 2^53
    x = _unit(_matrix(table["embedding"]))
    codes = _matrix(table["codes"]).astype(np.int64).reshape(len(rep), TABLES, 1 + PROBES)
    if codes.max(initial=0) < np.iinfo(np.int32).max:
        codes = codes.astype(np.int32)
    which, left, right = table["table"].to_numpy(), table["left"].to_numpy(), table["right"].to_numpy()
    group = table["grp"].to_numpy()
    order = np.lexsort((rep, bucket, which, group))
    key = np.stack([group[order], which[order], bucket[order]])
    head = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    tail = np.r_[head[1:], len(order)]
    ids, place = np.unique(rep, return_inverse=True)
    root, sums = np.arange(len(ids)), np.zeros(len(ids))
    linked = np.zeros(len(ids), bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for s, e in zip(head, tail):
        if e - s < 2 or not member[order[s:e]].any():
            continue
        tiles = [order[i:min(i + _TILE, e)] for i in range(s, e, _TILE)]
        t, k = int(which[order[s]]), bucket[order[s]]
        across = left[order[s]] != right[order[s]]  # a block of two parts: pairs across them only
        for n, i in enumerate(tiles):
            for j in tiles[n:]:
                cos = x[i] @ x[j].T
                link = cos >= COSINE - 1e-9
                link &= member[i][:, None] | member[j]
                if across:
                    link &= part[i][:, None] != part[j]
                if i is j:
                    link = np.triu(link, 1)
                u, v = np.nonzero(link)
                if not len(u):
                    continue
                near = cos[u, v] < COSINE + 1e-9  # so near the bound that the product's rounding could decide
                if near.any():
                    fine = np.ones(len(u), bool)
                    fine[near] = np.einsum("ij,ij->i", x[i[u[near]]], x[j[v[near]]]) >= COSINE
                    link[u[~fine], v[~fine]] = False
                    u, v = u[fine], v[fine]
                a, b = place[i[u]], place[j[v]]
                linked[a] = linked[b] = True
                if len(u) * 8 < link.size or link.size < 4096:
                    at, where = meeting_place(codes[i[u]], codes[j[v]])
                    once = (at == t) & (where == k)
                    sums += np.bincount(a[once], count[j[v[once]]], len(ids)) + np.bincount(b[once], count[i[u[once]]], len(ids))
                else:
                    once = (link & ~_before(codes[i], codes[j], t, k)).astype(np.float64)
                    np.add.at(sums, place[i], once @ count[j])
                    np.add.at(sums, place[j], count[i] @ once)
                apart = root[a] != root[b]  # the forest takes all links, the sums each link once
                waiting.append((a[apart], b[apart]))
                if sum(len(w[0]) for w in waiting) > _LINKS:
                    root, waiting = _hook(root, *map(np.concatenate, zip(*waiting))), []
    if waiting:
        root = _hook(root, *map(np.concatenate, zip(*waiting)))
    return pa.table({"rep": ids[linked], "n_links": sums[linked].astype(np.int64), "root": ids[root[linked]]})


def blocks(coded: DataFrame) -> DataFrame:
    """A row for each class, table and bucket it is a member or visitor of, with
    the block (``blk``) that works on it."""
    entry = F.posexplode("codes")
    rows = coded.select("*", entry.alias("_i", "bucket")).where("bucket >= 0")
    width = 1 + PROBES
    rows = rows.select("dim", F.xxhash64("label", "dim").alias("grp"), (F.col("_i") / width).cast("int").alias("table"), "bucket",
                       (F.col("_i") % width == 0).alias("member"), "rep", "n", "embedding", "codes")
    keys = ["grp", "table", "bucket"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("member").alias("any"), F.max("dim").alias("wide"))
    sizes = sizes.where(F.col("any") & (F.col("rows") > 1))
    most = F.greatest(F.lit(2), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.col("wide"))))
    sizes = materialize(sizes.select(*keys, "rows", "wide", most.alias("most")))
    whole = sizes.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("wide"))).first()
    groups = max(1, (whole[0] or 0) // BLOCK_ROWS, (whole[1] or 0) // BLOCK_VALUES)
    rows = rows.join(sizes.drop("wide"), keys)
    parts = F.when(F.col("rows") <= F.col("most"), F.lit(1)) \
        .otherwise(F.ceil(F.col("rows") / F.floor(F.col("most") / 2))).cast("int")
    rows = rows.withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(F.col("part"), o).alias("left"), F.greatest(F.col("part"), o).alias("right")))))
    blk = F.when(F.col("parts") == 1, F.pmod(F.xxhash64(*keys), F.lit(groups))) \
        .otherwise(F.xxhash64(*keys, "pair.left", "pair.right"))
    return rows.select("dim", blk.alias("blk"), (F.col("parts") > 1).alias("cut"), *keys, "member", "rep", "n", "embedding",
                       "codes", "part", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ok = usable(F.col(embedding)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    plain = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.when(ok, plain).alias("embedding"))
    rows = rows.select("vec_id", "label", "embedding", F.size("embedding").alias("dim"),
                       F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")).alias("k1"),
                       F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.lit(7), "label")).alias("k2"))
    classes = materialize(rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("embedding").alias("embedding")))
    classes = classes.withColumn("rep", F.col("k1"))  # ids may repeat, so a class goes by its hash
    coded = materialize(hash_classes(classes.select("rep", "n", "label", "dim", "embedding")))
    linked = materialize(blocks(coded).groupBy("dim", "blk", "cut").applyInArrow(_block, _LINKED))
    links = linked.groupBy("rep").agg(F.sum("n_links").alias("links"))
    comps = components(linked.where("rep <> root"), "rep", "root")
    found = materialize(classes.select("k1", "k2", "rep", "n", "least").join(links, "rep", "left")
                        .join(comps, F.col("rep") == F.col("node"), "left")
                        .select("k1", "k2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                F.coalesce("component", "rep").alias("c")))
    first = materialize(found.groupBy("c").agg(F.min("least").alias("component")))
    found = materialize(found.join(first, "c").select("k1", "k2", "n_links", "component"))
    out = rows.select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
