"""Similarity self-join of documents on word n-grams by Jaccard similarity.

1. Count. Each block of documents sends its distinct hashed n-grams, packed by
   hash range; n-grams frequent within the block go as one record with a count,
   their rows stay behind. A range knows how many documents hold each n-gram and
   answers with those held by two or more. N-grams held once can't be shared, so
   no later step moves them.
2. Prefix filter. A document's n-grams are ordered rare first (by that count,
   then hash). Two documents can only be similar if they share an n-gram among
   the first ``n - ceil(t n) + 1`` of each. A document whose prefix is filled by
   n-grams of its own has no partner and is done. Equal sets are one class.
3. Join. Classes meet in the buckets of their prefix n-grams under the length
   and positional filters. In star rounds each bucket compares its classes with
   the one that has the fewest n-grams of its own (of a group of near copies,
   most likely the text they were made from), and what links becomes one component; once few pairs are left, all
   pairs in a bucket across components are compared, so no link is lost and a large group of
   near copies costs rows in proportion to its size.
4. Verify. Each pair once: the suffix filter bounds the overlap by the sizes of 32
   parts of both sets, then the sets are intersected.
5. Count links, if asked for. Every pair of classes that shares a prefix n-gram,
   within a component too, is verified once, in the first bucket where it meets, in
   blocks of bounded rows; blocks return sums for each class, never pairs.

Cases: a text of fewer than ``size`` words is one n-gram; null texts and texts
without words have none and link with nothing. Rows with equal ids are rows of
their own; a null id can link others but names no component. Texts of any length are
taken whole, empty tables give no rows, and n-grams of equal count are ordered by hash. N-grams are told
apart by 64-bit hashes within a document and by 48 bits and their range between
documents. Other columns play no part; ``drop_similar`` returns them whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.llm.common import texts_of
from caseledger.llm.common import free_names
from caseledger.llm.components import components
from caseledger.llm.textvec import SPACE, Words, mix, word_blocks
from caseledger.session import materialize

#: Similarity in per cent, and words of an n-gram.
PERCENT, SIZE = 85, 4
#: Bytes of text of a block; bytes of text for each hash range, and ranges at least.
BLOCK_BYTES, RANGE_BYTES, MIN_RANGES = 1 << 21, 1 << 23, 64
#: An n-gram with so many rows in a block is sent once, with its count.
LOCAL_HOT = 8
PARTS = 32
#: Rounds of stars at most; after one, no more once all pairs of the buckets are so few for each row.
STAR_ROUNDS, FEW_PAIRS = 4, 8
#: Classes and n-grams of a block of the link count, about; a greater bucket is cut into parts of half as many.
BLOCK_ROWS, BLOCK_IDS = 1024, 1 << 20
_COLUMNS = 4096
_LOW = np.uint64((1 << 48) - 1)
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def shingles(w: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, n-gram hash) of a block, in order of row."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = []
    if n >= size:
        whole = np.flatnonzero(w.row[size - 1:] == w.row[:n - size + 1])
        h = w.hash[whole]
        for k in range(1, size):
            h = mix(h * _STEPS[k % 4] + w.hash[whole + k])
        parts.append((w.row[whole], h))
    head = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
    many = np.diff(np.r_[head, n])
    few = many < size
    at, left = head[few], many[few]
    if len(at):
        h = w.hash[at]
        for k in range(1, size - 1):
            more = left > k
            h[more] = mix(h[more] * _STEPS[k % 4] + w.hash[at[more] + k])
        parts.append((w.row[at], mix(h + left.astype(np.uint64) * _STEPS[0])))
    row, h = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
    return row[new], h[new]


def _pack(h: np.ndarray) -> bytes:
    """Low 48 bits of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()),
                   ("hot_ids", pa.binary()), ("hot_n", pa.binary()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary())])
_SENT_DDL = ("part long, block long, ids binary, rows binary, hot_ids binary, hot_n binary, docs array<long>, keys array<long>, sizes binary")


def _send(ranges: int, size: int):
    """Postings of each block by hash range, and one row about the block itself."""
    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, keys = b.column("doc_id").cast(pa.int64()), b.column("key")
            data, off = texts_of(b.column("text"))
            for w in word_blocks(data, off, SPACE, BLOCK_BYTES):
                row, h = shingles(w, size)
                sizes = np.bincount(row, minlength=w.last - w.first).astype(np.int32)
                part = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(h)
                head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
                many = np.diff(np.r_[head, len(h)])
                frequent = np.zeros(len(h), bool)
                frequent[order] = np.repeat(many >= LOCAL_HOT, many)
                hot_at, hot_n = order[head[many >= LOCAL_HOT]], many[many >= LOCAL_HOT]
                out = []
                own = np.flatnonzero(~frequent)
                own = own[np.argsort(part[own], kind="stable")]  # rows stay in order within a range
                hot_by = np.argsort(part[hot_at], kind="stable")
                hot_at, hot_n = hot_at[hot_by], hot_n[hot_by]
                cut = np.searchsorted(part[own], np.arange(ranges + 1))
                hot_cut = np.searchsorted(part[hot_at], np.arange(ranges + 1))
                for p in np.flatnonzero((np.diff(cut) > 0) | (np.diff(hot_cut) > 0)):
                    o, k = own[cut[p]:cut[p + 1]], slice(hot_cut[p], hot_cut[p + 1])
                    out.append((int(p), serial, _pack(h[o]), row[o].astype(np.uint16).tobytes(), _pack(h[hot_at[k]]),
                                hot_n[k].astype(np.uint32).tobytes(), None, None, None))
                f = np.flatnonzero(frequent)
                f = f[np.argsort(h[f], kind="stable")]
                mine = (h[f] & _LOW) | (part[f].astype(np.uint64) << np.uint64(48))
                out.append((serial % ranges, serial, mine.tobytes(), row[f].astype(np.uint16).tobytes(), None, None,
                            ids[w.first:w.last].to_pylist(), keys[w.first:w.last].to_pylist(), sizes.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SENT)], schema=_SENT)
                serial += 1
    return run


_ANSWER = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("df", pa.binary()),
                     ("hot_ids", pa.binary()), ("hot_df", pa.binary()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary())])
_ANSWER_DDL = "block long, ids binary, rows binary, df binary, hot_ids binary, hot_df binary, docs array<long>, keys array<long>, sizes binary"


def _count(key, table):
    """Document counts of a hash range: to each block, its n-grams held by two
    documents or more. Rows about blocks pass unchanged."""
    tag = np.uint64(key[0].as_py() & 0xFFFF) << np.uint64(48)
    out, sent = [], []
    for r in table.to_pylist():
        if r["docs"] is not None:
            out.append((r["block"], r["ids"], r["rows"], None, None, None, r["docs"], r["keys"], r["sizes"]))
        else:
            sent.append((r["block"], _unpack(r["ids"]), np.frombuffer(r["rows"], np.uint16), _unpack(r["hot_ids"]),
                         np.frombuffer(r["hot_n"], np.uint32)))
    if sent:
        ids = np.concatenate([s[1] for s in sent] + [s[3] for s in sent])
        many = np.concatenate([np.ones(len(s[1]), np.uint32) for s in sent] + [s[4] for s in sent])
        order = np.argsort(ids)
        head = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
        df = np.empty(len(ids), np.uint32)
        df[order] = np.repeat(np.add.reduceat(many[order], head).astype(np.uint32), np.diff(np.r_[head, len(ids)]))
        a, b = 0, sum(len(s[1]) for s in sent)
        for block, own, rows, hot, _ in sent:
            d, hd = df[a:a + len(own)], df[b:b + len(hot)]
            a, b = a + len(own), b + len(hot)
            keep = d >= 2
            if keep.any() or len(hot):
                out.append((block, (own[keep] | tag).tobytes(), rows[keep].tobytes(), d[keep].tobytes(),
                            (hot | tag).tobytes(), hd.tobytes(), None, None, None))
    cols = zip(*out) if out else [[] for _ in _ANSWER]
    return pa.table([pa.array(c, t.type) for c, t in zip(cols, _ANSWER)], schema=_ANSWER)


_DOCS_DDL = "doc_id long, key long, n_shingles long, own int, fp long, ids array<long>, parts array<int>"


def _gather(percent: int):
    def run(key, table):
        """A block's documents, each with its shared n-grams, rare first, if it
        can have a partner."""
        ids, rows, dfs, hot = [], [], [], {}
        about = None
        hot_ids, hot_dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for r in table.to_pylist():
            if r["docs"] is not None:
                about = r
            else:
                ids.append(np.frombuffer(r["ids"], np.uint64))
                rows.append(np.frombuffer(r["rows"], np.uint16))
                dfs.append(np.frombuffer(r["df"], np.uint32))
                hot_ids.append(np.frombuffer(r["hot_ids"], np.uint64))
                hot_dfs.append(np.frombuffer(r["hot_df"], np.uint32))
        docs, sizes = about["docs"], np.frombuffer(about["sizes"], np.int32).astype(np.int64)
        mine = np.frombuffer(about["ids"], np.uint64)
        h, d = np.concatenate(hot_ids), np.concatenate(hot_dfs)
        if len(mine):
            order = np.argsort(h)
            h, d = h[order], d[order]
            ids.append(mine)
            rows.append(np.frombuffer(about["rows"], np.uint16))
            dfs.append(d[np.searchsorted(h, mine)])
        i = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
        r = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        f = np.concatenate(dfs) if dfs else np.zeros(0, np.uint32)
        order = np.lexsort((i, f, r))
        i, r = i[order], r[order]
        n = len(docs)
        shared = np.bincount(r, minlength=n)
        own = sizes - shared
        prefix = sizes - (sizes * percent + 99) // 100 + 1
        open_ = (sizes > 0) & (own < prefix)
        end = np.cumsum(shared)
        out_ids, out_parts, fps = [], [], []
        block = key[0].as_py()
        for k in range(n):
            if not open_[k]:
                out_ids.append(None)
                out_parts.append(None)
                fps.append(None)
                continue
            mine = i[end[k] - shared[k]:end[k]]
            out_ids.append(mine.view(np.int64))
            out_parts.append(np.bincount((mine & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
            # equal sets have no n-gram of their own; others are told apart by place
            what = int(mix(mine).sum(dtype=np.uint64)) if own[k] == 0 else block * int(_STEPS[1]) + k
            what += int(sizes[k]) * int(_STEPS[int(own[k] == 0)])
            fps.append(int(mix(np.array([what % 2**64], np.uint64)).view(np.int64)[0]))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "key": pa.array(about["keys"], pa.int64()), "n_shingles": pa.array(sizes), "own": pa.array(own.astype(np.int32)),
                         "fp": pa.array(fps, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())),
                         "parts": pa.array(out_parts, pa.list_(pa.int32()))})
    return run


def shared_ngrams(docs: DataFrame, text: str, doc_id: str, percent: int, size: int) -> DataFrame:
    """(doc_id, key, n_shingles, own, fp, ids, parts) of every row; ``key`` is the
    text's hash, ``fp`` and the rest are null where no partner is possible."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    whole = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, whole // RANGE_BYTES)
    sent = src.mapInArrow(_send(ranges, size), _SENT_DDL)
    answers = sent.groupBy("part").applyInArrow(_count, _ANSWER_DDL)
    return answers.groupBy("block").applyInArrow(_gather(percent), _DOCS_DDL)


def _fits(na: Column, nb: Column, common: Column, percent: int) -> Column:
    return common * (100 + percent) >= (na + nb) * percent


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: suffix filter on narrow rows, then the
    sets themselves."""
    narrow = sets.select("fp", "n", "parts")
    near = (pairs.join(narrow.toDF("a", "na", "pa"), "a").join(narrow.toDF("b", "nb", "pb"), "b"))
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = near.where(_fits(F.col("na"), F.col("nb"), bound, percent)).select("a", "b")
    ids = sets.select("fp", "n", "ids")
    both = near.join(ids.toDF("a", "na", "ia"), "a").join(ids.toDF("b", "nb", "ib"), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(_fits(F.col("na"), F.col("nb"), common, percent)).select("a", "b")


def _may_match(x: str, y: str, percent: int) -> Column:
    """Length and positional filters on a shared prefix n-gram."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    rest = 1 + F.least(nx - F.col(f"{x}.at") - 1, ny - F.col(f"{y}.at") - 1)
    return length & _fits(nx, ny, rest, percent)


def _prefix_size(percent: int) -> Column:
    """Shared n-grams in a set's prefix."""
    return (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - F.col("own")).cast("int")


def link_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of linked classes. ``sets``: (fp, n, own, ids, parts), stored."""
    prefix = materialize(sets.select("fp", "n", "own", F.posexplode(F.slice("ids", F.lit(1), _prefix_size(percent))).alias("i", "id"))
                         .select("id", "fp", "n", "own", (F.col("own") + F.col("i")).alias("at")))
    tried = links = comps = None
    turn, found, live, columns = 0, True, prefix, prefix.columns
    while True:
        rows = live.withColumn("c", F.col("fp")) if comps is None else \
            live.join(comps, F.col("fp") == F.col("node"), "left").select(*columns, F.coalesce("component", "fp").alias("c"))
        mixed = materialize(rows.groupBy("id").agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"),
            F.min_by(F.struct("fp", "n", "at", "c"), F.struct("own", F.xxhash64("fp", F.lit(turn)))).alias("mid"))
            .where("lo < hi").select("id", "mid", "k"))
        left = mixed.agg(F.sum("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()
        if left[0] is None:  # no bucket holds two components
            break
        # after the first, stars pay while the buckets' pairs are many times their rows
        last = turn > 0 and (not found or turn == STAR_ROUNDS or left[1] <= FEW_PAIRS * left[0])
        rows = materialize(rows.join(mixed.drop("k"), "id"))
        live = rows.select(*columns)  # a bucket of one component stays one
        x = F.struct("fp", "n", "at").alias("x")
        if not last:  # each bucket around one of its classes
            pairs = rows.where(F.col("c") != F.col("mid.c")).select(x, F.struct("mid.fp", "mid.n", "mid.at").alias("y"))
        else:  # all that is left across components
            cs = materialize(rows.groupBy("id", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                                         F.max(F.col("n") - F.col("at")).alias("rest")))
            # the same filters on components: no pair in them passes where their ranges don't
            sides = cs.toDF("id", "cx", "lx", "hx", "rx").join(cs.toDF("id", "cy", "ly", "hy", "ry"), "id").where(
                (F.col("cx") < F.col("cy")) & (F.col("hx") * 100 >= F.col("ly") * percent)
                & (F.col("hy") * 100 >= F.col("lx") * percent)
                & _fits(F.col("lx"), F.col("ly"), F.least("rx", "ry"), percent)).select("id", "cx", "cy")
            pairs = (sides.join(rows.select("id", F.col("c").alias("cx"), x), ["id", "cx"])
                     .join(rows.select("id", F.col("c").alias("cy"), F.struct("fp", "n", "at").alias("y")), ["id", "cy"]))
        pairs = pairs.where(_may_match("x", "y", percent)) \
            .select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        new = materialize(_verify(pairs, sets, percent))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = not new.isEmpty()
        if found:
            links = new if links is None else links.unionByName(new)
            comps = materialize(components(links))
        if last:
            break
        turn += 1
    return comps


def _overlaps(row: np.ndarray, ids: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each two of ``k`` rows: ids they share, and those of them that come
    ``before`` the bucket's."""
    _, col, many = np.unique(ids, return_inverse=True, return_counts=True)
    both = many[col] > 1
    row, before = row[both], before[both]
    _, col = np.unique(col[both], return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col, before = row[order], col[order], before[order]
    common, earlier = np.zeros((k, k), np.int64), np.zeros((k, k), np.int64)
    width = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, width, _COLUMNS):
        part = slice(*np.searchsorted(col, [c, c + _COLUMNS]))
        x = np.zeros((k, min(_COLUMNS, width - c)), np.float32)
        x[row[part], col[part] - c] = 1
        common += (x @ x.T).astype(np.int64)
        late = np.flatnonzero(~before[part])
        x[row[part][late], col[part][late] - c] = 0
        earlier += (x @ x.T).astype(np.int64)
    return common, earlier


def _count_block(percent: int):
    def run(table):
        """Rows of other classes that each class of a block links with, by the
        links that meet here first."""
        table = table.combine_chunks()
        lists = table["ids"].combine_chunks()
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        bucket, fp, n, rows, at, part, left, right = (table[c].to_numpy() for c in (
            "id", "fp", "n", "rows", "i", "part", "left", "right"))
        order = np.lexsort((right, left, bucket))
        key = np.stack([bucket[order], left[order], right[order]])
        head = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        who, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(head, np.r_[head[1:], len(order)]):
            r = order[s:e]
            size = off[r + 1] - off[r]
            row = np.repeat(np.arange(len(r)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            common, earlier = _overlaps(row, flat[np.repeat(off[r], size) + place], place < at[r][row], len(r))
            # n-grams are in one order everywhere, so a pair has met before if it shares one before this
            link = (common * (100 + percent) >= (n[r][:, None] + n[r]) * percent) & (earlier == 0)
            a, b = np.nonzero(np.triu(link, 1))
            if left[r[0]] != right[r[0]]:  # a block of two parts: pairs across them only
                across = part[r[a]] != part[r[b]]
                a, b = a[across], b[across]
            who += [fp[r[a]], fp[r[b]]]
            many += [rows[r[b]], rows[r[a]]]
        ids, at = np.unique(np.concatenate(who), return_inverse=True)
        sums = np.zeros(len(ids), np.int64)
        np.add.at(sums, at, np.concatenate(many))
        return pa.table({"fp": ids, "n_links": sums})
    return run


def count_links(sets: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(fp, n_links): for each linked class, the rows of all other classes similar
    to it. ``sets``: as for ``link_classes``; ``counts``: (fp, rows), stored."""
    entry = F.posexplode(F.slice("ids", F.lit(1), _prefix_size(percent))).alias("i", "id")
    prefix = materialize(sets.select("fp", "n", F.size("ids").alias("size"), entry))
    sizes = materialize(prefix.groupBy("id").agg(F.count("*").alias("k"), F.sum("size").alias("w")).where("k > 1"))
    whole = sizes.agg(F.sum("k"), F.sum("w")).first()
    groups = max(1, (whole[0] or 0) // BLOCK_ROWS, (whole[1] or 0) // BLOCK_IDS)
    parts = F.when((F.col("k") <= BLOCK_ROWS) & (F.col("w") <= BLOCK_IDS), F.lit(1)).otherwise(
        F.greatest(F.ceil(F.col("k") / (BLOCK_ROWS // 2)), F.ceil(F.col("w") / (BLOCK_IDS // 2)))).cast("int")
    rows = prefix.join(sizes, "id").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts")).cast("int"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(F.col("part"), o).alias("left"), F.greatest(F.col("part"), o).alias("right")))))
    blk = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("id"), F.lit(groups))) \
        .otherwise(F.xxhash64("id", "pair.left", "pair.right"))
    rows = rows.select(blk.alias("blk"), (F.col("parts") > 1).alias("cut"), "id", "fp", "n", "i", "part",
                       F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
    rows = rows.join(sets.select("fp", "ids").join(counts, "fp"), "fp")
    return rows.groupBy("blk", "cut").applyInArrow(_count_block(percent), "fp long, n_links long") \
        .groupBy("fp").agg(F.sum("n_links").alias("n_links"))


def _join(docs: DataFrame, text: str, doc_id: str, percent: int, size: int, links: bool = False) -> DataFrame:
    """(doc_id, key, n_shingles, fp, first) for every row, and n_links if asked
    for; ``first``: least (doc_id, key) of its component."""
    rows = materialize(shared_ngrams(docs, text, doc_id, percent, size))
    sets = materialize(rows.where("fp IS NOT NULL").select("fp", F.col("n_shingles").alias("n"), "own", "ids", "parts")
                       .dropDuplicates(["fp"]))
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"))
    comps = link_classes(sets, percent)
    if comps is not None:
        least = classes.join(comps, F.col("fp") == F.col("node"), "left") \
            .select("fp", "first", F.coalesce("component", "fp").alias("c"))
        least = materialize(least)
        classes = least.drop("first").join(materialize(least.groupBy("c").agg(F.min("first").alias("first"))), "c").select("fp", "first")
    classes = materialize(classes)
    out = rows.select("doc_id", "key", "n_shingles", "fp").join(classes, "fp", "left")
    if links:
        counts = materialize(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("rows")))
        found = counts.join(count_links(sets, counts, percent), "fp", "left") \
            .select("fp", (F.col("rows") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
        out = out.join(materialize(found), "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out


def join_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT,
                 size: int = SIZE, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set and
    the least id of its component. With ``links`` also n_links: how many other
    rows it is similar to."""
    out = _join(docs, text, doc_id, percent, size, links)
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, *["n_links"] * links)


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT,
                 size: int = SIZE) -> DataFrame:
    """``docs`` with the least id of each component only. Rows without id stay.
    Rows with equal ids are told apart by their text: each goes or stays with its
    own component, of several texts in one component one stays, and of rows with
    equal id and text one stays."""
    found = materialize(_join(docs, text, doc_id, percent, size).select("doc_id", "key", "first"))
    gone, gone_key, two = free_names(docs, "_lost", "_lost_key", "_twice")
    lost = found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))) \
        .where("doc_id IS NOT NULL").select(F.col("doc_id").alias(gone), F.col("key").alias(gone_key)).distinct()
    kept = docs.join(lost, (docs[doc_id].cast("long") == F.col(gone)) & (F.xxhash64(docs[text]) == F.col(gone_key)), "left_anti")
    twice = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
                        .select(F.col("doc_id").alias(two)))
    if twice.isEmpty():
        return kept
    again = kept[doc_id].cast("long") == F.col(two)
    return kept.join(twice, again, "left_anti").unionByName(
        kept.join(twice, again, "left_semi").dropDuplicates([doc_id, text]))
