"""Components, near vectors, n-gram join and neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseledger.llm import near_vectors, neighbours, ngram_join
from caseledger.llm.components import components
from caseledger.llm.textvec import word_blocks
from caseledger.llm.common import texts_of


def union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + \
        [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)] + [(7, 7), (3, 2), (2, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = union(300, links)
    assert got == {n: want[n] for pair in links if pair[0] != pair[1] for n in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ----------------------------------------------------------- near vectors --

def _brute_vectors(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1]
          and np.isfinite(r[1]).all() and np.any(r[1])]
    links = []
    for i, a in enumerate(ok):
        for j, b in enumerate(ok[:i]):
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= near_vectors.COSINE:
                    links.append((i, j))
    root = union(len(ok), links)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(ok):
        least[root[i]] = min(least[root[i]], r[0])
    out = [[r[0], 0, r[0]] for r in ok]
    for i, r in enumerate(ok):
        out[i][1], out[i][2] = sum(i in p for p in links), least[root[i]]
    return sorted(map(tuple, out))


def _near_rows():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for g in range(6):
        x = rng.normal(size=16)
        for _ in range(12):  # near copies, some on either side of the threshold
            y = x + rng.normal(size=16) * 0.12 * (1 + g % 3)
            rows.append((k, [float(v) for v in y.astype(np.float32)], g % 2))
            k += 1
        rows += [(k + i, [float(v) for v in x.astype(np.float32)], g % 2) for i in range(3)]
        k += 3
    rows += [(k + i, [float(v) for v in rng.normal(size=16)], 0) for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)  # 16: buckets are cut into parts
    rows = _near_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r[0], r[1], r[2]) for r in near_vectors.link_vectors(df).collect())
    assert got == _brute_vectors(rows)


@pytest.mark.parametrize("block, tile", [(4096, 512), (4096, 100), (64, 16)])
def test_near_vectors_in_a_hot_group(spark, monkeypatch, block, tile):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_vectors, "_TILE", tile)
    monkeypatch.setattr(near_vectors, "_LINKS", 1000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=16)
    rows = [(i, [float(v) for v in x + rng.normal(size=16) * (0.05 if i % 2 else 0.2)], 1) for i in range(240)]
    rows += [(240 + i, rows[i][1], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r[0], r[1], r[2]) for r in near_vectors.link_vectors(df).collect())
    want = _brute_vectors(rows)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    # a pair is found if it meets in some bucket; nearly all here do
    assert all(n <= m for (_, n, _), (_, m, _) in zip(got, want))
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in want)


def test_tiles_meet_where_pairs_do():
    rng = np.random.default_rng(9)
    p, q = (rng.integers(0, 6, (30, 10, 5)) for _ in range(2))
    i, j = (a.ravel() for a in np.indices((30, 30)))
    at, bucket = near_vectors.meeting_place(p[i], q[j])
    for t, k in ((0, 3), (1, 2), (4, 0), (9, 5)):
        earlier = (at >= 0) & ((at < t) | ((at == t) & (bucket < k)))
        assert (near_vectors._before(p, q, t, k).ravel() == earlier).all()


def test_hooks_join_long_chains():
    n = 5000
    root = near_vectors._hook(np.arange(n), np.arange(n - 1), np.arange(1, n))
    assert (root == 0).all()
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 400, 150), rng.integers(0, 400, 150)
    want = union(400, list(zip(a, b)))
    got = near_vectors._hook(near_vectors._hook(np.arange(400), a[:70], b[:70]), a[70:], b[70:])
    assert [min(j for j in range(400) if want[j] == want[i]) for i in range(400)] == list(got)


def test_near_vectors_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1),
            (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1),
            (11, [5.0], 1), (12, [7.0], 1), (None, [1.0, 0.0], 1), (13, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(map(tuple, near_vectors.link_vectors(df).collect()), key=str)
    want = {1: (2, 1), 2: (2, 1), 11: (1, 11), 12: (1, 11)}
    assert len(got) == len(rows)
    for i, n, c, kept in got:
        assert (n, c) == want.get(i, (0, i)) and kept == (None if i is None else i == c)
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = near_vectors.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8))


# ------------------------------------------------------------ n-gram join --

def _sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def _brute_join(rows, percent, size):
    sets = _sets([t for _, t in rows], size)
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union(len(sets), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(((d, len(sets[i]), least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)


def _texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    shared = list(rng.choice(words, 30))
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 60 + 5 * g))
        for _ in range(12):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
        rows += [" ".join(base)] * 3
    for _ in range(40):  # a passage that many documents share
        rows.append(" ".join([*rng.choice(words, 20), *shared, *rng.choice(words, 20)]))
    rows += ["A b", "a  B\n", "a b c", "a b c d", "A B C D", "a b c d e", "", None, "  ", "one", "ONE", "É é", "é é"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent,size", [(85, 4), (80, 5), (60, 2)])
def test_join_against_brute_force(spark, percent, size):
    rows = _texts() + [(3, "a b c d"), (None, "a b c d e"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.join_similar(df, percent=percent, size=size).collect()), key=str)
    assert got == _brute_join(rows, percent, size)


def test_join_with_few_rows_hot_in_a_block(spark, monkeypatch):
    rows = [(i, f"same words in every text but {i % 5} and then some more words to be alike") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join_similar(df, percent=50, size=3).collect()), key=str)
    assert got == _brute_join(rows, 50, 3)
    assert ngram_join.join_similar(df.limit(0)).count() == 0
    kept = ngram_join.drop_similar(df.unionByName(df), percent=50, size=3)
    assert sorted(r[0] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_drop_tells_rows_of_one_id_apart(spark):
    base, clean, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, base), (2, clean), (2, base + " more"), (3, other), (3, other + " more"), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, ngram_join.drop_similar(df).collect()), key=str)
    assert [r for r in kept if r[0] != 3] == sorted([(1, base), (2, clean), (None, base)], key=str)
    assert sum(r[0] == 3 for r in kept) == 1


@pytest.mark.parametrize("block,percent", [(1024, 85), (16, 60)])
def test_links_against_brute_force(spark, monkeypatch, block, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)  # 16: buckets are cut into parts
    rows = _texts() + [(3, "a b c d"), (None, "a b c d e"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.join_similar(df, percent=percent, size=3, links=True).collect()), key=str)
    sets = _sets([t for _, t in rows], 3)
    plain = _brute_join(rows, percent, 3)
    want = sorted((d, len(s), sum(bool(s and o) and 100 * len(s & o) >= percent * len(s | o) for j, o in enumerate(sets) if j != i))
                  for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)
    assert sorted(r[:3] for r in got if r[0] is not None) == sorted(p for p in plain if p[0] is not None)
    assert sorted((d, n, k) for d, n, _, k in got if d is not None) == want


@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=6), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_shingles_against_sets(texts, size):
    data, off = texts_of(pa.array(texts, pa.string()))
    got, ids = [0] * len(texts), defaultdict(set)
    for w in word_blocks(data, off):
        row, h = ngram_join.shingles(w, size)
        for r, x in zip(row, h):
            got[w.first + r] += 1
            ids[int(x)].add(w.first + r)
    sets = _sets(texts, size)
    assert got == [len(s) for s in sets]
    grams = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            grams[g].add(i)
    assert sorted(map(sorted, ids.values())) == sorted(map(sorted, grams.values()))


# ------------------------------------------------------------- neighbours --

def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:140] = x[50]  # one vector many times
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(neighbours.build(df), df.where("vec_id % 10 = 0")).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 900, 10):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        hit += len(set(want) & {i for i, _ in found[q]})
        assert len(found[q]) == 10
        assert all(s == pytest.approx(d[i], abs=1e-12) for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (p[1], p[0]))
    assert hit / 900 >= 0.9
    assert [i for i, _ in found[50]] == list(range(100, 110))


def test_a_full_shard_finds_nearly_all(spark):
    rng = np.random.default_rng(8)
    n = neighbours.SHARD_NODES
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = neighbours.build(df)
    assert [r["count"] for r in index.nodes.groupBy("shard").count().collect()] == [n]  # many more than the beam
    found = defaultdict(set)
    for r in neighbours.search(index, df.where("vec_id % 80 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in range(0, n, 80):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(found[q] & set(np.argsort(d)[:10].tolist())) / 10)
    print("recall on a full shard", np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_queries_come_in_bounded_parts(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(400, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = neighbours.build(df)
    whole = sorted(map(tuple, neighbours.search(index, df).collect()))
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    asked, parts = neighbours.ask(index, df, "vec_id", "embedding")
    sizes = [r["count"] for r in asked.groupBy("shard", "dim", "part").count().collect()]
    assert parts == 8 and sum(sizes) == 400 and max(sizes) <= 100
    assert sorted(map(tuple, neighbours.search(index, df).collect())) == whole


def test_neighbour_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [3.0]),
            (100, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(map(tuple, neighbours.search(neighbours.build(df), df.where("vec_id % 100 = 0")).collect()))
    assert got == [(0, 1, 100, 0.0), (0, 2, 2, 1.0), (100, 1, 0, 0.0), (100, 2, 2, 1.0)]
    none = df.limit(0)
    assert neighbours.search(neighbours.build(none), none).count() == 0


def test_walk_finds_all_with_a_wide_beam():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    links = np.stack([np.r_[(i + 1) % 60, (i + 7) % 60, -1] for i in range(60)])
    d = neighbours.walk(x, links, x[:5], np.array([0]), 60)
    assert np.allclose(d, ((x[:5, None] - x[None]) ** 2).sum(2))
