"""Vector codes."""

import hashlib
import math

import numpy as np
import pytest

from caseledger.llm import vector_codes


def _brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes, errors and codebooks of (id, label, vector) rows, one number at a time."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    if not kept:
        return {}, ""
    dim = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    width = dim // parts
    cut = [[r[2][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c, r in zip(cut[:entries], kept) if r[0] is not None] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [near(p, c[p])[1] for c in cut]
            new.append([[sum(c[p][j] for c, o in zip(cut, own) if o == k) // own.count(k) for j in range(width)]
                        if k in own else e for k, e in enumerate(books[p])])
        books = new
    out, per_label = [], {}
    for r, c in zip(kept, cut):
        got = [near(p, c[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
        per_label[r[1]] = per_label.get(r[1], 0) + out[-1][3]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per_label[lab], h) for i, lab, c, e in out), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows],
                                 "vec_id long, label string, embedding array<float>, code string")


def _float(x):
    return float(np.float32(x))


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(1000 - i, ["a", "b", None][i % 3], [_float(x) for x in rng.normal(0, 0.3, 32)]) for i in range(150)]
    rows += rows[:5]  # repeated rows
    rows += [(2, "a", rows[7][2]), (2, "b", rows[9][2]), (None, "a", rows[3][2]), (3, None, [0.0] * 32)]  # ties
    rows += [(4, "a", None), (5, "a", []), (6, "a", [None] * 32), (7, "a", [float("nan")] * 32),
             (8, "b", [float("inf")] * 32), (9, "b", [1.0] * 31), (10, "b", [1.0] * 16), (0, "b", [1e30] * 32)]
    got = vector_codes.digest(vector_codes.compress(_frame(spark, rows).repartition(4)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = _brute([r for r in rows if r[0] != 0])
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(5, None, [0.5] * 16)], [(1, "a", [0.25] * 16), (2, "a", [-0.3] * 16)]])
def test_few_rows(spark, rows):
    got = vector_codes.digest(vector_codes.compress(_frame(spark, rows)))
    rows = [(i, lab, v and [_float(x) for x in v]) for i, lab, v in rows]
    want = _brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == (want if isinstance(want, list) else [])


def test_great_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", [_float(x) for x in rng.uniform(-2e5, 2e5, 64)]) for i in range(70)]
    got = vector_codes.digest(vector_codes.compress(_frame(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_codes_stand_for_near_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "a", [_float(x) for x in rng.normal(0, 0.2, 32)]) for i in range(400)]
    coded = vector_codes.compress(_frame(spark, rows))
    back = {r["vec_id"]: np.array(r["embedding"]) for r in vector_codes.reconstruct(coded).collect()}
    error = {r["vec_id"]: r["error"] for r in coded.rows.collect()}
    for i, _, v in rows:
        whole = np.floor(256 * np.array(v))
        assert np.square(whole - 256 * back[i]).sum() == error[i]


def test_tables_give_the_plain_distances():
    rng = np.random.default_rng(8)
    x, books = rng.integers(-300, 300, (40, 12)), rng.integers(-300, 300, (3, 5, 4))
    best, distance = vector_codes.assign(*vector_codes.dictionaries(x), books)
    d = np.square(x.reshape(40, 3, 1, 4) - books[None]).sum(3)
    assert (best.T == d.argmin(2)).all() and (distance.T == d.min(2)).all()
