"""Quotient filters and phrases."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseledger.llm import phrases
from caseledger.llm import quotient_filter as Q

_WIDTHS = st.lists(st.integers(1, 64), min_size=1, max_size=3).map(tuple)


@given(_WIDTHS, st.integers(0, 2**32), st.integers(0, 400), st.integers(0, 5), st.integers(1, 4))
@settings(max_examples=120, deadline=None)
def test_filters_hold_every_key_and_count(widths, seed, n, shard_bits, parts):
    rng = np.random.default_rng(seed)
    keys = [tuple(int(rng.integers(0, 1 << min(w, 6))) << max(0, w - 6) for w in widths) for _ in range(n)]
    form = Q.Layout(widths, min(shard_bits, widths[0]))
    some: dict[int, list[Q.Entries]] = {}
    for p in range(parts):
        own = keys[p::parts]
        limbs = tuple(np.array([k[i] for k in own], np.uint64) for i in range(len(widths)))
        back = Q.restore(Q.permute(limbs, widths), widths)
        assert all((a == b).all() for a, b in zip(limbs, back))
        for shard, filter_ in Q.by_shard(Q.count(limbs, form), form):
            some.setdefault(shard, []).append(Q.decode(filter_, form, shard))
    got: Counter = Counter()
    for entries in some.values():
        e = Q.merge(entries)
        assert list(zip(*e.limbs)) == sorted(set(zip(*e.limbs)))
        for *key, c in zip(*Q.restore(e.limbs, widths), e.counts):
            got[tuple(map(int, key))] += int(c)
    assert got == Counter(keys)


def test_permutation_is_one_to_one():
    x = np.arange(1 << 12, dtype=np.uint64)
    y = Q.permute((x >> np.uint64(5), x & np.uint64(31)), (7, 5))
    assert len(set(zip(*map(list, y)))) == 1 << 12


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 21, 22, 32])
def test_packed_words_come_back(bits):
    rng = np.random.default_rng(bits)
    for size in range(2, 6):
        ids = rng.integers(0, 1 << bits, (50, size))
        limbs = phrases.pack(list(ids.T), bits)
        assert len(limbs) == len(phrases.layout(size, bits)[1])
        assert (phrases.unpack(limbs, size, bits) == ids).all()


def _brute(rows, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= 100 * cand[lang, w[i:i + m]]:
                    dropped.add((lang, w[i:i + m]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) in dropped:
            continue
        s = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((s[0], a, " ".join(w), f[lang, w[:s[1]]], f[lang, w[s[1]:]]))
    rows = []
    for lang, got in out.items():
        got.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        rows += [(lang, i + 1, t, a, left, r, n[lang], s) for i, (s, a, t, left, r) in enumerate(got[:top])]
    return sorted(rows)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 0) for i, (t, g) in enumerate(rows)],
                                 "doc_id long, text string, lang string, block string, f int")


def test_phrases_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" if i % 3 else f"Éa{i}" for i in range(30)]
    rows = [(None, "en"), ("", "en"), ("Lone", None), ("one two one two one two", None), (" .,\t;\n", "de")]
    for i in range(120):
        w = [words[int(x)] for x in rng.zipf(1.4, 40) % 30]
        sep = [" ", "  ", "\t", ". ", ", ", "\r\n", "!"]
        rows.append(("".join(a + sep[int(rng.choice(7, p=[.7, .1, .05, .05, .04, .03, .03]))] for a in w),
                     ["en", "de", None, "und"][i % 4]))
    rows += rows[:40]
    for least, top, block_words, shard_keys in ((2, 2000, 100, 64), (5, 7, 1 << 20, 1 << 20)):
        got = phrases.collocations(_docs(spark, rows).repartition(5), least=least, top=top, block_words=block_words,
                                   shard_keys=shard_keys)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == _brute(rows, least, top)


def test_scores_beyond_64_bits_are_exact(spark):
    found = spark.createDataFrame([([1], 10**12), ([2], 3 * 10**11), ([1, 2], 10**11 + 7)], "ids array<long>, f long")
    words = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "id long, lang string, word string")
    totals = spark.createDataFrame([("en", 10**13 + 1)], "lang string, n long")
    row = phrases.score(found, totals, words).first()
    assert row["score"] == 1000 * (10**11 + 7) * (10**13 + 1) // (10**12 * 3 * 10**11)


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    rows = [("a b c d e f " * 5, "en"), ("b c d", "en"), ("x a b", "fr")] * 3
    want = _brute(rows, 3)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "bit_table", lambda frequent, many: np.full(1 << 12, 255, np.uint8))
    assert sorted(map(tuple, phrases.collocations(_docs(spark, rows), least=3).collect())) == want


def test_tables_without_phrases(spark):
    for rows in ([], [("only once", "en")], [(None, None)]):
        assert phrases.collocations(_docs(spark, rows)).collect() == []


def test_a_long_text(spark):
    text = "alpha beta gamma " * 100_000
    got = phrases.collocations(_docs(spark, [(text, "en")])).collect()
    assert {r["phrase"]: r["a"] for r in got}["alpha beta gamma alpha beta"] == 99_999
