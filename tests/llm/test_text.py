"""Word hashing, quality, language and toxicity."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseledger.llm import language, quality, toxicity
from caseledger.llm.common import bounded_rows, held_out, row_blocks, texts_of
from caseledger.llm.textvec import NOT_WORD, SPACE, word_blocks

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n.!x", max_size=30)), max_size=8)


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_split(texts, block):
    data, off = texts_of(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    hashes = {}
    for w in word_blocks(data, off, SPACE, block):
        for s, e, r, h in zip(w.start, w.end, w.row, w.hash):
            word = bytes(w.data[s:e]).lower()
            got[w.first + r].append(word)
            assert hashes.setdefault(word, h) == h  # the same wherever it stands
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_columns_and_long_texts():
    col = pa.array(["zz", "a b", None, "c " * 5000])[1:]
    data, off = texts_of(col)
    assert [bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:])] == ["a b", "", "c " * 5000]
    assert list(row_blocks(off, 100)) == [(0, 2), (2, 3)]


def test_held_out_and_bounded_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    import zlib
    want = {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r[0] for r in df.where(held_out()).collect()} == want
    few = bounded_rows(df, "y", 200)
    n = few.groupBy("y").count().collect()
    assert all(120 < r["count"] < 300 for r in n) and len(n) == 2
    assert bounded_rows(df, "y", 10_000).count() == 5000
    null = spark.createDataFrame([(None, 1)], "doc_id long, y int")
    assert null.where(held_out()).count() == 1


# --------------------------------------------------------------- language --

def _corpus(spark):
    en = "the cat and the dog went to the house with the other one"
    de = "der hund und die katze gingen zu dem haus mit der anderen"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s", 1) for i in range(200)]
    rows += [(900, None, "en", "s", 1), (901, "", None, None, 1), (902, "12 34 !", "de", "s", 1),
             (903, "the house", None, "s", 1), (903, "the house", None, "s", 1), (None, "und die katze", "de", "s", 1),
             (904, "the dog " * 30_000, None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def _plain_profile(texts, top):
    from collections import Counter
    c = Counter()
    for t in texts:
        for w in "".join(ch if ch.isalpha() else " " for ch in t.lower()).split():
            p = f" {w} "
            c.update(w)
            c.update(p[i:i + 2] for i in range(len(p) - 1))
            c.update(p[i:i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(ch) << 16 * (len(g) - 1 - i) for i, ch in enumerate(g))
    return [g for g, _ in sorted(c.items(), key=lambda kv: (-kv[1], code(kv[0])))][:top]


def test_grams_against_plain_counts():
    texts = ["Ab, ab é", "x", "a\0b"]
    row, code, count = language.gram_counts(texts)
    r, c, rank = language.rank_grams(row, code, count, 3, 300)
    for i, t in enumerate(texts):
        want = _plain_profile([t], 300)
        got = [int(x) for x in c[r == i]]
        assert got == [sum(ord(ch) << 16 * (len(g) - 1 - k) for k, ch in enumerate(g)) for g in want]


def test_language_cases(spark):
    docs = _corpus(spark)
    profiles = language.learn_profiles(docs)
    assert profiles.languages == ["de", "en"]
    got = {(r["doc_id"]): r for r in language.identify(docs, profiles).collect()}
    assert len(got) == 206 and got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] == "en" and got[904]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.learn_profiles(docs.limit(0))
    assert {r[0] for r in language.identify(docs, none).select("lang_pred").collect()} == {"und"}
    assert language.identify(docs.limit(0), profiles).count() == 0


# --------------------------------------------------------------- toxicity --

def _bags(texts):
    keys = pa.table({"text": pa.array(texts, pa.string()), "_label": pa.array([0] * len(texts), pa.int32()),
                     "doc_id": pa.array(range(len(texts)), pa.int64())})
    b = next(toxicity._bags(keys.to_batches()))
    return [np.frombuffer(k.as_py(), np.uint64) for k in b["keys"]], b["n"].to_numpy()


def test_noisy_or_finds_the_sentence():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        y = int(i % 4 == 0)
        if y:
            s[rng.integers(6)] += " rotten fellow"
        texts.append(". ".join(s) + ".")
        labels.append(y)
    bags, rows = _bags(texts)
    model = toxicity.train_bags(bags, rows, np.array(labels))
    text = "A fine day. You Rotten fellow, w3! Then w4 again"
    score, spans = toxicity._score(pa.array([text, "", None, "w1 w2. w3"]), model, True)
    assert score[0] > 0.5 and score[1] == score[2] == 0 and score[3] < 0.5
    assert [text[s["start"]:s["end"]] for s in spans[0]] == ["You Rotten fellow, w3"]
    assert spans[1:] == [[], [], []]


def test_score_is_the_noisy_or_of_sentences():
    w = np.zeros(1 << toxicity.BITS, np.float32)
    bags, _ = _bags(["bad", "worse"])
    for b, x in zip(bags, (3.0, 5.0)):
        w[int(b[0]) & ((1 << toxicity.BITS) - 1)] = x
    score, _ = toxicity._score(pa.array(["bad bad. worse ok\nfine"]), toxicity.Model(-4.0, w), False)
    p = [1 / (1 + np.exp(-z)) for z in (-1.0, 1.0, -4.0)]
    assert score[0] == pytest.approx(1 - np.prod([1 - x for x in p]))


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b. c", None)],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    out = toxicity.score_toxicity(docs, model, score="_s")
    assert out.columns == ["doc_id", "text", "score", "_s", "sentences"] and out.count() == 4
    assert toxicity.score_toxicity(docs.limit(0), model, keep=("doc_id",)).count() == 0


# ---------------------------------------------------------------- quality --

def test_context_sums_against_plain_loop():
    texts = ["a b a c", None, "B b! b!", "x"]
    index = quality.index_vectors()
    table = np.zeros((quality.WORDS + quality.SHAPES, quality.DIM), np.int64)
    data, off = texts_of(pa.array(texts))
    for w in word_blocks(data, off):
        word, shape = quality.buckets(w)
        for i in range(len(word)):
            for j in range(len(word)):
                if i != j and abs(i - j) <= quality.WINDOW and w.row[i] == w.row[j]:
                    for c in (word[i], shape[i]):
                        table[c] += index[word[j]] + index[shape[j]]
    got = np.zeros_like(table)
    for b in quality.context_sums(pa.table({"t": pa.array(texts)}).to_batches()):
        for r in b.to_pylist():
            got[r["bucket"]] = [r[f"c{k}"] for k in range(quality.DIM)]
    assert (got == table).all()


def test_quality_learns_and_handles_cases(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ne", "ru", "st", "vi")]
    rows, labels = [], []
    for i in range(300):
        good = " ".join(rng.choice(words, 60))
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in good.split()) if bad else good))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "ka lo"), (1002, "kane " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab)
    out = quality.score_quality(docs, model).join(lab, "doc_id", "left").collect()
    assert len(out) == 305 + 1 or len(out) == 305
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["quality"] is not None:
            assert (r["score"] >= 0.5) == (r["quality"] == 1)
    flat = quality.train(docs, lab.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, flat).collect()} == {0.5}


def test_temperature_lowers_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.FEATURES)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    apart = np.arange(400) % 4 == 0
    net = quality.train_network(x, y, np.ones(400), apart, epochs=15)
    z = quality.logits(net, x[apart])
    assert quality._loss(z / net.temperature, y[apart], np.ones(100)) <= quality._loss(z, y[apart], np.ones(100)) + 1e-3


def test_quality_keeps_columns_of_any_name(spark):
    rows = [(1, "a plain text of some words", "x"), (2, None, None), (3, "", "y"), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality_text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.train(docs, labels), keep=("doc_id", "_quality_text")).collect()
    assert sorted((r["doc_id"], r["_quality_text"], r["score"]) for r in got) == [
        (1, "x", 0.5), (2, None, 0.5), (3, "y", 0.5), (3, "y", 0.5)]
    assert quality.score_quality(docs.limit(0), quality.train(docs, labels)).count() == 0
