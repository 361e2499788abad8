"""Token counts through the cache."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseledger.llm import token_counts as C

JSON = C.load(public_tokenizers.path("byte_bpe_50k.json"))
COUNT = C.Counter(JSON)
_PIECES = st.sampled_from([*"ab A'ste \n\t\r.,é\xa0\x85ß²½’—漢😀\x1c  09_", "'ll", "'s", " the", "  ", "<|endoftext|>",
                           "hello", " world", "\r\n\r\n", "don't", " 123"])


@given(st.lists(_PIECES, max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_counts_by_word_are_the_librarys(text):
    want = COUNT.whole([text])[0] if text else 0
    assert COUNT(text) == want
    old, C.STRETCH = C.STRETCH, 4
    try:
        assert COUNT(text) == want
    finally:
        C.STRETCH = old


def test_long_texts_are_cut_where_the_pattern_splits():
    old, C.STRETCH = C.STRETCH, 1000
    try:
        for text in ("lorem ipsum  dolor\n sit " * 900, "x" * 5000 + " y" * 3000, "z" * 7000):
            parts = C.stretches(text)
            assert "".join(parts) == text and COUNT(text) == COUNT.whole([text])[0]
    finally:
        C.STRETCH = old


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, digest string, n_tokens int")


def _size(spark, cache, tokenizer=JSON):
    return C.read_cache(spark, cache, tokenizer).count()


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["one two", None, "", "one two", "three  four", "<|endoftext|>", "é" * 300] + ["copy of a text"] * 50
    docs = _docs(spark, texts).repartition(3)
    for _ in range(2):
        got = C.count_tokens(docs, JSON, cache)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
        want = [(i, len((t or "").encode()), COUNT.whole([t])[0] if t else 0) for i, t in enumerate(texts)]
        assert sorted(map(tuple, got.collect())) == want
        assert _size(spark, cache) == len({t or "" for t in texts})
        assert spark.read.parquet(f"{cache}/{JSON.digest}").count() == len({t or "" for t in texts})  # appended once
    # stored counts are used: a changed one shows, and nothing is encoded again
    fake = spark.createDataFrame([("a new text",)], "t string").select(
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.lit(99).cast("long").alias("n_tokens"))
    fake.write.mode("append").parquet(f"{cache}/{JSON.digest}")
    got = C.count_tokens(_docs(spark, ["a new text", "one two"]), JSON, cache, keep=("doc_id", "digest"))
    assert sorted(map(tuple, got.collect())) == [(0, "x", 10, 99), (1, "x", 7, 2)]


def test_many_misses_meet_by_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_DIGESTS", 0)
    texts = [f"text number {i % 40}" for i in range(200)]
    got = C.count_tokens(_docs(spark, texts).repartition(4), JSON, str(tmp_path / "c"))
    assert sorted(map(tuple, got.select("doc_id", "n_tokens").collect())) == \
        [(i, n) for i, n in enumerate(COUNT.whole(texts))]
    assert spark.read.parquet(f"{tmp_path}/c/{JSON.digest}").count() == 40


def test_rows_appended_twice_count_once(spark, tmp_path):
    cache = str(tmp_path / "c")
    C.count_tokens(_docs(spark, ["a", "b"]), JSON, cache)
    C.read_cache(spark, cache, JSON).write.mode("append").parquet(f"{cache}/{JSON.digest}")
    assert C.count_tokens(_docs(spark, ["a", "b", "a"]), JSON, cache).count() == 3


def test_an_empty_table(spark, tmp_path):
    assert C.count_tokens(_docs(spark, []), JSON, str(tmp_path / "c")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, tmp_path, name):
    tokenizer = C.load(public_tokenizers.path(name))
    assert tokenizer.digest != JSON.digest
    texts = ["Hello  World", "", None, "naïve café 漢字"]
    got = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(_docs(spark, texts), tokenizer, str(tmp_path)).collect()}
    count = C.Counter(tokenizer)
    assert got == {i: count.whole([t])[0] if t else 0 for i, t in enumerate(texts)}
