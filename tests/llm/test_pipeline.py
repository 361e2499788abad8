"""The registered queries and the pipeline on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from caseledger.llm import ngram_join, personal, pieces
from test_pairs import _brute_join

SF = E.SMOKE_DIR
WANT = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op5_pieces": ["doc_id", "n_tokens", "ids", "round_trip"],
    "op6_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op7_mix_sources": ["doc_id", "source", "epoch", "block", "position", "n_tokens"],
    "op8_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op9_nearest": ["query_id", "rank", "vec_id", "score"],
    "op10_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op13_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


def test_names():
    names = list(E._training_data()[0])
    assert sorted(names) == sorted([*WANT, "pipeline"])


@pytest.mark.parametrize("name", ["op2_language_id", "op3_toxicity", "op5_pieces", "op7_mix_sources", "op10_personal_data",
                                  "op11_vector_codes", "op12_token_counts", "op13_phrases"])
def test_query_columns(spark, name):
    out = E.queries()[name](spark, SF)
    assert out.columns[:len(WANT[name])] == WANT[name]
    table = {"op11_vector_codes": "embeddings", "op7_mix_sources": None, "op13_phrases": None}.get(name, "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != "pieces":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = at.collect(), out.collect()
        if name == "ngram_join":
            want = {c for _, _, c in _brute_join([(r["doc_id"], r["text"]) for r in before], 80, 5)}
            assert {r["doc_id"] for r in after} == want and len(after) == len(want)
        if name == "personal_data":
            assert len(before) == len(after)
            assert not any(personal.base_spans(r["text"]) for r in after)
        if name == "mixing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        if name == "pieces":
            v = pieces.load()
            texts = {r["doc_id"]: r["text"] for r in before}
            import numpy as np
            assert all(pieces.decode_ids(v, np.array(r["ids"])) == texts[r["doc_id"]] for r in after)
        seen.append((name, len(after)))
        at = out
    json.dumps(seen)


def test_stages_bear_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
                                  (2, "word " * 30_000, None, None, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES:
            at = ngram_join.materialize(stage(spark, at, SF))
        assert at.count() == (3 if rows is docs else 0)
        assert at.where(F.col("doc_id") == 2).count() == (1 if rows is docs else 0)
