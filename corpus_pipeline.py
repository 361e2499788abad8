"""The corpus pipeline: toxicity filter, near-duplicate removal, personal data,
source mixing, tokens.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger.llm import mixing, ngram_join, personal, pieces, toxicity
from caseledger.llm.common import free_names, read_table
from caseledger.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The model learns
    from the whole ``documents`` table's labelled rows outside the held-out fold."""
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    score, = free_names(docs, "_toxicity_score")
    scored = toxicity.score_toxicity(docs, model, score=score, spans=None)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word n-grams are similar by 0.8 or more, linked
    directly or through others, the one with the least id; all others stay."""
    return ngram_join.drop_similar(docs, percent=80, size=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their text."""
    return personal.redact(docs).withColumn("n_chars", F.length("text").cast("long")) \
        if "n_chars" in docs.columns else personal.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources up to MAX_EPOCHS times, at the
    exponent that this limit sets, in mixed blocks."""
    return mixing.apply(docs, mixing.plan(docs, repetitions=MAX_EPOCHS, whole_epochs=True))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every row."""
    out = pieces.encode(docs, pieces.load(), keep=("doc_id", "source"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


#: Epochs of any source in the mix.
MAX_EPOCHS = 1.5

STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: No SQL states a trained model's scores; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
