"""Helpers shared by the operators: folds, bounded label samples, Arrow columns."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger.session import materialize

#: A row is held out when crc32 of its id as text leaves this remainder.
FOLDS = 5
HELD_OUT = 0


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows kept apart from learning. A null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers started later find this package where the
    driver did (on a cluster, ship it with ``--py-files`` as usual)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it
    (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_rows(df: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """At most about ``per_label`` rows of each label value (the bound holds in
    expectation), chosen by a hash of ``key``, so the choice is repeatable and
    needs no sort. Every row stays when a label has fewer. Null labels go. The
    counts of the label values are joined, however many there are."""
    df = df.where(F.col(label).isNotNull())
    n, = free_names(df, "_n")
    counts = materialize(df.groupBy(label).agg(F.count("*").alias(n)))  # its size is known, so a small one is broadcast
    part = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20))
    return df.join(counts, label).where(part * F.col(n) < per_label << 20).select(*df.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled rows outside the
    held-out fold. Only the sampled ids, whose number ``per_label`` bounds, are
    broadcast; documents are scanned once and not shuffled. A document with
    several label rows counts once, with the greatest label."""
    lab = (labels.where(~held_out("doc_id"))
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    ids = bounded_rows(lab, "_label", per_label)
    return (docs.select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id")
            .select("doc_id", "text", "_label"))


def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow text column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offs, dtype=np.int64, count=col.offset + n + 1)[col.offset:] \
        if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, max_bytes: int, max_rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text; a longer row is a range of
    its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n, i + max_rows)
        yield i, j
        i = j
