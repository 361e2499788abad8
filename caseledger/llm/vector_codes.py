"""Vector codes: product quantisation over per-dimension value dictionaries.

Components become whole numbers, ``floor(scale * x)``. Rows are packed into blocks;
a block holds, for each dimension, the distinct numbers that occur in it and a code
for each row. To assign a part, the squared differences of every distinct number to
all codebook entries are tabulated once for each dimension; a row's distance to all
entries is then gathered from these tables by its codes and added up. Blocks are
stored once and serve all rounds.

A round returns counts and sums of parts for each entry, added up by Spark, so the
driver gets a table of the codebooks' size only. All arithmetic is in whole numbers.

Cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do those whose length ``parts`` does not divide or differs from that of
the least usable id, or with a number beyond what a 64-bit sum of squares holds (2^27
for 64 dimensions). Rows without an id are coded, but start no entry. Rows with
equal ids are rows of their own; of equal ids the lesser vector comes first. With
fewer rows than entries there are as many entries as rows. Null is a label of its
own. An empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block.
BLOCK_ROWS = 4096


class Coded(NamedTuple):
    rows: DataFrame        # (vec_id, label, code array<int>, error), stored
    codebooks: np.ndarray  # int64 [part, entry, position]


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v) of the vectors that take part, in whole numbers."""
    d = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    size = F.size(embedding)
    rows = vectors.where(F.coalesce((size > 0) & (size % parts == 0) & fine, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"),
                       F.transform(d, lambda x: x * F.lit(float(scale))).alias("x"))
    # the greatest difference squared, times the dimensions, stays under 2**63
    bound = F.pow(F.lit(2.0), F.floor((62 - F.ceil(F.log2(F.size("x").cast("double")))) / 2) - 1)
    small = F.forall("x", lambda x: F.abs(x) < bound)
    return rows.where(small).select("id", "label", F.transform("x", lambda x: F.floor(x)).alias("v"))


def dictionaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of each column one after the other, where each column's
    begin (and the last's end), and codes [column, row] into its own."""
    values, starts = [], [0]
    codes = np.empty(x.shape[::-1], np.int32)
    for d, column in enumerate(x.T):
        v, codes[d] = np.unique(column, return_inverse=True)
        values.append(v)
        starts.append(starts[-1] + len(v))
    return np.concatenate(values), np.array(starts, np.int64), codes


def assign(values: np.ndarray, starts: np.ndarray, codes: np.ndarray, codebooks: np.ndarray):
    """Nearest entry [part, row], the lower of equals, and its squared distance."""
    parts, entries, width = codebooks.shape
    n = codes.shape[1]
    best, distance = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), np.int64)
        for j in range(width):
            d = p * width + j
            table = np.square(values[starts[d]:starts[d + 1], None] - codebooks[p, None, :, j])
            total += table[codes[d]]
        best[p] = total.argmin(1)
        distance[p] = total[np.arange(n), best[p]]
    return best, distance


def entry_sums(values: np.ndarray, starts: np.ndarray, codes: np.ndarray, best: np.ndarray, shape: tuple) -> np.ndarray:
    """Counts (place 0) and sums of the assigned parts [part, entry, 1 + position]."""
    parts, entries, width = shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        out[p, :, 0] = np.bincount(best[p], minlength=entries)
        for j in range(width):
            d = p * width + j
            np.add.at(out[p, :, 1 + j], best[p], values[starts[d]:starts[d + 1]][codes[d]])
    return out


_BLOCK = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("values", T.BinaryType()),
          T.StructField("starts", T.BinaryType()), T.StructField("codes", T.BinaryType())]


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows packed with their dictionaries: (ids, values, starts, codes, labels)."""
    label = rows.schema["label"].dataType

    def run(batches):
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                values, starts, codes = dictionaries(x)
                ends = pa.array([0, len(part)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, part.column("id")),
                     *(pa.array([a.tobytes()], pa.binary()) for a in (values, starts, codes)),
                     pa.ListArray.from_arrays(ends, part.column("label"))],
                    ["ids", "values", "starts", "codes", "labels"])

    return rows.mapInArrow(run, T.StructType([*_BLOCK, T.StructField("labels", T.ArrayType(label))]))


def _unpacked(b: pa.RecordBatch):
    for i in range(len(b)):
        values, starts, codes = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in
                                 (("values", np.int64), ("starts", np.int64), ("codes", np.int32)))
        yield i, values, starts, codes.reshape(len(starts) - 1, -1)


def improve(packed: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts they are nearest to."""
    parts, entries, width = codebooks.shape

    def run(batches):
        sums = np.zeros((parts, entries, 1 + width), np.int64)
        for b in batches:
            for _, values, starts, codes in _unpacked(b):
                best, _ = assign(values, starts, codes, codebooks)
                sums += entry_sums(values, starts, codes, best, codebooks.shape)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["place", "total"])

    got = packed.select("values", "starts", "codes").mapInArrow(run, "place long, total long") \
        .groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros(parts * entries * (1 + width), np.int64)
    sums[got["place"].to_numpy()] = got["total"].to_numpy()
    sums = sums.reshape(parts, entries, 1 + width)
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), codebooks)


def encode(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every packed row."""
    kind = packed.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind),
                           T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches):
        for b in batches:
            for i, values, starts, codes in _unpacked(b):
                best, distance = assign(values, starts, codes, codebooks)
                n = best.shape[1]
                code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(best)),
                                                pa.array(best.T.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, code,
                                                  pa.array(distance.sum(0))], ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, schema)


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded:
    """Code all usable vectors; codebooks start as the parts of the rows of least id."""
    rows = materialize(whole_numbers(vectors, vec_id, embedding, label, parts, scale))
    least = rows.where(F.col("id").isNotNull()).orderBy("id", "v")
    first = least.select("v").first()
    dim = len(first["v"]) if first else parts
    start = [r["v"] for r in least.where(F.size("v") == dim).select("v").limit(entries).collect()]
    codebooks = np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    rows = rows.where(F.size("v") == dim) if start else rows.limit(0)
    packed = materialize(blocks(rows, dim))
    for _ in range(rounds if start else 0):
        codebooks = improve(packed, codebooks)
    return Coded(materialize(encode(packed, codebooks)), codebooks)


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """Of all entries' numbers by part, entry and position, in decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def digest(coded: Coded) -> DataFrame:
    """The report columns: code as hex text, errors of rows and of labels."""
    sums = coded.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.rows.join(sums, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", text.alias("code"), "error", "label_error",
        F.lit(codebooks_sha256(coded.codebooks)).alias("codebooks_sha256"))


def reconstruct(coded: Coded, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding): the vector that each code stands for."""
    books = coded.codebooks

    def run(batches):
        for b in batches:
            code = b.column("code").flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(books))
            x = books[np.arange(len(books)), code].reshape(len(b), -1) / scale
            ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                                             ["vec_id", "embedding"])

    return coded.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")
