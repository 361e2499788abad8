"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is the least in [0, 1] at which the weights' entropy is no more
than a target, or no source is repeated more often than a limit: found by
bisection, five halvings a Spark job, over the table of source totals. If even
exponent 1 misses the aim, 1 holds.

A source's budget is its weight times the token budget: some whole epochs and a
part of one. Each epoch is a permutation by hash. The mixed stream is a sequence
of blocks; each takes from every source its weight's share of the block's
tokens, in the order of the source's epochs, and permutes what it has taken.

Running totals are taken on three levels: inside buckets of bounded tokens, over
the buckets of a group, and over the totals of groups, so no task holds a whole
source. Blocks are of one size however large the input is.

Cases: null is a source of its own; a null or empty text counts as one token.
Rows with equal ids are rows of their own; rows that tie in an order's hash follow
by id and length. An empty table gives no rows. ``apply`` returns all columns
whatever their names.
DataFrame expressions only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseledger.session import materialize

#: Tokens of a mixed block. A bucket of a source's permutation holds what the
#: source gives to about one block.
BLOCK_TOKENS = 1 << 17
#: Buckets whose running totals one group holds; the groups' totals are summed apart.
BUCKET_GROUP = 4096
_HALVINGS, _JOBS = 5, 5


def source_key(source: Column) -> Column:
    """Null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, _s, n_tokens): words between white space, one at least."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("_s"),
                       F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)), F.lit(1)).cast("long")
                       .alias("n_tokens"))


def find_exponent(totals: DataFrame, budget: float, entropy: float | None = None,
                  repetitions: float | None = None, relative: bool = False) -> float:
    """Least exponent in [0, 1] that meets the aim. ``totals``: (_s, tokens).
    ``relative``: repetitions count against the source least repeated."""
    if (entropy is None) == (repetitions is None):
        raise ValueError("give either an entropy or a repetition limit")
    whole = totals.agg(F.sum("tokens")).first()[0]
    if not whole:
        return 1.0
    lo, hi, pieces = 0.0, 1.0, 2 ** _HALVINGS
    share = F.col("tokens") / F.lit(float(whole))
    for _ in range(_JOBS):
        width = (hi - lo) / pieces
        at = F.explode(F.array(*[F.lit(lo + width * i) for i in range(pieces + 1)]))
        rows = (totals.select(share.alias("share"), at.alias("a"))
                .select("a", F.pow("share", "a").alias("x"), F.pow("share", F.col("a") - 1).alias("r"),
                        (F.col("a") * F.log("share")).alias("lx"))
                .groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.col("lx")).alias("xl"),
                                  F.max("r").alias("r"), F.min("r").alias("r0")).collect())
        met = [r["a"] for r in rows
               if (math.log(r["z"]) - r["xl"] / r["z"] <= entropy + 1e-12 if entropy is not None
                   else (r["r"] / r["r0"] if relative else budget / whole * r["r"] / r["z"])
                   <= repetitions * (1 + 1e-12))]
        if not met:
            return 1.0
        hi = min(met)
        if hi <= lo:
            return hi
        lo = hi - width
    return hi


class Mix(NamedTuple):
    counts: DataFrame   # (doc_id, source, _s, n_tokens), stored
    sources: DataFrame  # a row a source: tokens, weight, epochs, rest, buckets; stored
    exponent: float
    budget: float
    block: float        # tokens of a block


def plan(docs: DataFrame, entropy: float | None = None, repetitions: float | None = None,
         budget: float | None = None, whole_epochs: bool = False, **names) -> Mix:
    """Weights and budgets of the sources. ``budget``: tokens to draw (the
    corpus's own number if None). With ``whole_epochs`` the budget is instead the
    least at which every source is drawn once in full, and ``repetitions`` limits
    the epochs of any source at that budget."""
    counts = materialize(token_counts(docs, **names))
    totals = materialize(counts.groupBy("_s").agg(F.sum("n_tokens").alias("tokens")))
    got = totals.agg(F.sum("tokens"), F.max("tokens")).first()
    whole, most = float(got[0] or 0), float(got[1] or 0)
    exponent = find_exponent(totals, budget or whole, entropy, repetitions, whole_epochs)
    raw = totals.withColumn("x", F.pow(F.col("tokens") / F.lit(whole or 1.0), F.lit(exponent)))
    z = raw.agg(F.sum("x")).first()[0] or 1.0
    if whole_epochs:  # the largest source is the least repeated: once
        budget = most * z / (most / whole) ** exponent if whole else 0.0
    budget = float(whole if budget is None else budget)
    block = float(BLOCK_TOKENS)
    quota = F.col("weight") * budget
    epochs = F.floor(quota / F.col("tokens") + 1e-9)
    sources = (raw.withColumn("weight", F.col("x") / z)
               .select("_s", "tokens", "weight", quota.alias("quota"), epochs.alias("epochs"),
                       F.greatest(quota - epochs * F.col("tokens"), F.lit(0.0)).alias("rest"),
                       F.ceil(F.col("tokens") / (F.col("weight") * block)).alias("buckets")))
    return Mix(counts, materialize(sources), exponent, budget, block)


def _place(doc_id: str, epoch: Column, seed: int) -> Column:
    """Place in an epoch's permutation, in [0, 1)."""
    return F.pmod(F.xxhash64(F.col(doc_id), epoch.cast("long"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def draw(mix: Mix, seed: int = 1) -> DataFrame:
    """The mixed stream: (doc_id, source, epoch, block, position, n_tokens, place).
    A part epoch ends before the document that would pass the source's budget."""
    rows = (mix.counts.join(mix.sources, "_s")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))))
    rows = rows.withColumn("place", _place("doc_id", F.col("epoch"), seed)) \
        .withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))
    rows = rows.where((F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0))
    sums = rows.groupBy("_s", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    sums = sums.withColumn("group", F.floor(F.col("bucket") / BUCKET_GROUP))
    groups = sums.groupBy("_s", "epoch", "group").agg(F.sum("t").alias("gt"))
    groups = groups.select("_s", "epoch", "group", (F.sum("gt").over(
        Window.partitionBy("_s", "epoch").orderBy("group")) - F.col("gt")).alias("first"))
    near = F.sum("t").over(Window.partitionBy("_s", "epoch", "group").orderBy("bucket")) - F.col("t")
    before = sums.withColumn("near", near).join(groups, ["_s", "epoch", "group"]) \
        .select("_s", "epoch", "bucket", (F.col("first") + F.col("near")).alias("before"))
    inside = Window.partitionBy("_s", "epoch", "bucket").orderBy("place", "doc_id", "n_tokens") \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("n_tokens").over(inside)).join(before, ["_s", "epoch", "bucket"])
    end = F.col("before") + F.col("end")
    rows = rows.where((F.col("epoch") < F.col("epochs")) | (end <= F.col("rest") + 1e-6))
    offset = F.col("epoch") * F.col("tokens") + end - F.col("n_tokens")
    rows = rows.withColumn("block", F.floor(offset / (F.col("weight") * mix.block)))
    order = Window.partitionBy("block").orderBy(F.xxhash64("doc_id", "epoch", "block", F.lit(seed)), "doc_id", "epoch")
    return rows.select("doc_id", "source", "epoch", "block", (F.row_number().over(order) - 1).alias("position"),
                       "n_tokens", "place", "_s")


def blocked(docs: DataFrame, mix: Mix, seed: int = 1, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, each whole as the struct
    _mix_row, with _mix_id, _mix_epoch and _mix_block. A row finds its epochs from a small table of sources: the place at
    which the part epoch ends. Its block is the drawn one, from a table of the
    places at which blocks start in each bucket of an epoch; rows of equal ids
    share a place, and so the last block drawn for it."""
    drawn = materialize(draw(mix, seed).select("_s", "epoch", "block", "place"))
    ends = drawn.join(mix.sources.select("_s", "epochs"), "_s").where(F.col("epoch") == F.col("epochs")) \
        .groupBy("_s").agg(F.max("place").alias("_end"))
    small = materialize(mix.sources.join(ends, "_s", "left")
                        .select(F.col("_s").alias("_mix_s"), F.struct("epochs", "buckets",
                                                                      F.coalesce("_end", F.lit(-1.0)).alias("end")).alias("_mix")))
    starts = (drawn.join(mix.sources.select("_s", "buckets"), "_s")
              .groupBy("_s", "epoch", F.floor(F.col("place") * F.col("buckets")).alias("bucket"), "block")
              .agg(F.min("place").alias("place"))
              .groupBy("_s", "epoch", "bucket").agg(F.collect_list(F.struct("place", "block")).alias("_mix_starts")))
    starts = materialize(starts).toDF("_mix_s", "_mix_epoch", "_mix_bucket", "_mix_starts")
    # the given columns travel in a struct, so their names are free
    rows = docs.select(F.struct("*").alias("_mix_row"), F.col(doc_id).alias("_mix_id"),
                       source_key(F.col(source)).alias("_mix_s")).join(small, "_mix_s")
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix.epochs")))) \
        .withColumn("_mix_place", _place("_mix_id", F.col("_mix_epoch"), seed))
    rows = rows.where((F.col("_mix_epoch") < F.col("_mix.epochs")) | (F.col("_mix_place") <= F.col("_mix.end"))) \
        .withColumn("_mix_bucket", F.floor(F.col("_mix_place") * F.col("_mix.buckets")))
    rows = rows.join(starts, ["_mix_s", "_mix_epoch", "_mix_bucket"])
    block = F.array_max(F.filter("_mix_starts", lambda x: x["place"] <= F.col("_mix_place")))["block"]
    return rows.select("_mix_row", "_mix_id", "_mix_epoch", block.alias("_mix_block"))


def apply(docs: DataFrame, mix: Mix, seed: int = 1, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, written block by block, in
    a permuted order inside each block."""
    rows = blocked(docs, mix, seed, doc_id, source) \
        .withColumn("_mix_order", F.xxhash64("_mix_id", "_mix_epoch", "_mix_block", F.lit(seed)))
    return rows.repartition("_mix_block").sortWithinPartitions("_mix_block", "_mix_order").select("_mix_row.*")
