"""Phrases that occur more often than their parts suggest.

Words are counted with their language; those frequent enough get whole-number ids,
by joins. Texts become blocks of ids in which 0 stands for rarer words and breaks.
Then phrases of two words, three, and so on are counted: a phrase can be frequent
only where its first and last parts, one word shorter, are. Occurrences that pass
are packed, a few bits a word, and counted without loss in counting quotient
filters, which are cut into shards by their first bits and merged shard by shard.

Which shorter phrases are frequent travels as a bit table of bounded size; if there
are more than it can tell apart, more occurrences are counted, with the same result.
Shards are as many as the occurrences that can pass need, so a task merges a bounded
number of keys. Blocks, filters and tables of frequent phrases are stored.

Cases: null text is empty text, a null language ``und``. Only A to Z are put into
lower case. Repeated rows count each. A text longer than a block has a block of its
own. Ties: equal scores of cuts go to the shorter first part; equal scores of
phrases to the more frequent, then the lesser in byte order. An empty table, or one
without a frequent phrase, gives no rows. Only the text and language columns are
read, whatever others there are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm import quotient_filter as Q
from caseledger.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words a task holds before it closes a block, keys it holds before it sends them, occurrences a shard may hold.
BLOCK_WORDS, HELD_KEYS, SHARD_KEYS = 1 << 21, 1 << 21, 1 << 20
#: Bits of the table of frequent phrases for each of them, and the most there are.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Frequent words of a numbering bucket, about.
_BUCKET_WORDS = 1024

# A-Z to a-z, what ends a piece to a full stop, a tab to a blank.
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")

_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()),
                       T.StructField("sequence", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())),
                       T.StructField("counts", T.ArrayType(T.LongType()))])


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with a full stop where a piece ends."""
    return text.translate(_MAP).replace(b".", b" . ").split()


class _Block:
    """Texts of a language as numbers of their own words; 0 ends a piece."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."] = 0
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        words = words_of(text)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)
        return len(words)

    def row(self, block: int, lang: str) -> list:
        end = np.zeros(1, np.uint32)
        sequence = np.concatenate([x for t in self.texts for x in (t, end)])
        counts = np.bincount(sequence, minlength=len(self.numbers))[1:]
        words = [w.decode("utf-8", "replace") for w in self.numbers][1:]
        return [block, lang, sequence.tobytes(), words, counts]


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, sequence, words, counts): texts as numbers of a block's words."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, 0
        open_: defaultdict[str, _Block] = defaultdict(_Block)

        def close(name):
            nonlocal made
            row = open_.pop(name).row(base + made, name)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text")):
                held += open_[name].add(t.as_py())
                if held >= block_words:
                    largest = max(sorted(open_), key=lambda x: open_[x].size)
                    held -= open_[largest].size
                    yield close(largest)
        for name in sorted(open_):
            yield close(name)

    arrow = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("sequence", pa.binary()),
                       ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    return src.mapInArrow(run, _BLOCK)


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, f) with an id from 1 on, nearly without gaps: the
    place inside a bucket of bounded size, and the bucket."""
    buckets = max(1, words.count() // _BUCKET_WORDS)
    rows = words.withColumn("_b", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("lang", "word")) - 1
    return rows.withColumn("id", place.cast("long") * buckets + F.col("_b") + 1).drop("_b")


def sequences(packed: DataFrame, words: DataFrame) -> DataFrame:
    """(sequence): the blocks in ids of ``words`` (lang, word, id), 0 for others."""
    seen = packed.select("block", "lang", F.posexplode("words").alias("place", "word"))
    # the same plan at every size: words meet by hash
    known = seen.join(words.select("lang", "word", "id").hint("shuffle_hash"), ["lang", "word"], "left") \
        .select("block", "place", F.coalesce("id", F.lit(0)).alias("id")) \
        .groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))
    rows = packed.select("block", "sequence").join(known, "block").select("sequence", "places", "ids")

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                own = np.frombuffer(b.column("sequence")[i].as_py(), np.uint32)
                to = np.zeros(int(own.max(initial=0)) + 1, np.uint32)
                to[b.column("places")[i].values.to_numpy() + 1] = b.column("ids")[i].values.to_numpy()
                out = to[own]
                near = out != 0  # a lone word is in no phrase, and one 0 parts as well as many
                beside = np.zeros(len(out), bool)
                beside[1:] |= near[:-1]
                beside[:-1] |= near[1:]
                out = out[beside]
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sequence"])

    return rows.mapInArrow(run, "sequence binary")


def layout(size: int, bits: int) -> tuple[int, tuple[int, ...]]:
    """Words a limb holds, and the widths of the limbs of a phrase of ``size`` words."""
    each = max(1, 64 // bits)
    return each, tuple(bits * min(each, size - i) for i in range(0, size, each))


def pack(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, ...]:
    """Limbs of phrases, given by the ids of their first words, second words, ..."""
    each = max(1, 64 // bits)
    out = []
    for i in range(0, len(columns), each):
        limb = columns[i].astype(np.uint64)
        for c in columns[i + 1:i + each]:
            limb = (limb << np.uint64(bits)) | c.astype(np.uint64)
        out.append(limb)
    return tuple(out)


def unpack(limbs: tuple[np.ndarray, ...], size: int, bits: int) -> np.ndarray:
    """Ids [phrase, place]."""
    each = max(1, 64 // bits)
    mask = np.uint64((1 << bits) - 1)
    columns = []
    for i, limb in zip(range(0, size, each), limbs):
        n = min(each, size - i)
        columns += [(limb >> np.uint64(bits * (n - 1 - k))) & mask for k in range(n)]
    return np.stack(columns, 1).astype(np.int64)


def mark(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of phrases, for the bit table."""
    h = np.full(len(columns[0]), 1, np.uint64)
    for c in columns:
        h = Q.mixed(h ^ c.astype(np.uint64))
    return h


def _marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(len(table) * 8 - 1)
    out = np.ones(len(h), bool)
    for shift in (0, 32):
        at = (h >> np.uint64(shift)) & mask
        out &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bit_table(frequent: DataFrame, many: int) -> np.ndarray:
    """Bits of the marks of ``frequent``, of a size with a fixed upper bound, made
    in pieces of 4 KB by Spark."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (many * BITS_EACH - 1).bit_length()))
    at = F.explode(F.array(F.col("mark").bitwiseAND(F.lit(bits - 1)),
                           F.shiftrightunsigned("mark", 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    rows = frequent.select(at).groupBy(F.expr("at div 32768").alias("piece")) \
        .agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in rows:
        table[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


_COUNTED = "ids array<long>, f long, mark long"


def frequent_phrases(seqs: DataFrame, size: int, bits: int, occurrences: int, least: int,
                     shorter: np.ndarray | None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(ids, f, mark) of the phrases of ``size`` words with ``least`` occurrences.
    ``occurrences``: how many can pass at most; ``shorter``: bit table of the
    frequent phrases one word shorter."""
    _, widths = layout(size, bits)
    shards = min(widths[0], max(0, (occurrences // shard_keys).bit_length()))
    form = Q.Layout(widths, shards)

    def cut(entries):
        rows = Q.by_shard(entries, form)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"])

    def count(batches):
        held, many = [], 0
        for b in batches:
            for s in b.column("sequence"):
                ids = np.frombuffer(s.as_py(), np.uint32)
                n = max(0, len(ids) - size + 1)
                at = np.ones(n, bool)
                for k in range(size):
                    at &= ids[k:k + n] != 0
                if shorter is not None:
                    there = np.flatnonzero(at)  # the part that starts here, and the one that starts after
                    at[there] = _marked(shorter, mark([ids[there + k] for k in range(size - 1)])) \
                        & _marked(shorter, mark([ids[there + k] for k in range(1, size)]))
                at = np.flatnonzero(at)
                if len(at):
                    held.append(Q.count(pack([ids[at + k] for k in range(size)], bits), form))
                    many += len(held[-1].counts)
                if many > HELD_KEYS:
                    held = [Q.merge(held)]
                    many = len(held[0].counts)
                    if many > HELD_KEYS // 2:
                        yield cut(held[0])
                        held, many = [], 0
        if held:
            yield cut(Q.merge(held))

    def total(key, table):
        e = Q.merge([Q.decode(f.as_py(), form, key[0].as_py()) for f in table["filter"]])
        often = e.counts >= least
        limbs = Q.restore(tuple(x[often] for x in e.limbs), widths)
        ids = unpack(limbs, size, bits)
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size)
        return pa.table({"ids": pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), "f": e.counts[often],
                         "mark": mark(list(ids.T)).view(np.int64)})

    return seqs.mapInArrow(count, "shard long, filter binary").groupBy("shard").applyInArrow(total, _COUNTED)


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST,
                  least: int = LEAST, block_words: int = BLOCK_WORDS,
                  shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, f, id; totals: lang, n; phrases: ids, f), stored: all
    words and phrases of up to ``longest`` words that occur ``least`` times."""
    packed = materialize(blocks(docs, text, lang, block_words))
    counted = packed.select("lang", F.inline(F.arrays_zip("words", "counts"))).toDF("lang", "word", "f") \
        .groupBy("lang", "word").agg(F.sum("f").alias("f"))
    # each word of a block has a count, so a language's total is that of its blocks
    totals = materialize(packed.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
                         .groupBy("lang").agg(F.sum("n").alias("n")))
    words = materialize(numbered(materialize(counted.where(F.col("f") >= least))))
    found = words.select(F.array("id").alias("ids"), "f")
    top, occurrences = words.agg(F.max("id"), F.sum("f")).first()
    if top is None:
        return words, totals, found
    if top >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    bits = int(top).bit_length()
    seqs = materialize(sequences(packed, words))
    shorter = None
    for size in range(2, longest + 1):
        level = materialize(frequent_phrases(seqs, size, bits, occurrences, least, shorter, shard_keys))
        many, occurrences = level.agg(F.count("*"), F.sum("f")).first()
        if not many:
            break
        found = found.unionByName(level.select("ids", "f"))
        if size < longest:
            shorter = bit_table(level, many)
    return words, totals, found


def score(found: DataFrame, totals: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of every phrase, at its lowest-scoring cut."""
    size = F.size("ids")
    phrase = found.where(size > 1).withColumnRenamed("f", "a")
    cuts = phrase.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(found.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left") \
        .join(found.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    of = words.select(F.col("id").alias("_first"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("_first", F.get("ids", 0)).join(of, "_first")

    def exact(c):
        return f"cast({c} as decimal(18, 0))"
    value = F.expr(f"(cast(1000 as decimal(4, 0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    return cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("s")) \
        .select("lang", "ids", "a", "s.l", "s.r", "n", "s.score")


def parts_of_longer(found: DataFrame) -> DataFrame:
    """(ids, whole): phrases inside longer ones, and the greatest count of these."""
    size = F.size("ids")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda s: F.transform(
        F.sequence(F.lit(1), size - s + 1), lambda i: F.slice("ids", i, s))))
    return found.where(size > 2).select(F.explode(spans).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("whole"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 top: int = TOP, **sizes) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    words, totals, found = count_phrases(docs, text, lang, longest, least, **sizes)
    found = materialize(found)
    scored = score(found, totals, words).join(parts_of_longer(found), "ids", "left") \
        .where(F.col("whole").isNull() | (F.col("whole") < F.col("a"))).drop("whole")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    scored = materialize(scored.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank"))
    texts = scored.select("lang", "ids", F.posexplode("ids").alias("place", "id")) \
        .join(words.select("id", "word"), "id").groupBy("lang", "ids") \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), " ")
             .alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.join(texts, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long")) \
        .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
