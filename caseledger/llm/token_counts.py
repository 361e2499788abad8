"""Token counts through a cache of digests.

A text is known by the SHA-256 of its content, a tokenizer by the SHA-256 of its
vocabulary file and library version. The cache is a Parquet table for each
tokenizer with a row (digest, n_tokens) a text ever counted. Counting joins the
digests of the documents with it; only distinct texts that it lacks are encoded,
and their counts are appended before the documents are joined with it again.

Texts move only where they are missing: each task sends a text once, texts of one
digest meet by hash, and the first of them is encoded. A byte-level tokenizer that
splits by the usual pattern counts each distinct word (with its blank) once a
process; texts with characters whose class may differ between Unicode versions,
or with an added token in them, go through the library whole.

Cases: a null text is an empty one and has no bytes and no tokens. Repeated texts
are encoded once and counted for every row; rows with equal or null ids are rows
of their own. Long texts are taken in stretches cut where the tokenizer's pattern
always splits; a stretch without blanks is never cut. An empty table leaves the
cache as it is. Columns to keep may have any name but the result's own. Appends
that were broken off leave nothing; two runs that append the same text leave equal
rows, which count once.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.session import materialize

#: So many missing digests (32 bytes each) at most are broadcast; beyond, texts meet them by hash.
BROADCAST_DIGESTS = 100_000
#: Missing digests of a task that encodes.
TASK_DIGESTS = 100_000
#: Digests a task remembers as sent, words a process remembers, characters taken at once.
SENT, WORDS, STRETCH = 200_000, 400_000, 1 << 20

# The byte-level split pattern for characters whose class no Unicode version changes.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = "\t-\r \x85\xa0"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_OTHER = re.compile("[^\x00-ɏ‐-‧]")
_CUT = re.compile(r"\S ")


class Tokenizer(NamedTuple):
    """A vocabulary file's content; it travels to the tasks, its path doesn't."""

    kind: str      # "tokenizers" or "sentencepiece"
    content: bytes
    digest: str


def load(path: str | Path) -> Tokenizer:
    """Read on the driver: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    kind = "sentencepiece" if str(path).endswith(".model") else "tokenizers"
    library = __import__(kind)
    content = Path(path).read_bytes()
    name = f"{kind} {library.__version__} ".encode()
    return Tokenizer(kind, content, hashlib.sha256(name + content).hexdigest())


def stretches(text: str) -> list[str]:
    """``text`` cut before blanks that follow another character, about every
    STRETCH characters."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        m = _CUT.search(text, at + STRETCH)
        if m is None:
            break
        out.append(text[at:m.start() + 1])
        at = m.start() + 1
    out.append(text[at:] if at else text)
    return out


def splits_by_pattern(spec: dict) -> bool:
    """Whether a tokenizers file splits texts by the byte-level pattern and does
    nothing else to them, so that words can be counted one by one."""
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"].get("type") == "BPE"
            and not any(a.get("lstrip") or a.get("rstrip") or " " in a["content"] for a in spec["added_tokens"]))


class Counter:
    """Token counts of texts, as the library gives them."""

    def __init__(self, tokenizer: Tokenizer):
        self.by_word, self.added = False, None
        if tokenizer.kind == "sentencepiece":
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.content)
            self.whole = lambda texts: [len(i) for i in model.encode(texts, num_threads=1)]
            return
        import os

        import tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        spec = json.loads(tokenizer.content)
        model = tokenizers.Tokenizer.from_str(tokenizer.content.decode())
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.by_word = splits_by_pattern(spec)
        if spec["added_tokens"]:
            self.added = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"]))
        self.known: dict[str, int] = {}

    def _words(self, text: str) -> int:
        words = _SPLIT.findall(text)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > WORDS:
                self.known.clear()
            new = list({w for w in words if w not in self.known})
            self.known.update(zip(new, self.whole(new)))
            return sum(map(self.known.__getitem__, words))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.whole([text])[0]
        total = 0
        for part in stretches(text):
            if _OTHER.search(part) or (self.added and self.added.search(part)):
                total += self.whole([part])[0]
            else:
                total += self._words(part)
        return total


@lru_cache(maxsize=2)
def _counter(tokenizer: Tokenizer) -> Counter:
    return Counter(tokenizer)


def _each_once(batches):
    """Each text once, as far as the task remembers what it sent."""
    sent: set[bytes] = set()
    for b in batches:
        keep = []
        for i, d in enumerate(b.column("digest").to_pylist()):
            if d not in sent:
                sent.add(d)
                keep.append(i)
        if len(sent) > SENT:
            sent.clear()
        yield b.take(pa.array(keep, pa.int64()))


def encode_distinct(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of (digest, content) rows that lie with all rows of
    their digest; of these the first is encoded."""
    def run(batches):
        count, done = _counter(tokenizer), set()
        for b in batches:
            digests, counts = [], []
            for i, d in enumerate(b.column("digest").to_pylist()):
                if d not in done:
                    done.add(d)
                    digests.append(d)
                    counts.append(count(b.column("content")[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())],
                                             ["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, CACHE)


CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def read_cache(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens), a row a text, of what the cache holds for a tokenizer."""
    path = f"{cache.rstrip('/')}/{tokenizer.digest}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, digests: DataFrame, cache: str, tokenizer: Tokenizer) -> int:
    """Append the counts of all texts that the cache lacks; returns their number.
    ``texts``: (digest, content); ``digests``: the digests of the same rows, stored."""
    spark = texts.sparkSession
    misses = digests.select("digest").distinct().join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    misses = materialize(misses)
    many = misses.count()
    if not many:
        return 0
    few = many <= BROADCAST_DIGESTS
    if few:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // TASK_DIGESTS))
    texts = texts.select("digest", "content")
    texts = texts.mapInArrow(_each_once, texts.schema).repartition(parts, "digest")
    if not few:
        texts = texts.join(misses.hint("shuffle_hash"), "digest", "left_semi")
    encode_distinct(texts, tokenizer).write.mode("append").parquet(f"{cache.rstrip('/')}/{tokenizer.digest}")
    return many


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8) and n_tokens of every row. ``cache``: a
    folder that driver and executors share."""
    content = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(*[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)], content.alias("content"))
    src = src.withColumn("digest", F.unhex(F.sha2("content", 256)))
    keys = materialize(src.withColumn("n_bytes", F.octet_length("content").cast("long")).drop("content"))
    fill_cache(src, keys, cache, tokenizer)
    counts = read_cache(docs.sparkSession, cache, tokenizer)
    return keys.join(counts, "digest").select(*[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)],
                                              "n_bytes", "n_tokens")
