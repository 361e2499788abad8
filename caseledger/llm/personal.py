"""Personal data: fixed kinds by pattern, more by bootstrapped contexts.

Base spans (email, ip, card, phone) follow fixed grammars. They are seeds: the
words beside them, with the coarse form of the entity, are lexical patterns. A
bipartite graph of patterns and entities is scored in turn: a pattern's
confidence in a kind is the share of its distinct entities known to be of the
kind; an entity that no grammar covers is known once the noisy-or of its
confident patterns is high. Occurrences of confident patterns whose entity no
grammar covers are the discovered spans.

Cases: null text is empty text, with no spans. Positions are code points, end
exclusive. Kinds may overlap; within a kind base spans don't. Rows with the same
id are told apart by their text. Copies add no confidence: a pattern counts
distinct entities. Long texts are scanned in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm.common import free_names
from caseledger.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct known entities of a kind, and this share of all it holds.
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
#: An entity is known when its patterns' noisy-or reaches this.
MIN_ENTITY = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts inside a run of digits would have started with the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SIGNS = _LOCAL | {"@"}
_PIECE = re.compile(r"[A-Za-z0-9@._%+-]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four grammars, by kind as listed and then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def tokens_like_identifiers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of ASCII letters, digits and signs of addresses that hold a digit or
    an @, of any length, without the stops around them."""
    done = 0
    m = _MARK.search(text)
    while m:
        a = m.start()
        while a > done and text[a - 1] in _SIGNS:
            a -= 1
        done = b = _PIECE.match(text, m.start()).end()
        while text[a] == ".":
            a += 1
        while text[b - 1] == ".":
            b -= 1
        yield a, b
        m = _MARK.search(text, done)


def form(entity: str) -> str:
    """Coarse form of an entity: address, number or mixed."""
    if "@" in entity:
        return "address"
    digits = sum(c in "0123456789" for c in entity)
    letters = sum(c.isalpha() for c in entity)
    return "number" if not letters and digits else "mixed"


def _words(text: str, start: int, end: int, n: int, last: bool) -> list[str]:
    """The first or last ``n`` words of a stretch, each of them whole, read from a
    window that grows until it holds a further word or all of the stretch."""
    size = 64
    while True:
        lo, hi = (max(start, end - size), end) if last else (start, min(end, start + size))
        got = text[lo:hi].split()
        if len(got) > n or (lo, hi) == (start, end):
            return got[-n:] if last else got[:n]
        size *= 4


class Contexts:
    """Words beside the spans of a text. Words end at blanks and at the borders of
    other spans, so the work is in proportion to the text, however many spans
    stand in one run. Overlapping spans share a context."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)
        self.left: dict[int, list[str]] = {}
        self.right: dict[int, list[str]] = {}

    def beside(self, start: int) -> tuple[list[str], list[str]]:
        """At most two words before and one after the span that starts there."""
        i = bisect_right(self.starts, start) - 1
        if i not in self.left:
            self.left[i], self.right[i] = self._before(i, 2), self._after(i)
        return self.left[i], self.right[i]

    def _before(self, i: int, n: int) -> list[str]:
        words: list[str] = []
        end = self.starts[i]
        while i >= 0 and len(words) < n:
            gap = self.ends[i - 1] if i else 0
            words = _words(self.text, gap, end, n - len(words), True) + words
            i -= 1
            if i >= 0 and len(words) < n:
                words = _words(self.text, self.starts[i], self.ends[i], n - len(words), True) + words
                end = self.starts[i]
        return [_word(w) for w in words]

    def _after(self, i: int) -> list[str]:
        last = i + 1 == len(self.starts)
        words = _words(self.text, self.ends[i], len(self.text) if last else self.starts[i + 1], 1, False)
        if not words and not last:
            words = _words(self.text, self.starts[i + 1], self.ends[i + 1], 1, False)
        return [_word(w) for w in words]


def _word(word: str) -> str:
    """A word in lower case; a digest of the whole stands for one of more than 64
    characters, with its last character, so patterns stay short."""
    word = word.lower()
    return word if len(word) <= 64 else f"<{entity_key(word) & 0xFFFFFFFFFFFFFFFF:016x}>{word[-1]}"


def patterns(text: str, start: int, end: int, contexts: Contexts | None = None) -> list[str]:
    """Lexical patterns of a span: the two words before it, the word before and
    after, each with the entity's form. Fewer at the borders of a text."""
    kind = form(text[start:end])
    left, right = (contexts or Contexts(text, [(start, end)])).beside(start)
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} <{kind}>")
    if left and right:
        out.append(f"{left[-1]} <{kind}> {right[0]}")
    if left and not left[-1][-1].isalnum():  # a label such as "id:" or "tel."
        out.append(f"{left[-1]} <{kind}>")
    return out


def entity_key(entity: str) -> int:
    """Stable 64-bit key of an entity."""
    return int.from_bytes(hashlib.blake2b(entity.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType())])
_SEEN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType()), T.StructField("entity", T.LongType()),
                      T.StructField("patterns", T.ArrayType(T.StringType()))])
_PA_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_PA_SEEN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("entity", pa.int64()), ("patterns", pa.list_(pa.string()))]))


def observe(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans of a text, and what the graph learns from it: base spans and
    other identifier-like tokens with their patterns."""
    spans = base_spans(text)
    seen = [(k, a, b) for k, a, b in spans]
    covered = sorted((a, b) for _, a, b in spans)
    i = reach = 0
    for a, b in tokens_like_identifiers(text):
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if a >= reach:
            seen.append((None, a, b))
    contexts = Contexts(text, [(a, b) for _, a, b in seen])
    return ([{"kind": k, "start": a, "end": b} for k, a, b in spans],
            [{"kind": k, "start": a, "end": b, "entity": entity_key(text[a:b].lower()), "patterns": patterns(text, a, b, contexts)}
             for k, a, b in seen])


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def extract(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, spans, seen) of every row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    kind = T.StructType([src.schema["doc_id"], T.StructField("text_key", T.LongType()),
                         T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("seen", T.ArrayType(_SEEN))])

    def run(batches):
        for b in batches:
            got = [observe(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array([g[0] for g in got], _PA_SPAN),
                 pa.array([g[1] for g in got], _PA_SEEN)], ["doc_id", "text_key", "spans", "seen"])

    return src.mapInArrow(run, kind)


def confident_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) after scoring the graph of patterns and
    entities until no new pattern or entity is found. ``seen``: (kind or null,
    entity, patterns)."""
    edges = materialize(seen.select("entity", "kind", F.explode("patterns").alias("pattern"))
                        .groupBy("pattern", "entity").agg(F.min("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = edges.where(F.col("kind").isNotNull()).select("entity", "kind").distinct() \
        .groupBy("entity").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    met = None  # all that was ever found, so that the rounds end
    while True:
        support = (edges.drop("kind").join(known, "entity").groupBy("pattern", "kind")
                   .agg(F.sum("score").alias("s"), F.count("*").alias("support")))
        found = materialize(support.where(F.col("support") >= MIN_SUPPORT).join(sizes, "pattern")
                            .withColumn("confidence", F.col("s") / F.col("n"))
                            .where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "kind", "confidence"))
        fresh = (edges.where(F.col("kind").isNull()).drop("kind").join(found, "pattern")
                 .groupBy("entity", "kind")
                 .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
                 .where(F.col("score") >= MIN_ENTITY)
                 .groupBy("entity").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"),
                                        F.max("score").alias("score")))
        fresh = materialize(fresh)
        now = found.select(F.lit("pattern").alias("what"), F.col("pattern").alias("name"), "kind").unionByName(
            fresh.select(F.lit("entity").alias("what"), F.col("entity").cast("string").alias("name"), "kind"))
        new = materialize(now if met is None else now.join(met, ["what", "name", "kind"], "left_anti"))
        if new.isEmpty():
            return found
        met = new if met is None else met.unionByName(new)
        known = edges.where(F.col("kind").isNotNull()).groupBy("entity").agg(F.min("kind").alias("kind")) \
            .withColumn("score", F.lit(1.0)).unionByName(fresh.join(
                edges.where(F.col("kind").isNotNull()).select("entity").distinct(), "entity", "left_anti"))


def discover(extracted: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_key, learned): the spans of each row that confident patterns
    add, by kind and start."""
    seen = (extracted.select("doc_id", "text_key", F.explode("seen").alias("o")).where("o.kind IS NULL")
            .select("doc_id", "text_key", "o.start", "o.end", F.explode("o.patterns").alias("pattern")))
    best = (seen.join(found, "pattern").groupBy("doc_id", "text_key", "start", "end")
            .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))
    return best.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("learned"))


def _ordered(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("r"), s["start"].alias("start"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, spans, learned) of every row of ``docs``: base spans
    and those that bootstrapping adds."""
    extracted = materialize(extract(docs, text, doc_id))
    seen = extracted.select(F.explode("seen").alias("o")).select("o.kind", "o.entity", "o.patterns")
    learned = _renamed(discover(extracted, confident_patterns(seen)))
    same = F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (F.col("text_key") == F.col("_pii_key"))
    return extracted.join(learned, same, "left").select(
        "doc_id", "text_key", "spans", F.coalesce("_pii_spans", F.array().cast(T.ArrayType(_SPAN))).alias("learned"))


def _renamed(learned: DataFrame) -> DataFrame:
    return learned.toDF("_pii_id", "_pii_key", "_pii_spans")


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``find_personal``'s rows."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS),
                        F.sha2(_ordered(F.col("spans")), 256).alias("base_sha256"),
                        _ordered(F.concat("spans", "learned")).alias("spans"),
                        F.size("learned").cast("long").alias("n_learned"))


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its
    (first) kind in capitals and brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all personal data, base and learned, masked in ``text``.
    Only rows that have learned spans bring any to the join; base spans are found
    again in place, so no text is stored or shuffled unless Spark finds the
    learned spans too large to broadcast."""
    extracted = materialize(extract(docs, text, doc_id).select("doc_id", "text_key", "seen"))
    seen = extracted.select(F.explode("seen").alias("o")).select("o.kind", "o.entity", "o.patterns")
    learned = materialize(_renamed(discover(extracted, confident_patterns(seen))))
    names = docs.columns
    row, spans = free_names(docs, "_row", "_spans")
    src = docs.select(F.struct("*").alias(row), F.col(doc_id).alias("_pii_doc"), text_key(text).alias("_pii_text_key"))
    src = src.join(learned.withColumnRenamed("_pii_spans", spans),
                   F.col("_pii_doc").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_text_key") == F.col("_pii_key")),
                   "left").select(f"{row}.*", spans)

    def run(batches):
        at = names.index(text)
        for b in batches:
            new = []
            for t, extra in zip(b.column(at), b.column(len(names))):
                t = t.as_py()
                if t is not None:
                    spans = base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in extra.as_py() or []]
                    t = mask(t, spans) if spans else t
                new.append(t)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(new, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, docs.schema)
