"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary file's pieces are a byte trie in two arrays. All positions of a
block of texts walk it at once, which yields every piece that fits; then the best
score of each position is found from left to right, over all chunks of the block
together; a chunk of more than a few thousand bytes by itself. A chunk is a run of blanks and what follows up to the next blank: no
piece has a blank after another character, so chunks are independent, and equal
chunks of a block are solved once.

A character that no piece starts with costs more than any piece and becomes its
UTF-8 bytes. Blanks are the pieces' white-space marker, one is put before the text
and taken off in decoding. A marker character in a text itself becomes bytes, so
decoding gives back every text exactly.

A file of merge ranks instead of log scores (whole numbers) is read as a distribution over the ranks.

Cases: null gives null ids, an empty text no ids. Of equal scores the longer last
piece wins. Repeated rows are encoded each; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm.common import row_blocks, texts_of
from caseledger.llm.textvec import span_hash

#: Vocabulary file, a parameter; the file is read on the driver only.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Text that is encoded at once, and rows that are decoded at once.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 512
#: A chunk of more bytes is solved by itself, so many bytes of matches at a time.
LONG_CHUNK, WINDOW = 2048, 1 << 16


class Vocabulary(NamedTuple):
    pieces: list[bytes]   # text of each id as bytes; empty for control ids
    base: np.ndarray      # double array: child of s by byte c is base[s] + c ...
    check: np.ndarray     # ... if check there is s
    value: np.ndarray     # id of the piece that ends at a state, or -1
    scores: np.ndarray    # of each id
    bytes_ids: np.ndarray  # id of each byte
    unknown: float


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value of a trie. A node's children lie at its base plus
    their byte; bases are given out level by level, about first fit."""
    root: dict = {}
    for key, value in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    base, check, value = [0], [0], [-1]
    free = dense = 257  # no free place that any byte reaches below ``free``; few for several children below ``dense``
    queue = [(root, 0)]
    for node, state in queue:
        if -1 in node:
            value[state] = node[-1]
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        while free < len(check) and check[free] >= 0:
            free += 1
        at = max(1, (free if len(children) == 1 else dense) - children[0])
        while True:
            if at + 256 >= len(check):
                base += [0] * 4096
                check += [-1] * 4096
                value += [-1] * 4096
            if all(check[at + c] < 0 for c in children):
                break
            at += 1
        if len(children) > 1:
            dense = max(dense, at + children[0] - 64)
        base[state] = at
        for c in children:
            check[at + c] = state
            queue.append((node[c], at + c))
    spare = [0] * 256  # any state may be asked for any byte
    base, check, value = base + spare, check + [-1] * 256, value + [-1] * 256
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def vocabulary(pieces: list[tuple[str, float, str]]) -> Vocabulary:
    """From (text, score, kind) by id; kinds are normal, byte and control."""
    normal = [i for i, p in enumerate(pieces) if p[2] == "normal"]
    scores = np.array([p[1] for p in pieces], np.float64)
    if len(normal) and (scores[normal] == np.round(scores[normal])).all():
        ranks = np.argsort(np.argsort(-scores[normal], kind="stable"), kind="stable")
        scores[normal] = -np.log(ranks + 1) - np.log((1 / (np.arange(len(normal)) + 1)).sum())
    texts = [b""] * len(pieces)
    byte_ids = np.full(256, -1, np.int32)
    keys = {}
    for i, (text, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_ids[int(text[1:-1], 16)] = i
            texts[i] = bytes([int(text[1:-1], 16)])
        elif kind == "normal" and text:
            head = len(text) - len(text.lstrip(MARKER))
            if MARKER in text[head:]:
                raise ValueError(f"piece {text!r} has a blank after another character")
            texts[i] = keys_of = text.replace(MARKER, " ").encode()
            keys[keys_of] = i
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    base, check, value = double_array(keys)
    least = scores[normal].min() if len(normal) else 0.0
    return Vocabulary(texts, base, check, value, scores, byte_ids, float(least - UNKNOWN_PENALTY))


def load(path: str | Path = VOCABULARY) -> Vocabulary:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    return vocabulary([(sp.id_to_piece(i), sp.get_score(i), "byte" if sp.is_byte(i) else
                        "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal")
                       for i in range(sp.vocab_size())])


def matches(v: Vocabulary, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of every piece at every character of ``data``; ``end``:
    where the chunk of each byte ends. Characters without a piece of their own
    have one of id -1."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    length = np.ones(len(heads), np.int64)
    lead = data[heads]
    length += (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    single = np.zeros(len(heads), bool)
    at, state, depth = np.arange(len(heads)), np.zeros(len(heads), np.int64), 0
    starts, ends, ids = [], [], []
    while len(at):
        to = v.base[state] + data[heads[at] + depth]
        ok = v.check[to] == state
        at, state = at[ok], to[ok]
        depth += 1
        found = v.value[state]
        hit = found >= 0
        starts.append(heads[at[hit]])
        ends.append(heads[at[hit]] + depth)
        ids.append(found[hit])
        whole = at[hit]
        single[whole[length[whole] == depth]] = True
        more = heads[at] + depth < end[heads[at]]
        at, state = at[more], state[more]
    lone = ~single
    starts.append(heads[lone])
    ends.append(np.minimum(heads[lone] + length[lone], end[heads[lone]]))
    ids.append(np.full(int(lone.sum()), -1, np.int32))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def _solve_together(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Id of the best piece that starts at each byte (-1 for none) of the chunks
    ``data[start:end]``, which follow each other without gaps: one step for each
    place in the longest chunk, all chunks at once."""
    n, long = len(data), end - start
    a, b, piece = matches(v, data, np.repeat(end, long))
    score = np.where(piece >= 0, v.scores[piece], v.unknown)
    # by place of the end within its chunk, then by end, then longest first
    where = b - np.repeat(start, long)[a]
    top = (int(where.max(initial=0)) + 1) * (n + 1)
    order = np.argsort((where * (n + 1) + b) * 64 + 63 - np.minimum(b - a, 63)) if top < 1 << 56 \
        else np.lexsort((a, b, where))
    a, b, piece, score, where = a[order], b[order], piece[order], score[order], where[order]
    best = np.full(n + 1, -np.inf)  # of the text before each position; a chunk's start is 0
    from_, by = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    first = np.zeros(n + 1, bool)
    first[start] = True
    steps = np.searchsorted(where, np.arange(1, int(long.max(initial=0)) + 2))
    for lo, hi in zip(steps[:-1], steps[1:]):
        if lo == hi:
            continue
        s, e = a[lo:hi], b[lo:hi]
        total = np.where(first[s], 0.0, best[s]) + score[lo:hi]
        head = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        top = np.maximum.reduceat(total, head)
        at = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[head, len(e)])))
        at = at[np.r_[True, e[at][1:] != e[at][:-1]]]
        best[e[at]], from_[e[at]], by[e[at]] = top, s[at], piece[lo:hi][at]
    out = np.full(n, -1, np.int64)  # id of the piece that starts at each byte
    pos, left = end.copy(), start
    while len(pos):
        s, p = from_[pos], by[pos]
        out[s[p >= 0]] = p[p >= 0]
        for i, j in zip(s[p < 0], pos[p < 0]):
            out[i:j] = v.bytes_ids[data[i:j]]
        going = s > left
        pos, left = s[going], left[going]
    return out


def _solve_alone(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The same for one long chunk: matches of a window at a time, each taken once,
    from left to right."""
    n, reach = len(data), max(4, max(map(len, v.pieces)))
    length, by = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    best = [0.0] + [-np.inf] * reach  # from the window's begin on
    for at in range(0, n, WINDOW):
        d = data[at:at + WINDOW + reach]
        best += [-np.inf] * (len(d) + 1 - len(best))
        a, b, piece = matches(v, d, np.full(len(d), len(d)))
        order = np.argsort(a, kind="stable")
        order = order[a[order] < WINDOW]
        a, b, piece = a[order], b[order], piece[order]
        score = np.where(piece >= 0, v.scores[piece], v.unknown)
        for s, e, c, p in zip(a.tolist(), b.tolist(), score.tolist(), piece.tolist()):
            total = best[s] + c
            if total > best[e]:  # of equal ones the first, which is the longest
                best[e] = total
                length[at + e] = e - s
                by[at + e] = p
        best = best[WINDOW:]
    out = np.full(n, -1, np.int64)
    e = n
    while e > 0:
        s = e - int(length[e])
        out[s:e] = -1
        if by[e] >= 0:
            out[s] = by[e]
        else:
            out[s:e] = v.bytes_ids[data[s:e]]
        e = s
    return out


def solve(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best pieces of the chunks ``data[start:end]``, which follow each
    other without gaps, and the number of ids of each chunk."""
    long = end - start
    out = np.full(len(data), -1, np.int64)
    few = np.flatnonzero(long <= LONG_CHUNK)
    if len(few) == len(long):
        out = _solve_together(v, data, start, end)
    else:
        at = _ranges(start[few], long[few])
        ends = np.cumsum(long[few])
        out[at] = _solve_together(v, data[at], ends - long[few], ends)
        for k in np.flatnonzero(long > LONG_CHUNK):
            out[start[k]:end[k]] = _solve_alone(v, data[start[k]:end[k]])
    held = np.r_[0, np.cumsum(out >= 0)]
    return out[out >= 0].astype(np.int32), held[end] - held[start]


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Concatenated ranges of ``many`` from each start."""
    return np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))


def encode_block(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts ``data[off[i]:off[i + 1]]`` and the number of each."""
    full = np.flatnonzero(np.diff(off))
    many = np.zeros(len(off) - 1, np.int64)
    if not len(full):
        return np.zeros(0, np.int32), many
    data = np.insert(data, off[full], 32)  # the blank before each text
    row = off[full] + np.arange(len(full))
    blank = data == 32
    head = blank.copy()
    head[1:] &= ~blank[:-1]
    head[row] = True
    start = np.flatnonzero(head)
    end = np.r_[start[1:], len(data)]
    _, one, which = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    long = end[one] - start[one]
    ids, n = solve(v, data[_ranges(start[one], long)], np.cumsum(long) - long, np.cumsum(long))
    chunk_n = n[which]
    out = ids[_ranges((np.cumsum(n) - n)[which], chunk_n)]
    held = np.r_[0, np.cumsum(chunk_n)]
    cut = np.r_[np.searchsorted(start, row), len(start)]
    many[full] = held[cut[1:]] - held[cut[:-1]]
    return out, many


def encode_blocks(v: Vocabulary, col: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Rows from and to, and their ids, of blocks of bounded bytes."""
    data, off = texts_of(col)
    null = np.asarray(col.is_null())
    for i, j in row_blocks(off, BLOCK_BYTES):
        ids, many = encode_block(v, data[off[i]:off[j]], off[i:j + 1] - off[i])
        ends = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        mask = pa.array(null[i:j]) if null[i:j].any() else None
        yield i, j, pa.ListArray.from_arrays(ends, pa.array(ids), mask=mask)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(v.pieces.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _ids_of(col: pa.Array) -> list[np.ndarray | None]:
    flat, off = col.values.to_numpy(zero_copy_only=False), np.asarray(col.offsets)
    ok = np.asarray(col.is_valid())
    return [flat[a:b] if k else None for a, b, k in zip(off[:-1], off[1:], ok)]


def encode(docs: DataFrame, v: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           ids: str = "ids", check: str | None = None) -> DataFrame:
    """``keep`` columns and the ids of each text; with ``check`` also a column of
    that name that tells whether decoding the ids gives the text back."""
    src = docs.select(F.col(text).alias("_pieces_text"), *keep)
    names = [*keep, ids, *([check] if check else [])]
    kind = T.StructType([*(src.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType())),
                         *([T.StructField(check, T.BooleanType())] if check else [])])

    def run(batches):
        for b in batches:
            for i, j, coded in encode_blocks(v, b.column(0)):
                out = [*(b.column(1 + k).slice(i, j - i) for k in range(len(keep))), coded]
                if check:
                    texts = b.column(0).slice(i, j - i).to_pylist()
                    out.append(pa.array([(None if c is None else decode_ids(v, c)) == t
                                         for c, t in zip(_ids_of(coded), texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names)

    return src.mapInArrow(run, kind)


def decode(rows: DataFrame, v: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",),
           text: str = "text") -> DataFrame:
    """``keep`` columns and the text of each list of ids; null stays null."""
    src = rows.select(F.col(ids).alias("_pieces_ids"), *keep)
    kind = T.StructType([*(src.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches):
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                texts = [None if i is None else decode_ids(v, i) for i in _ids_of(part.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(1 + i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, text])

    return src.mapInArrow(run, kind)
