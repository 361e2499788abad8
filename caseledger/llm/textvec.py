"""Words of many texts at once as 64-bit hashes, computed with numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken as the
difference of two prefix sums and then mixed. Rows are handled in blocks whose
bytes are bounded, so memory doesn't follow the batch (a text longer than the
block is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from caseledger.llm.common import row_blocks

_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ALL = np.arange(256)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Blank and \t \n \v \f \r.
SPACE = np.isin(_ALL, [32, 9, 10, 11, 12, 13])
#: All ASCII but letters and digits; bytes of other characters belong to words.
NOT_WORD = (_ALL < 128) & ~(((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90))
                            | ((_ALL >= 97) & (_ALL <= 122)))

BLOCK_BYTES = 1 << 20


class Words(NamedTuple):
    """Words of the rows ``first`` to ``last`` (exclusive) of a batch."""

    first: int
    last: int
    data: np.ndarray    # bytes of these rows
    offsets: np.ndarray  # of the rows in ``data``
    start: np.ndarray   # of each word in ``data``
    end: np.ndarray
    row: np.ndarray     # of each word, counted from ``first``
    hash: np.ndarray    # uint64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, _ODD, np.uint64)
    p[0] = 1
    q = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``."""
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:len(data)], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def word_blocks(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE,
                block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """Words (runs of bytes that are no separators, ASCII lower-cased for the
    hash) of each row, block by block."""
    for i, j in row_blocks(offsets, block_bytes):
        off = offsets[i:j + 1] - offsets[i]
        d = data[offsets[i]:offsets[j]]
        inside = ~separators[d]
        heads = off[:-1][off[:-1] < off[1:]]  # first bytes of rows that have any
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[heads] = inside[heads]
        end = np.zeros(len(d) + 1, bool)
        end[1:] = inside
        end[1:-1] &= ~inside[1:]
        end[heads[1:]] = inside[heads[1:] - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        yield Words(i, j, d, off, s, e, np.searchsorted(off, s, "right") - 1,
                    span_hash(LOWER[d], s, e))
