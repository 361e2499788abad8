"""Counting quotient filters of packed keys: lossless, sorted, mergeable.

A key is a few limbs of whole numbers of known widths in bits. An invertible
permutation of all its bits makes keys spread evenly; the first bits of the result
are the shard, the next the quotient, and all others the remainder, which is kept in
full, so that a key can be told from its place and remainder and counts are exact.

A filter holds its keys in order: a bit for each quotient that occurs, a bit for
each key that ends its quotient's run, the remainders in whole bytes, a bit for each
count above one and these counts in as many bytes as the greatest needs. Two sorted
filters merge into one.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ROUNDS = 2


class Layout(NamedTuple):
    """Bits of each limb of a key, and how many of the first limb's say the shard."""

    widths: tuple[int, ...]
    shard_bits: int


class Entries(NamedTuple):
    """Permuted keys in order, without repeats, and their counts."""

    limbs: tuple[np.ndarray, ...]
    counts: np.ndarray


def _mask(width: int) -> np.uint64:
    return _U((1 << width) - 1)


def _scramble(x: np.ndarray, width: int) -> np.ndarray:
    shift = _U(max(1, (width + 1) // 2))
    for odd in _ODD:
        x = (x ^ (x >> shift)) * _U(odd) & _mask(width)
    return x ^ (x >> shift)


def _unscramble(x: np.ndarray, width: int) -> np.ndarray:
    shift = _U(max(1, (width + 1) // 2))
    x = x ^ (x >> shift)
    for odd in reversed(_ODD):
        x = x * _U(pow(odd, -1, 1 << 64)) & _mask(width)
        x = x ^ (x >> shift)
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hash of 64-bit numbers."""
    return _scramble(x + _U(0x632BE59BD9B4E019), 64)


def _others(limbs: list[np.ndarray], i: int) -> np.ndarray:
    out = np.full(len(limbs[0]), i + 1, _U)
    for j, x in enumerate(limbs):
        if j != i:
            out = mixed(out ^ x)
    return out


def permute(limbs: tuple[np.ndarray, ...], widths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    out = list(limbs)
    for _ in range(_ROUNDS):
        for i, w in enumerate(widths):
            x = out[i] ^ (_others(out, i) & _mask(w)) if len(out) > 1 else out[i]
            out[i] = _scramble(x, w)
    return tuple(out)


def restore(limbs: tuple[np.ndarray, ...], widths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    out = list(limbs)
    for _ in range(_ROUNDS):
        for i, w in reversed(list(enumerate(widths))):
            x = _unscramble(out[i], w)
            out[i] = x ^ (_others(out, i) & _mask(w)) if len(out) > 1 else x
    return tuple(out)


def _in_order(limbs: tuple[np.ndarray, ...], counts: np.ndarray) -> Entries:
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs, counts = tuple(x[order] for x in limbs), counts[order]
    new = np.zeros(len(counts), bool)
    new[:1] = True
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return Entries(tuple(x[head] for x in limbs), np.add.reduceat(counts, head) if len(head) else counts)


def count(limbs: tuple[np.ndarray, ...], layout: Layout) -> Entries:
    """Permuted keys of ``limbs`` and how often each occurs."""
    return _in_order(permute(limbs, layout.widths), np.ones(len(limbs[0]), np.int64))


def merge(some: list[Entries]) -> Entries:
    """One from several; sorted inputs are merged by a sort that uses their order."""
    if len(some) == 1:
        return some[0]
    return _in_order(tuple(np.concatenate(x) for x in zip(*(e.limbs for e in some))),
                     np.concatenate([e.counts for e in some]))


def _bytes_of(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number, as rows."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width if width else 0, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").ravel().astype(_U)


def _quotient_bits(n: int, width: int) -> int:
    """About the logarithm of the number of keys, so that what remains of the first
    limb fills whole bytes."""
    q = min(width, max(0, int(n - 1).bit_length()))
    return max(0, q - (8 - (width - q) % 8) % 8) if width - q else q


def encode(e: Entries, layout: Layout) -> bytes:
    """The filter of a shard's entries."""
    width, n = layout.widths[0] - layout.shard_bits, len(e.counts)
    low = e.limbs[0] & _mask(width)
    q = _quotient_bits(n, width)
    quotient = (low >> _U(width - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    rest = [_bytes_of(low & _mask(width - q), -(-(width - q) // 8))]
    rest += [_bytes_of(x, -(-w // 8)) for x, w in zip(e.limbs[1:], layout.widths[1:])]
    many = e.counts > 1
    size = max(1, -(-int(e.counts.max(initial=1)).bit_length() // 8))
    return b"".join([struct.pack("<IBB", n, q, size), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     *(r.tobytes() for r in rest), np.packbits(many).tobytes(),
                     _bytes_of(e.counts[many].astype(_U), size).tobytes()])


def decode(filter_: bytes, layout: Layout, shard: int) -> Entries:
    """Entries of a shard's filter."""
    n, q, size = struct.unpack_from("<IBB", filter_)
    raw, at = np.frombuffer(filter_, np.uint8), 6

    def bits(many: int) -> np.ndarray:
        nonlocal at
        got = np.unpackbits(raw[at:at + -(-many // 8)], count=many).astype(bool)
        at += -(-many // 8)
        return got

    def numbers(many: int, width: int) -> np.ndarray:
        nonlocal at
        got = _numbers(raw[at:at + many * width], width) if width else np.zeros(many, _U)
        at += many * width
        return got

    width = layout.widths[0] - layout.shard_bits
    quotients, ends = np.flatnonzero(bits(1 << q)), bits(n)
    run = np.cumsum(ends) - ends  # runs ended before each key
    low = numbers(n, -(-(width - q) // 8))
    if q:
        low = low | (quotients[run].astype(_U) << _U(width - q))
    limbs = [low | (_U(shard) << _U(width)) if layout.shard_bits else low]
    limbs += [numbers(n, -(-w // 8)) for w in layout.widths[1:]]
    many = bits(n)
    counts = np.ones(n, np.int64)
    counts[many] = numbers(int(many.sum()), size).astype(np.int64)
    return Entries(tuple(limbs), counts)


def by_shard(e: Entries, layout: Layout) -> list[tuple[int, bytes]]:
    """(shard, filter) of the entries of each shard that has any."""
    if not len(e.counts):
        return []
    shard = e.limbs[0] >> _U(layout.widths[0] - layout.shard_bits) if layout.shard_bits else np.zeros(len(e.counts), _U)
    head = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    return [(int(shard[i]), encode(Entries(tuple(x[i:j] for x in e.limbs), e.counts[i:j]), layout))
            for i, j in zip(head, [*head[1:], len(shard)])]
