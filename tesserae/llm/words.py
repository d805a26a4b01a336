"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is read as blocks of eight bytes from its start, each mixed with its place
by a bijection of 64-bit words; the sum of the blocks and the length, mixed
again, is its hash, so no Python object is made for a word. Words of up to eight
bytes of one length never clash; longer ones do so by chance alone, about once in
2**64 pairs, as the mixing leaves no pattern that repeats from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = U(0x9E3779B97F4A7C15)
_SIZE = U(0xC2B2AE3D27D4EB4F)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 2**64) for j in range(64)], U)
SLICE_BYTES = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes data[starts[i]:ends[i]]; runs are not empty."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    blocks = (size + 7) // 8
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    value = eight[np.repeat(starts, blocks) + 8 * nth]
    last = first + blocks - 1
    value[last] &= ~U(0) >> (8 * (8 * blocks - size)).astype(U)
    mixed = mix(value + (nth.astype(U) + U(1)) * _PLACE)
    return mix(np.add.reduceat(mixed, first) + size.astype(U) * _SIZE)


@dataclass
class Words:
    """hash of each word, in order; doc i has words first[i] to first[i + 1]."""

    hash: np.ndarray
    first: np.ndarray


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string or binary column of about SLICE_BYTES: first row, end row, bytes, offsets from 0."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    docs = len(offsets) - 1
    if not len(data):
        return Words(np.zeros(0, U), np.zeros(docs + 1, np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(run_hashes(_FOLD[data] if fold else data, starts, ends), np.searchsorted(starts, offsets))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each doc, one after the other, and their first places.

    A doc with fewer than n words has its whole sequence as one; without words, none.
    """
    docs = len(words.first) - 1
    count = np.diff(words.first)
    doc = np.repeat(np.arange(docs), count)
    total = len(words.hash)
    acc = np.zeros(total, U)
    for j in range(n):
        acc[: total - j] += words.hash[j:] * _STEPS[j] if j else words.hash * _STEPS[0]
    full = np.zeros(total, bool)
    if total >= n:
        full[: total - n + 1] = doc[: total - n + 1] == doc[n - 1 :]
    h, of = mix(acc[full]), doc[full]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), U)
        for j in range(n - 1):
            has = count[short] > j
            whole[has] += words.hash[words.first[short[has]] + j] * _STEPS[j]
        whole = mix(whole + count[short].astype(U) * _STEPS[n])
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    first = np.searchsorted(of, np.arange(docs + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(docs + 1))


_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter, digit or part of a longer character, 2 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def split_tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Tokens are runs of word bytes and runs of punctuation bytes; case is kept."""
    docs = len(offsets) - 1
    if not len(data):
        return Words(np.zeros(0, U), np.zeros(docs + 1, np.int64))
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return Words(run_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def ngram_buckets(words: Words, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of each n-gram of 1 to n tokens, and its doc."""
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(count)), count)
    out_h, out_d = [words.hash], [doc]
    total = len(words.hash)
    acc = words.hash * _STEPS[0]
    for j in range(1, n):
        if total <= j:
            break
        acc = acc[:-1] + words.hash[j:] * _STEPS[j]
        inside = doc[: total - j] == doc[j:]
        out_h.append(mix(acc[inside]))
        out_d.append(doc[: total - j][inside])
    return (np.concatenate(out_h) % U(buckets)).astype(np.int64), np.concatenate(out_d)
