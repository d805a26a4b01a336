"""Content-defined chunk boundaries over the bytes of one value.

A gear hash at position i is the sum over the last 64 bytes of
``GEAR[byte] << age`` modulo 2**64, so it depends on those 64 bytes alone and
can be computed for all positions at once by doubling: six shift-and-add steps.
A cut follows the first position at least ``min_size`` past the last cut whose
hash has its top bits zero; ``max_size`` bounds a chunk.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

WINDOW = 64


def default_gear() -> np.ndarray:
    """256 fixed words: the first 8 bytes of SHA-256 of each byte value."""
    raw = b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256))
    return np.frombuffer(raw, dtype="<u8").copy()


@dataclass(frozen=True)
class ChunkSpec:
    """Target size (a power of two) and its bounds; minimum and maximum follow from it."""

    target: int = 65536
    min_divisor: int = 8
    max_multiplier: int = 2

    def __post_init__(self):
        if self.target & (self.target - 1) or self.target // self.min_divisor <= WINDOW:
            raise ValueError("target must be a power of two with target / min_divisor above the 64 byte window")

    @property
    def min_size(self) -> int:
        return self.target // self.min_divisor

    @property
    def max_size(self) -> int:
        return self.target * self.max_multiplier

    @property
    def mask(self) -> int:
        bits = self.target.bit_length() - 1
        return (self.target - 1) << (64 - bits)


def candidates(data: np.ndarray, gear: np.ndarray, mask: int) -> np.ndarray:
    """End offsets (exclusive) at which the gear hash allows a cut."""
    h = gear[data]
    for step in (1, 2, 4, 8, 16, 32):
        shifted = h[:-step] << np.uint64(step)
        h[step:] += shifted
    return np.flatnonzero((h & np.uint64(mask)) == 0) + 1


def cut_points(data: bytes | np.ndarray, spec: ChunkSpec, gear: np.ndarray) -> list[int]:
    """End offsets of the chunks of ``data``; the last is its length. Empty data has none."""
    buf = np.frombuffer(data, dtype=np.uint8) if isinstance(data, (bytes, memoryview)) else data
    n = len(buf)
    if n == 0:
        return []
    if n <= spec.min_size:
        return [n]
    return chosen_cuts(candidates(buf, gear, spec.mask), n, spec)


def chosen_cuts(allowed: np.ndarray, n: int, spec: ChunkSpec) -> list[int]:
    """The cuts of ``n`` bytes among the places that allow one, in order."""
    cuts, start = [], 0
    while n - start > spec.min_size:
        k = int(np.searchsorted(allowed, start + spec.min_size))
        end = min(int(allowed[k]) if k < len(allowed) else n, start + spec.max_size, n)
        cuts.append(end)
        start = end
    if start < n:
        cuts.append(n)
    return cuts
