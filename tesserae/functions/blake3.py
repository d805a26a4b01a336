"""Keyed BLAKE3 of many byte strings at once, in numpy.

The 1024-byte leaves of all inputs are compressed side by side, then the parents
of each tree level side by side; one compression is 7 rounds over arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# fixed values of the published algorithm
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED_HASH = 1, 2, 4, 8, 16
# fixed values: the keys of the three hash domains
DATA_KEY = bytes([102, 151, 245, 119, 91, 149, 80, 222, 49, 53, 203, 172, 165, 151, 24, 28, 157, 228, 33, 16, 155, 235, 43, 88, 180, 208, 176, 75, 147, 173, 242, 41])
NODE_KEY = bytes([1, 126, 197, 199, 165, 71, 41, 150, 253, 148, 102, 102, 180, 138, 2, 230, 93, 221, 83, 111, 55, 199, 109, 210, 248, 99, 82, 230, 74, 83, 113, 63])
RANGE_KEY = bytes([127, 24, 87, 214, 206, 86, 237, 102, 18, 127, 249, 19, 231, 165, 195, 243, 164, 205, 38, 213, 181, 219, 73, 230, 65, 36, 152, 127, 40, 251, 148, 195])

_U = np.uint32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def _schedule() -> list[list[int]]:
    """Places in the block of the 16 words that each round takes."""
    rounds = [list(range(16))]
    for _ in range(6):
        rounds.append([rounds[-1][p] for p in PERMUTATION])
    return rounds


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv 8 x n, block 16 x n -> the new 8 x n chaining values."""
    n = cv.shape[1]
    # the rows of the 4 x 4 state; its columns and its diagonals are worked on four at a time
    a, b, c = cv[:4].copy(), cv[4:].copy(), np.repeat(np.array(IV[:4], _U)[:, None], n, 1)
    d = np.stack([(counter & 0xFFFFFFFF).astype(_U), (counter >> 32).astype(_U), length.astype(_U), flags.astype(_U)])
    for words in _SCHEDULE:
        for at in (0, 8):
            if at:
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            for half, (turn_d, turn_b) in enumerate(((16, 12), (8, 7))):
                a += b
                a += block[words[at + half : at + 8 : 2]]
                d = _turn(d ^ a, turn_d)
                c += d
                b = _turn(b ^ c, turn_b)
            if at:
                b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
    return np.concatenate([a ^ c, b ^ d])


_SCHEDULE = _schedule()


def keyed_hashes(messages: Sequence[bytes], key: bytes) -> list[bytes]:
    """The 32-byte keyed hash of each message."""
    if not messages:
        return []
    k = np.frombuffer(key, "<u4").astype(_U)[:, None]
    leaves = [max(1, -(-len(x) // 1024)) for x in messages]
    first = np.concatenate([[0], np.cumsum(leaves)])
    width = 1024 if max(leaves) > 1 else 64 * max(1, -(-max(map(len, messages)) // 64))
    padded = np.frombuffer(b"".join(x.ljust(width * n, b"\0") for x, n in zip(messages, leaves)), "<u4").reshape(-1, width // 64, 16)
    place = np.concatenate([np.arange(n) for n in leaves])
    size = np.concatenate([np.minimum(1024, len(x) - 1024 * np.arange(n)) for x, n in zip(messages, leaves)])
    alone = np.repeat(np.asarray(leaves) == 1, leaves)
    blocks = np.maximum(1, -(-size // 64))
    cv = np.repeat(k, len(size), 1)
    for i in range(int(blocks.max())):
        on = np.flatnonzero(blocks > i)
        last = blocks[on] == i + 1
        flags = KEYED_HASH | (CHUNK_START if i == 0 else 0) | np.where(last, CHUNK_END, 0) | np.where(last & alone[on], ROOT, 0)
        cv[:, on] = _compress(cv[:, on], padded[on, i].T.astype(_U), place[on], np.clip(size[on] - 64 * i, 0, 64), flags)
    # levels of all trees side by side: neighbours pair up, an odd last one goes up as it is
    trees = [list(range(a, b)) for a, b in zip(first[:-1], first[1:])]
    values = list(cv.T)
    while any(len(t) > 1 for t in trees):
        todo = [(t, j) for t, nodes in enumerate(trees) for j in range(0, len(nodes) - 1, 2)]
        block = np.stack([np.concatenate([values[trees[t][j]], values[trees[t][j + 1]]]) for t, j in todo]).T.astype(_U)
        top = np.array([len(trees[t]) == 2 for t, _ in todo])
        n = len(todo)
        up = _compress(np.repeat(k, n, 1), block, np.zeros(n, np.int64), np.full(n, 64), KEYED_HASH | PARENT | np.where(top, ROOT, 0))
        base = len(values)
        values += list(up.T)
        made = dict(zip(todo, range(base, base + n)))
        trees = [[made.get((t, j), nodes[j]) for j in range(0, len(nodes), 2)] if len(nodes) > 1 else nodes for t, nodes in enumerate(trees)]
    return [values[t[0]].astype("<u4").tobytes() for t in trees]


def to_hex(raw: bytes) -> str:
    """Digits of four 64-bit words, most significant first, of bytes that hold them least significant first."""
    return b"".join(raw[i : i + 8][::-1] for i in range(0, 32, 8)).hex()


def from_hex(digits: str) -> bytes:
    raw = bytes.fromhex(digits)
    return b"".join(raw[i : i + 8][::-1] for i in range(0, 32, 8))
