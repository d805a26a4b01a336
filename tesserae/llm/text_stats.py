"""Counts of many texts at once in numpy: words, characters, lines and what repeats in them.

Words and lines are told apart by 64-bit hashes (see ``words``): two different
words of one text clash about once in 2**64 pairs.
"""

from __future__ import annotations

import numpy as np

from .words import _SPACE, _STEPS, U, mix, run_hashes, split_words


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: No byte within a longer character but its first: one for each code point.
_FIRST = (np.arange(256) & 0xC0) != 0x80


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_text(_FIRST[data], offsets)


def members(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in the class of single-byte characters."""
    return per_text(table[data], offsets)


def distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text, whose hashes are h[first[i]:first[i + 1]]."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][first[:-1] < len(h)]] = True
    return per_text(new, first)


def repeated_words(h: np.ndarray, first: np.ndarray, n: int = 3) -> np.ndarray:
    """Words of each text within windows of n words that the text has twice or more, the first included."""
    total = len(h)
    covered = np.zeros(total + 1, np.int64)
    if total >= n:
        window = h[: total - n + 1] * _STEPS[0]
        for j in range(1, n):
            window = window + h[j : total - n + 1 + j] * _STEPS[j]
        window = mix(window)
        again = np.zeros(total, bool)
        for a, b in zip(first[:-1].tolist(), (first[1:] - n + 1).tolist()):
            if b - a < 2:
                continue
            order = np.argsort(window[a:b])
            ordered = window[a:b][order]
            same = ordered[1:] == ordered[:-1]
            if same.any():
                again[a + order[1:][same]] = True
                again[a + order[:-1][same]] = True
        at = np.flatnonzero(again)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
    return per_text(np.cumsum(covered[:-1]) > 0, first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those of them that equal an earlier line."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:] |= data == 10
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], n)
    ends = ends - (data[ends - 1] == 10)
    seen = np.concatenate([[0], np.cumsum(~_SPACE[data], dtype=np.int64)])
    word = seen[ends] > seen[starts]
    starts, ends = starts[word], ends[word]
    first = np.searchsorted(starts, offsets)
    lines = np.diff(first)
    return lines, lines - distinct(run_hashes(data, starts, ends), first)


def quality_counts(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that quality rules look at, an array a count."""
    words = split_words(data, offsets, fold=False)
    n_lines, dup_lines = repeated_lines(data, offsets)
    return {
        "n_words": np.diff(words.first),
        "word_chars": per_text(_FIRST[data] & ~_SPACE[data], offsets),
        "n_symbols": members(data, offsets, symbols),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(words.hash, words.first),
        "n_lines": n_lines,
        "n_distinct_words": distinct(words.hash, words.first),
    }


