"""Plain versions of the operators for small tables."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(items, n, num, den):
    """(doc_id, set size, component) of (doc_id, text) pairs; each pair of sets is compared."""
    sets = {i: shingle_set(t, n) for i, t in items}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_feature = collections.defaultdict(list)
    for i, s in sets.items():
        for f in s:
            by_feature[f].append(i)
    for i, s in sets.items():
        shared = collections.Counter(j for f in s for j in by_feature[f] if j < i)
        for j, c in shared.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


M = 2**64 - 1
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+")


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def run_hash(run):
    total = sum(mix((int.from_bytes(run[i : i + 8], "little") + (i // 8 + 1) * 0x9E3779B97F4A7C15) & M) for i in range(0, len(run), 8))
    return mix((total + len(run) * 0xC2B2AE3D27D4EB4F) & M)


def ngrams(text, buckets):
    """Buckets of the tokens and pairs of tokens of a text."""
    h = [run_hash(t) for t in TOKEN.findall((text or "").encode())]
    step = [pow(0xD6E8FEB86659FD93, 2 * j + 1, 2**64) for j in range(2)]
    return [x % buckets for x in h] + [mix((a * step[0] + b * step[1]) & M) % buckets for a, b in zip(h, h[1:])]


def importance(docs, target, buckets, shrink):
    """doc_id -> log weight of (doc_id, text) pairs, for a set of target ids; None without n-grams."""
    grams = {i: ngrams(t, buckets) for i, t in docs}
    raw = collections.Counter(b for g in grams.values() for b in g)
    good = collections.Counter(b for i, g in grams.items() if i in target for b in g)
    share = sum(good.values()) / max(1, sum(raw.values()))
    return {i: sum(math.log((good[b] + shrink) / (raw[b] * share + shrink)) for b in g) if g else None for i, g in grams.items()}
