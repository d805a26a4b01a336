"""Operator 4: the n-gram Jaccard join with PartEnum signatures, and its components.

Two sets with Jaccard similarity of at least num / den differ in at most
(den - num) / (den + num) times the sum of their sizes. Sizes are cut into bands
such that linked sets lie in the same band or in neighbours; each set makes
signatures for its own band and the next one up. For a band with top size r the
difference is at most k = 2 r (den - num) / (den + num): the feature domain is
hashed into n1 partitions, each into n2 second-level ones, and each subset of
n2 - k2 second-level partitions of a partition gives one signature, the hash of
the set's features there. With n1 > k / (k2 + 1) some partition has at most k2
differences, and one of its subsets has none, so linked sets share a signature.
``spare`` more partitions guarantee ``spare`` + 1 such partitions; a set in which
no more than ``spare`` partitions are thin (a subset with fewer than ``THIN``
features) leaves its thin signatures out and still shares another.

Signatures (n2 = 2, k2 = 1) are shuffled once. Within a bucket each set is paired
with the first and with the one before it; pairs pass a lower bound of the
difference (the differing bits of parity sketches) and then an exact comparison
of the texts' shingle sets. Sets that are already connected need no more
comparisons, so a group of near copies is never expanded into pairs. Of the
buckets that still hold several components, those of more than ``large`` sets
are given up and their sets signed anew with n2 = 5, k2 = 2, whose signatures
cover twice as many features: sets that merely have a common passage part, and
linked ones still share a signature. In what is left sets are compared by sketch
in cells of bounded size; sets that have a partner are compared once more by
larger sketches, and what passes is compared exactly. Rows with sketches, and the
longer signatures, are more than the input can pay for at once: they go in rounds,
and tables are deleted when nothing reads them any more. Equal sets are folded
first. The result is every component of the link graph; no candidate is dropped.
Shingles are told apart by 64-bit hashes of their words.

Defined results: a row without words has an empty set, 0 shingles and itself as
component; a null doc_id takes no part in links (component null); rows that
share a doc_id count as one document, whose links are those of all its texts;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, scratch, written
from .words import U, mix, shingles, slices, split_words

FINE = 16
THIN = 2
BLOCK = 500
#: Rows that carry a sketch are shuffled in rounds of so many a set, signatures made anew in rounds of one for so many features.
SKETCHED, FEATURES = 16, 8
LEAST = 1_000_000
DESCRIBED = "node long, n long, key1 long, key2 long, sketch binary"
_K = [U(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F)]


class Bands:
    """Size bands for similarity num / den and the partition counts of each."""

    def __init__(self, num: int, den: int, n2: int = 2, k2: int = 1):
        self.num, self.den, self.n2, self.k2 = num, den, n2, k2
        self.subsets = list(combinations(range(n2), n2 - k2))
        self.tops: list[int] = []
        self.n1: list[int] = []
        self.spare: list[int] = []

    def upto(self, size: int) -> None:
        """Bands that cover sets of this size, and the next one up."""
        while len(self.tops) < 2 or self.tops[-2] < size:
            low = self.tops[-1] + 1 if self.tops else 1
            top = low * self.den // self.num
            k = 2 * top * (self.den - self.num) // (self.den + self.num)
            n1 = k // (self.k2 + 1) + 1
            self.tops.append(top)
            self.spare.append(1 + n1 // 16)
            # with k = 0 only equal sets are linked, and those are folded already
            self.n1.append(n1 + self.spare[-1] if k else 0)


def set_sums(h: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-free 64-bit hash and count of the features in each of n cells."""
    e = mix(h * _K[0])
    low = np.bincount(cell, (e & U(0xFFFFFFFF)).astype(np.float64), n).astype(U)  # exact below 2**53
    high = np.bincount(cell, (e >> U(32)).astype(np.float64), n).astype(U)
    return (high << U(32)) + low, np.bincount(cell, minlength=n)


def signatures(h: np.ndarray, first: np.ndarray, bands: Bands, only: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of each set and the set's number, for sets h[first[i]:first[i + 1]].

    ``only`` (low, high, m, r): those of the bands from low to high - 1, of each m-th partition from the r-th on.
    """
    size = np.diff(first)
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    bands.upto(int(size.max()))
    band = np.searchsorted(np.asarray(bands.tops), size)
    doc = np.repeat(np.arange(len(size)), size)
    out_sig, out_doc = [], []
    for up in (0, 1):
        n1 = np.where(size > 0, np.asarray(bands.n1)[np.minimum(band + up, len(bands.n1) - 1)], 0)
        spare = np.asarray(bands.spare)[np.minimum(band + up, len(bands.n1) - 1)]
        if only is not None:
            n1 = np.where((band + up >= only[0]) & (band + up < only[1]), n1, 0)
        base = np.concatenate([[0], np.cumsum(n1)])
        use = n1[doc] > 0
        g, d = mix(h[use] ^ _K[1]), doc[use]
        part = ((g >> U(32)) * n1[d].astype(U) >> U(32)).astype(np.int64)
        sub = ((g & U(0xFFFFFFFF)) * U(bands.n2) >> U(32)).astype(np.int64)
        total = int(base[-1])
        if not total:
            continue
        sums, counts = set_sums(h[use], (base[d] + part) * bands.n2 + sub, total * bands.n2)
        sums, counts = sums.reshape(total, bands.n2), counts.reshape(total, bands.n2)
        of = np.repeat(np.arange(len(size)), n1)
        tag = (np.arange(total) - base[of]).astype(U) * _K[2] + (band + up)[of].astype(U) * _K[3]
        have = np.stack([counts[:, s].sum(1) for s in bands.subsets], 1)
        thin = np.bincount(of, (have < THIN).any(1), len(size))
        skip = (thin <= spare)[of][:, None] & (have < THIN)
        if only is not None:
            skip |= ((np.arange(total) - base[of]) % only[2] != only[3])[:, None]
        for c, s in enumerate(bands.subsets):
            sig = tag + U(c + 1)
            for j in s:
                sig = mix(sig * _K[0] + sums[:, j])
            keep = ~skip[:, c]
            out_sig.append(sig[keep])
            out_doc.append(of[keep])
    if not out_sig:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_doc)


def sketches(h: np.ndarray, first: np.ndarray, fine: int = 1) -> list[bytes]:
    """Parity of the feature counts in cells, a bit each; a power of two of cells, from ``fine`` times the set's size to twice that, at least 64.

    A feature of one set alone turns one bit, so differing bits are at most the
    sets' difference. The exclusive or of a sketch's halves is the sketch with
    half as many cells.
    """
    size = np.diff(first)
    cells = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size * fine, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(cells)])
    doc = np.repeat(np.arange(len(size)), size)
    cell = base[doc] + (mix(h ^ _K[3]) & (cells[doc] - 1).astype(U)).astype(np.int64)
    bits = np.packbits((np.bincount(cell, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [bits[x:y] for x, y in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches, folded to so many bytes."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of equal width, a multiple of 8 bytes."""
    x = np.ascontiguousarray(a ^ b).view(np.uint64)
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit order-free hash of each set as two words."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    return np.stack([set_sums(h, doc, n)[0], set_sums(h ^ _K[2], doc, n)[0]], 1)


def _describe(n: int, fine: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column("text")):
                h, first = shingles(split_words(data, offsets), n)
                keys = set_keys(h, first).view(np.int64)
                columns = [b.column("node").slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sketches(h, first, fine), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "key1", "key2", "sketch"])

    return run


def signing_rounds(sizes: dict[int, int], bands: Bands, at_once: int) -> list[tuple[int, int, int, int]]:
    """``only`` of rounds that make at most about ``at_once`` signatures each and together all, for so many sets of each band."""
    rounds: list[tuple[int, int, int, int]] = []
    low, held = 0, 0
    for band in range(max(sizes, default=-1) + 2):
        made = (sizes.get(band, 0) + sizes.get(band - 1, 0)) * bands.n1[band] * len(bands.subsets)
        if held and held + made > at_once:
            rounds.append((low, band, 1, 0))
            low, held = band, 0
        if (m := -(-made // at_once)) > 1:
            m = min(m, bands.n1[band])
            rounds += [(band, band + 1, m, r) for r in range(m)]
            low, held = band + 1, 0
        else:
            low, held = low if held else band, held + made
    return rounds + [(low, max(sizes) + 2, 1, 0)] * bool(held)


def _sign(n: int, bands: Bands, only: tuple[int, int, int, int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column("text")):
                h, first = shingles(split_words(data, offsets), n)
                sig, of = signatures(h, first, bands, only)
                nodes = b.column("node").slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[of], pa.int64())], names=["sig", "node"])

    return run


def _near(num: int, den: int):
    """Pairs that sizes and sketches allow to be linked, with the bound's share of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            fits = np.flatnonzero(den * np.minimum(x, y) >= num * np.maximum(x, y))
            far = np.full(b.num_rows, np.iinfo(np.int64).max)
            sa, sb = b.column("s_a"), b.column("s_b")
            shape = np.array([(len(sa[i].as_buffer()), len(sb[i].as_buffer())) for i in fits.tolist()], np.int64).reshape(-1, 2)
            for la, lb in np.unique(shape, axis=0).tolist():
                at = fits[(shape == (la, lb)).all(1)]
                left, right = (np.frombuffer(b"".join(c[i].as_py() for i in at.tolist()), np.uint8).reshape(len(at), -1) for c in (sa, sb))
                width = min(la, lb)
                far[at] = differing(folded(left, width), folded(right, width))
            keep = far <= (den - num) * (x + y) // (den + num)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(far[keep] / (x + y)[keep])], names=["a", "b", "far"])

    return run


def _linked(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros(b.num_rows, bool)
            at = 0
            while at < b.num_rows:
                # a few rows at a time: two whole texts each
                stop = min(at + 256, b.num_rows)
                sets = []
                for name in ("text_a", "text_b"):
                    parts = []
                    for i, j, data, offsets in slices(b.column(name).slice(at, stop - at)):
                        h, first = shingles(split_words(data, offsets), n)
                        parts += [h[x:y] for x, y in zip(first[:-1], first[1:])]
                    sets.append(parts)
                for r, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    found[at + r] = den * both >= num * (len(x) + len(y) - both)
                at = stop
            keep = pa.array(found)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _cross_pairs(num: int, den: int, nodes_only: bool = False):
    """Rows sorted by block key -> pairs of different components within the sketch bound, or the nodes of such pairs."""

    def compare(rows) -> tuple[np.ndarray, np.ndarray]:
        node, comp, size, side, raw = rows
        width = min(map(len, raw))
        sketch = np.concatenate([folded(np.frombuffer(x, np.uint8)[None, :], width) for x in raw])
        if len(node) <= 256 and not side.any():
            i, j = np.triu_indices(len(node), 1)
            fits = (comp[i] != comp[j]) & (den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))
            i, j = i[fits], j[fits]
            near = differing(sketch[i], sketch[j]) * (den + num) <= (den - num) * (size[i] + size[j])
            x, y = node[i[near]], node[j[near]]
            return np.minimum(x, y), np.maximum(x, y)
        a_out, b_out = [], []
        left = np.flatnonzero(side <= 0)
        for i in left:
            # within one block each pair once; between two blocks all of the other
            other = np.flatnonzero((side > 0) if side[i] < 0 else (np.arange(len(node)) > i))
            other = other[comp[other] != comp[i]]
            if not len(other):
                continue
            low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            other = other[den * low >= num * high]
            far = differing(sketch[other], sketch[i])
            other = other[far * (den + num) <= (den - num) * (size[other] + size[i])]
            a_out.append(np.minimum(node[other], node[i]))
            b_out.append(np.maximum(node[other], node[i]))
        return np.concatenate(a_out or [np.zeros(0, np.int64)]), np.concatenate(b_out or [np.zeros(0, np.int64)])

    def distinct(found) -> pa.RecordBatch:
        if nodes_only:
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([x for ab in found for x in ab])), pa.int64())], names=["node"])
        pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a pair may meet in several buckets of a task
        held, last, found = [], None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("sig", "bi", "bj")], 1)
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n", "side", "sketch")]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(keys[x])
                if last is not None and key != last:
                    found.append(compare([np.concatenate(c) for c in zip(*held)]))
                    held = []
                last = key
                held.append([c[x:y] for c in cols])
            if sum(len(a) for a, _ in found) > 500_000:
                yield distinct(found)
                found = []
        if held:
            found.append(compare([np.concatenate(c) for c in zip(*held)]))
        if found:
            yield distinct(found)

    return run


def _matching(df: DataFrame, ids: DataFrame, how: str, bound: int = 1_000_000) -> DataFrame:
    """Semi or anti join of ``df`` on node; the ids are broadcast if there are at most ``bound`` of them, else both sides are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids, "node", how)


def _one_text_a_node(source: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``source`` with nodes that have one text each, and (own, node, __h) of nodes that were made for further texts of an id, by the text's hash; None if there are none."""
    marked = source.withColumn("__h", F.xxhash64("text"))
    first = marked.where("node is not null").groupBy("node").agg(F.min("__h").alias("__lo"), F.max("__h").alias("__hi"))
    several = written(first.where("__lo <> __hi").select("node", "__lo"), "ids-of-several-texts")
    if several.isEmpty():
        return source, None
    low, high = source.agg(F.min("node"), F.max("node")).first()
    more = marked.join(several, "node").where("__h <> __lo").select("node", "__h").distinct()
    k = F.monotonically_increasing_id()
    own = F.lit(high + 1) + k if high < 2**62 else F.lit(low - 1) - k  # ids that no row has
    more = written(more.withColumn("own", own), "further-texts")
    return marked.join(more, ["node", "__h"], "left").select(F.coalesce("own", "node").alias("node"), "text"), more.select("own", "node", "__h")


def link_components(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", n2: int = 2, block: int = BLOCK, large: int = 16 * BLOCK, at_once: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links at Jaccard >= num / den on n-word shingles.

    What is shuffled with sketches, and signatures made anew, go in rounds of ``at_once``
    rows, by default in proportion to the sets and their features; each round's shuffle
    files are gone before the next, so that disk stays in proportion to the input.
    """
    source, further = _one_text_a_node(docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = written(source.mapInArrow(_describe(n), DESCRIBED), "sets")
    full = rows.where("n > 0 and node is not null")
    classes = written(full.groupBy("n", "key1", "key2").agg(F.min("node").alias("rep")), "set-classes")
    nodes = written(full.join(classes, ["n", "key1", "key2"]).groupBy("node").agg(F.min(F.struct("rep", "n", "sketch")).alias("x")).select("node", "x.*"), "set-nodes")
    copies = written(nodes.where("node <> rep").select("node"), "set-copies")
    by_doc = nodes.select("node", "rep", F.col("node").alias("doc"))
    if further is not None:
        by_doc = written(nodes.select("node", "rep").join(further.select(F.col("own").alias("node"), F.col("node").alias("doc")), "node", "left").select("node", "rep", F.coalesce("doc", "node").alias("doc")), "set-docs")
    # texts of one id are linked
    same = by_doc.join(by_doc.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi"), "doc").where("rep <> a").select("a", F.col("rep").alias("b"))

    bucket = Window.partitionBy("sig").orderBy("node")
    signed = _matching(source.where("node is not null"), copies, "left_anti").mapInArrow(_sign(n, Bands(num, den, n2)), "sig long, node long")
    shared = signed.select("sig", "node", F.lag("node").over(bucket).alias("before"), F.lead("node").over(bucket).alias("after"), F.first("node").over(bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("head"))
    shared = written(shared.where("before is not null or after is not null").select("sig", "node", "before", "head"), "buckets")

    counted = nodes.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("features")).first()
    sketched_at_once = at_once or max(LEAST, SKETCHED * counted["sets"])
    signed_at_once = at_once or max(LEAST, counted["features"] // FEATURES)

    def rounds(rows: int) -> int:
        return max(1, -(-rows // sketched_at_once))

    def in_round(k: int, r: int, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(k)) == r if k > 1 else F.lit(True)

    def all_of(parts: list[DataFrame], name: str) -> DataFrame:
        """Distinct rows of the written results of rounds."""
        if len(parts) == 1:
            return parts[0]
        made = written(reduce(DataFrame.unionByName, parts).distinct(), name)
        discard(*parts)
        return made

    a, b = (nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")) for s in "ab")
    pairs = shared.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(shared.where("head < before and before < node").select(F.col("before").alias("a"), F.col("node").alias("b"))).distinct()
    pairs = written(pairs, "pairs")
    k = rounds(pairs.count())
    near = all_of([written(pairs.where(in_round(k, r, "b")).join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near(num, den), "a long, b long, far double"), "near-pairs") for r in range(k)], "near-pairs")
    discard(pairs)

    def verified(candidates: DataFrame) -> DataFrame:
        ids = written(candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct(), "pair-nodes")
        texts = _matching(source, ids, "left_semi")
        a, b = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        # b first: candidates have few rows a b, while an a may be the head of many
        return candidates.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_linked(n, num, den), "a long, b long")

    def parts(links: DataFrame) -> DataFrame:
        found = components(links)
        return written(nodes.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp")), "parts")

    def across(candidates: DataFrame, comp: DataFrame) -> DataFrame:
        x, y = (comp.select(F.col("rep").alias(s), F.col("comp").alias(f"comp_{s}")) for s in "ab")
        return candidates.join(x, "a").join(y, "b").where("comp_a <> comp_b").select("a", "b")

    # each set's nearest partner first; then what still lies across components
    best = near.groupBy("b").agg(F.min_by("a", "far").alias("a")).select("a", "b")
    links = written(verified(best).unionByName(same), "links")
    comp = parts(links)
    rest = written(across(near, comp), "near-pairs")
    more = written(verified(rest), "links") if not rest.isEmpty() else rest
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = parts(links)

    def in_parts(buckets: DataFrame) -> DataFrame:
        return buckets.select("sig", "node").join(comp.select(F.col("rep").alias("node"), "comp"), "node")

    def open_buckets(held: DataFrame, least: int, most: int | None = None) -> DataFrame:
        """sig, sets of the buckets that hold several components."""
        found = held.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("sets")).where(f"lo <> hi and sets >= {least}")
        return (found if most is None else found.where(f"sets <= {most}")).select("sig", "sets")

    def compared(held: DataFrame, sketched: DataFrame, buckets: DataFrame, name: str, nodes_only: bool = False) -> DataFrame:
        """What ``_cross_pairs`` finds in open buckets: a row for each pair of blocks of a bucket that a set is in, as many rows a round as disk has room for."""
        sets = held.join(buckets.select("sig", F.ceil(F.col("sets") / block).alias("blocks")), "sig")
        sets = written(sets.select("sig", "node", "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own")), "open-sets")
        k = rounds(sets.agg(F.sum("blocks")).first()[0] or 0)
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).cast("int")
        found = []
        for r in range(k):
            others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
            if k > 1:
                others = F.filter(others, lambda o, r=r: in_round(k, r, "sig", F.least("own", o), F.greatest("own", o)))
            cells = sets.withColumn("others", others).where(F.size("others") > 0).join(sketched.select("node", "n", "sketch"), "node").withColumn("other", F.explode("others"))
            cells = cells.select("sig", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), side.alias("side"), "node", "comp", "n", "sketch")
            cells = cells.repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj")
            found.append(written(cells.mapInArrow(_cross_pairs(num, den, nodes_only), "node long" if nodes_only else "a long, b long").distinct(), name))
        discard(sets)
        return all_of(found, name)

    def left_over(held: DataFrame, least: int, most: int | None) -> DataFrame:
        """Pairs of different components that larger sketches allow: which sets have a partner by the small sketch, then pairs of those."""
        close = compared(held, nodes, open_buckets(held, least, most), "open-nodes", nodes_only=True)
        if close.isEmpty():
            return close.select(F.col("node").alias("a"), F.col("node").alias("b"))
        fine = written(_matching(source, close, "left_semi").mapInArrow(_describe(n, FINE), DESCRIBED).select("node", "n", "sketch").dropDuplicates(["node"]), "fine-sketches")
        few = written(_matching(held.join(open_buckets(held, least, most), "sig", "left_semi"), close, "left_semi"), "open-parts")
        found = compared(few, fine, open_buckets(few, 2), "open-pairs")
        discard(fine, few)
        return found

    held = written(in_parts(shared), "bucket-parts")
    discard(shared)
    # the first set of a bucket has been compared with all others, so buckets of two need no more
    left = left_over(held, 3, large)
    again = written(held.join(open_buckets(held, large + 1), "sig", "left_semi").select("node").distinct(), "sets-of-large-buckets")
    discard(held)
    if not again.isEmpty():
        sized = nodes.join(again, "node", "left_semi").select("node", "n")
        bands = Bands(num, den, 5, 2)
        bands.upto(sized.agg(F.max("n")).first()[0])
        sized = written(sized.select("node", F.size(F.filter(F.lit(bands.tops), lambda top: top < F.col("n"))).alias("band")), "sized-sets")
        parts_of = [left]
        for only in signing_rounds({r["band"]: r["count"] for r in sized.groupBy("band").count().collect()}, bands, signed_at_once):
            signing = sized.where((F.col("band") >= only[0] - 1) & (F.col("band") < only[1])).select("node")
            anew = written(in_parts(_matching(source, signing, "left_semi").mapInArrow(_sign(n, bands, only), "sig long, node long")), "bucket-parts")
            parts_of.append(left_over(anew, 2, None))
            discard(anew)
        left = written(reduce(DataFrame.unionByName, parts_of).distinct(), "open-pairs")
    if not left.isEmpty():
        comp = parts(links.unionByName(written(verified(left), "links")))

    of_doc = by_doc.join(comp, "rep").select("doc", "comp")
    if further is not None:
        # a component is named by the smallest id, not by a node made for a further text
        of_doc = of_doc.join(of_doc.groupBy("comp").agg(F.min("doc").alias("name")), "comp").select("doc", F.col("name").alias("comp")).distinct()
        rows = rows.join(further.select(F.col("own").alias("__own"), F.col("node").alias("__doc")), F.col("node") == F.col("__own"), "left").select(F.coalesce("__doc", "node").alias("node"), "n")
    return rows.join(of_doc, F.col("node") == F.col("doc"), "left").select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One text of each component of near copies: that of the smallest doc_id.

    Rows are judged by their own text: different texts of one id are nodes of their
    own, not linked by the id, and come after all ids where one of them has to stay.
    Rows that share id and text stay or go together; null ids stay.
    """
    source, further = _one_text_a_node(docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text")))
    with scratch(docs.sparkSession) as keep:
        gone = link_components(source, n, num, den, id_col="node").where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
        gone = keep(written(gone, "near-copies"))
    if further is None:
        return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    own = further.select(F.col("node").alias("__id"), F.col("__h").alias("__hash"), F.col("own").alias("__own"))
    of_text = (docs["doc_id"] == F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__hash"))
    named = docs.join(own, of_text, "left").withColumn("__node", F.coalesce("__own", docs["doc_id"]))
    return named.join(gone, F.col("__node") == F.col("__gone"), "left_anti").drop("__id", "__hash", "__own", "__node")
