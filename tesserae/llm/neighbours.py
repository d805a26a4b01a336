"""Operator 10: nearest neighbours by inner product.

An inverted file of coarse centroids with product-quantised residuals. Centroids
and codebooks are fitted by k-means on a bounded sample (the ``sample`` rows of
smallest id hash); every row is indexed: its list, its codes, and how far the
decoded vector is from it.

A first pass scores each query's ``probes`` nearest lists by the decoded vectors and
reranks the best (``rerank``, or more where the sample shows that a dense list needs
it) exactly. Its k-th best score is one that the result has to reach, and all that it
gives. The second pass leaves out only what can't reach it: a list by its centroid and
its farthest row, a row by its decoded vector and the distance to it
(Cauchy-Schwarz, with room for rounding); where that leaves much, by products in single precision. What is left is scored exactly, in double
precision, on the original vectors; ties go to the smaller vec_id. So the result is that of
brute force whatever the rows are like; what depends on them is how much is left out: most
lists for vectors that cluster, hardly any without structure, where the second pass is
a product of all queries with all decoded rows.

Lists are packed into bins of at most ``bin_rows`` rows and longer ones are split, queries
are dealt into blocks of that size, so a list that holds a third of the rows is spread over many tasks. In the first
pass a list is cut into blocks of about ``block`` rows, and its queries too. Only
the fitted tables (bounded by parameters) travel with the code; rows and
queries meet by shuffle, and each task sends at most k rows a query onward.

Defined results: vectors that are null or zero, or that hold null or non-finite
components take no part; an inner product needs equal lengths, so a query's candidates are
the rows of its length (the index is that of the sample's most frequent length, the others are
compared without one); scores too large for a
double are infinite and count as such; repeated vec_ids are rows and queries of their own (none of them is a
candidate of a query with the same id); fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: np.ndarray  # parts x codes x width


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    norms = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + rows] @ centres.T - norms, 1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def fit(vectors: np.ndarray, lists: int, parts: int, codes: int = 256, rounds: int = 8, seed: int = 0) -> Index:
    rng = np.random.default_rng(seed)
    x = np.unique(vectors, axis=0).astype(np.float32)  # copies would take centroids of their own
    centroids = _kmeans(x, lists, rounds, rng)
    rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), parts, -1)
    books = [_kmeans(rest[:, m], codes, rounds, rng) for m in range(parts)]
    return Index(centroids, np.stack(books))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    wide = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    v = F.col(vector_col) if wide else F.col(vector_col).cast("array<float>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda c: c != 0))


def _original(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.float32)


def _matrix(column: pd.Series) -> np.ndarray:
    """What the index works on; scores are taken from the original."""
    return np.clip(_original(column), -1e18, 1e18).astype(np.float32)


def _codes(index: Index, x: np.ndarray, of: np.ndarray) -> np.ndarray:
    parts, _, width = index.codebooks.shape
    rest = (x - index.centroids[of]).reshape(len(x), parts, width)
    return np.stack([_nearest(rest[:, m], index.codebooks[m]) for m in range(parts)], 1).astype(np.uint8)


def _decoded(index: Index, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
    parts = index.codebooks.shape[0]
    return index.centroids[of] + index.codebooks[np.arange(parts), codes].reshape(len(of), -1)


def _distance(original: np.ndarray, near: np.ndarray | float) -> np.ndarray:
    """Of each row to ``near``; infinite where ``_matrix`` had to clip."""
    x = original.astype(np.float64)
    big = np.abs(x).max(1, initial=0) > 1e18
    x[big] = 0
    return np.where(big, np.inf, np.linalg.norm(x - near, axis=1))


def exact_scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows[i] and q[i] in double precision, summed in order, so equal vectors score equally."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d].astype(np.float64) * q[:, d].astype(np.float64)
    return total


class Queries:
    """Directions of queries, and what score along them a row must reach."""

    def __init__(self, asked: np.ndarray, least: np.ndarray):
        x = asked.astype(np.float64)
        self.top = np.abs(x).max(1, initial=0)
        x /= self.top[:, None]
        self.norm = np.linalg.norm(x, axis=1)
        self.unit = (x / self.norm[:, None]).astype(np.float32)
        self.least = self.of_scores(least)

    def of_scores(self, scores: np.ndarray, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        """A little less than the scores along unit vectors; -inf where products may be beyond a double."""
        top = self.top[which]
        with np.errstate(all="ignore"):
            t = scores / top / self.norm[which]
        t = np.where(np.isfinite(t) & (top < 1e100) & (top > 1e-100), t, -np.inf)
        return np.nextafter((t - np.abs(t) * 1e-12).astype(np.float32), np.float32(-np.inf))


def _room(vectors: np.ndarray) -> np.ndarray:
    """What rounding may add to products of float32 vectors with a unit vector."""
    return (vectors.shape[1] + 8) * 2.0**-21 * np.linalg.norm(vectors.astype(np.float64), axis=1) + 1e-36


def reach(index: Index, farthest: np.ndarray, longest: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The most that a row of each list can score with each unit vector: ``farthest`` from the centroid and ``longest`` of all."""
    return np.minimum(unit @ index.centroids.T + (farthest * (1 + 1e-6) + _room(index.centroids)), longest * (1 + 1e-5) + 1e-36)


def first_scores(decoded: np.ndarray, ids: np.ndarray, original: np.ndarray, asked: np.ndarray, query_ids: np.ndarray, k: int, rerank: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and exact scores of up to k good rows of one block of a list for each."""
    n, places, scores = min(rerank, len(ids)), [], []
    unit = Queries(asked, np.full(len(asked), -np.inf)).unit
    for at in range(0, len(asked), at_once):
        score = unit[at : at + at_once] @ decoded.T
        score[query_ids[at : at + at_once, None] == ids] = -np.inf
        pick = np.argpartition(-score, n - 1, axis=1)[:, :n]
        place = np.repeat(np.arange(at, at + len(pick)), n)
        exact = exact_scores(original[pick.ravel()], asked[place])
        exact[(query_ids[place] == ids[pick.ravel()]) | np.isnan(exact)] = -np.inf
        best = np.sort(exact.reshape(-1, n), axis=1)[:, ::-1][:, :k]
        places.append(np.repeat(np.arange(at, at + len(pick)), best.shape[1]))
        scores.append(best.ravel())
    return np.concatenate(places), np.concatenate(scores)


def scan(
    near: np.ndarray, off: np.ndarray, ids: np.ndarray, original: np.ndarray, asked: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int, starts: np.ndarray, bound=None, at_once: int = 512, rows_at_once: int = 2048, pairs_at_once: int = 1 << 16
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of these rows for each query, but for those under its ``least`` score: places of queries, row ids, scores.

    ``near`` are vectors that lie ``off`` from the original ones. Rows between two of ``starts`` are one list, of
    which ``bound`` (unit vectors -> queries x lists) tells the highest score.
    """
    up = (off * (1 + 1e-6) + _room(near)).astype(np.float32)
    plain = np.clip(original, -1e18, 1e18).astype(np.float32)
    up_plain = (_distance(original, plain) * (1 + 1e-6) + _room(plain)).astype(np.float32)
    q = Queries(asked, least)
    cuts = [(i, x, min(x + rows_at_once, stop)) for i, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)])) for x in range(start, stop, rows_at_once)]
    out = []
    for at in range(0, len(asked), at_once):
        these = np.arange(at, min(at + at_once, len(asked)))
        high = bound(q.unit[these]) if bound else None
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def best(place, row, score):
            order = np.lexsort((ids[row], -score, np.isnan(score), place))
            place, row, score = place[order], row[order], score[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            last = rank == k - 1
            q.least[place[last]] = np.maximum(q.least[place[last]], q.of_scores(score[last], place[last]))
            return place[rank < k], row[rank < k], score[rank < k]

        for i, x, y in cuts:
            some = these if high is None else these[~(high[:, i] < q.least[these])]
            if not len(some):
                continue
            score = q.unit[some] @ near[x:y].T
            score += up[x:y]
            may = score >= q.least[some, None]
            if 32 * np.count_nonzero(may) > may.size:
                # codes tell too little here: products in single precision leave hardly more than the result
                np.matmul(q.unit[some], plain[x:y].T, out=score)
                score += up_plain[x:y]
                may &= score >= q.least[some, None]
            place, row = np.nonzero(may)
            place, row = some[place], row + x
            other = query_ids[place] != ids[row]
            place, row = place[other], row[other]
            for j in range(0, len(place), pairs_at_once):
                p, r = place[j : j + pairs_at_once], row[j : j + pairs_at_once]
                new = exact_scores(original[r], asked[p])
                kept = tuple(np.concatenate(c) for c in zip(kept, (p, r, new)))
                if len(kept[0]) > 4 * k * at_once:
                    kept = best(*kept)
        out.append(best(*kept))
    place, row, score = (np.concatenate(c) for c in zip(*out))
    return place, ids[row], score


def calibrate(index: Index, sample: np.ndarray, k: int, recall: float, rerank: int, seed: int = 0, asked: int = 256) -> tuple[int, float]:
    """How many lists, and beyond ``rerank`` rows what share of a list, hold ``recall`` of the k nearest sample rows.

    Rows of the whole table are at least as near as those of the sample, so the lists err on the safe side.
    """
    x = np.unique(sample, axis=0)
    q = x[np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)]
    place = np.empty((len(q), len(index.centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(q @ index.centroids.T), axis=1, kind="stable"), np.arange(len(index.centroids))[None, :], 1)
    near = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]  # the first is the row itself
    if not near.size:
        return len(index.centroids), 1.0
    of = _nearest(x, index.centroids)
    probes = int(np.quantile(np.take_along_axis(place, of[near], 1), recall, method="higher")) + 1
    parts, _, width = index.codebooks.shape
    rest = (x - index.centroids[of]).reshape(len(x), parts, width)
    codes = np.stack([_nearest(rest[:, m], index.codebooks[m]) for m in range(parts)], 1)
    members = np.argsort(of, kind="stable")
    first = np.searchsorted(of[members], np.arange(len(index.centroids) + 1))
    shares = []
    for i, row in enumerate(near):
        table = np.einsum("mcw,mw->mc", index.codebooks, q[i].reshape(parts, width))
        for j in row:
            own = members[first[of[j]] : first[of[j] + 1]]
            score = table[np.arange(parts), codes[own]].sum(1)
            better = int((score >= table[np.arange(parts), codes[j]].sum()).sum())
            shares.append(better / len(own) if better > rerank else 0.0)
    return probes, float(np.quantile(shares, recall, method="higher"))


def _packed(counts: dict[int, int], lists: int, most: int) -> tuple[list[int], list[int]]:
    """The first bin of each list and how many it has: short lists share one, longer ones are split."""
    first, pieces, at, full = [], [], 0, 0
    for i in range(lists):
        n = counts.get(i, 0)
        if full and full + n > most:
            at, full = at + 1, 0
        first.append(at)
        pieces.append(max(1, -(-n // most)))
        full += n
        if full >= most:
            at, full = at + pieces[-1], 0
    return first, pieces


FOUND = "query long, query_id long, vec_id long, score double"


def _found(q: pd.DataFrame, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query": q["query"].to_numpy()[place], "query_id": q["query_id"].to_numpy()[place], "vec_id": ids, "score": score})


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query": pd.Series([], dtype="int64"), "query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})


def _compared(rows: DataFrame, asked: DataFrame, k: int, bin_rows: int) -> DataFrame:
    """Rows and queries of each length, without an index."""
    n, m = (max(1, -(-x.count() // bin_rows)) for x in (rows, asked))
    every = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    keys = ["width", "rb", "qb"]
    left = rows.select("vec_id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("rb"), every(m).alias("qb"))
    right = asked.select("query", "query_id", "v", F.size("v").alias("width"), every(n).alias("rb"), F.pmod(F.xxhash64("query"), F.lit(m)).cast("int").alias("qb"))

    def search(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return _nothing()
        near, original, least = _matrix(r["v"]), _original(r["v"]), np.full(len(q), -np.inf)
        return _found(q, *scan(near, _distance(original, near), r["vec_id"].to_numpy(), original, _original(q["v"]), q["query_id"].to_numpy(), least, k, np.zeros(1, np.int64)))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    probes: int | None = None,
    parts: int = 16,
    rerank: int = 40,
    recall: float = 0.97,
    sample: int = 20_000,
    block: int = 4096,
    seed: int = 0,
    bin_rows: int = 131_072,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query.

    ``lists`` defaults to the square root of the row count (16 to 4096), ``probes``, the lists of the first pass, to what holds
    ``recall`` of the nearest rows of the sample, eight at most: what more lists hold is found by the second pass.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    fitted = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(fitted):
        return spark.createDataFrame([], schema)
    sizes = fitted.map(len)
    width = int(sizes.value_counts().sort_index().idxmax())
    asked = asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    of_width, others = F.size("v") == width, F.size("v") != width
    number = rows.where(of_width).count()
    while width % parts:
        parts -= 1
    if lists is None:
        lists = int(min(4096, max(16, number**0.5)))
    fitted = _matrix(fitted[sizes == width])
    index = fit(fitted, lists, parts, seed=seed)
    lists = len(index.centroids)
    wanted, share = calibrate(index, fitted, k, recall, rerank, seed)
    probes = min(lists, probes or min(wanted, 8))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, original = _matrix(b["v"]), _original(b["v"])
                of = _nearest(x, index.centroids)
                codes = _codes(index, x, of)
                yield b.assign(list=of.astype(np.int32), code=[c.tobytes() for c in codes], off=_distance(original, _decoded(index, of, codes)), rest=_distance(original, index.centroids[of]), long=_distance(original, 0.0))

    @F.pandas_udf("array<int>")
    def lists_of(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.argsort(-(_matrix(v) @ index.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    kind = rows.schema["v"].dataType.simpleString()
    indexed = written(rows.where(of_width).mapInPandas(encode, f"row long, vec_id long, v {kind}, list int, code binary, off double, rest double, long double"), "ivf-rows")
    queried = written(asked.where(of_width).withColumn("lists", lists_of("v")), "ivf-queries")
    probed = queried.select("query", "query_id", "v", F.explode("lists").alias("list"))
    # at most ``lists`` rows each
    of_lists = {r["list"]: r for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("rest").alias("rest"), F.max("long").alias("long")).collect()}
    row_blocks = {i: -(-r["n"] // block) for i, r in of_lists.items()}
    query_blocks = {r["list"]: -(-r["count"] // block) for r in probed.groupBy("list").count().collect()}
    numbers = lambda xs: F.element_at(F.array(*(F.lit(int(x)) for x in xs)), F.col("list") + 1)
    table = lambda d: numbers(d.get(i, 1) for i in range(lists))
    spread = lambda df, key, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(key), table(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), table(n_other).cast("long") - 1)))
    decoded = lambda r: _decoded(index, r["list"].to_numpy(), np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1))
    keys = ["list", "rb", "qb"]
    left = spread(indexed.select("row", "vec_id", "v", "list", "code"), "row", "rb", row_blocks, "qb", query_blocks)
    right = spread(probed, "query", "qb", query_blocks, "rb", row_blocks)

    def first(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        place, score = first_scores(decoded(r), r["vec_id"].to_numpy(), _original(r["v"]), _original(q["v"]), q["query_id"].to_numpy(), k, max(rerank, int(np.ceil(share * len(r)))))
        return pd.DataFrame({"query": q["query"].to_numpy()[place], "score": score})

    good = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(first, "query long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    least = good.withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("least"))

    farthest, longest = (np.array([of_lists[i][c] if i in of_lists else -np.inf for i in range(lists)]) for c in ("rest", "long"))
    # tables that fill few bins are cut finer, so that they are some tasks
    first_bin, pieces = _packed({i: r["n"] for i, r in of_lists.items()}, lists, max(block, min(bin_rows, number // 24)))
    last_bin = np.array(first_bin) + np.array(pieces)
    n_blocks = max(1, -(-queried.count() // bin_rows))

    @F.pandas_udf("array<int>")
    def bins_of(v: pd.Series, least: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        q = Queries(_original(v), least.fillna(-np.inf).to_numpy(np.float64))
        open_ = (~(reach(index, farthest, longest, q.unit) < q.least[:, None])) & (longest >= 0)
        return pd.Series([np.unique(np.concatenate([np.zeros(0, np.int32)] + [np.arange(first_bin[i], last_bin[i], dtype=np.int32) for i in np.flatnonzero(o)])) for o in open_])

    keys = ["bin", "qb"]
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = indexed.select("vec_id", "v", "list", "code", "off", (numbers(first_bin) + F.pmod(F.xxhash64("row"), numbers(pieces))).cast("int").alias("bin"), every.alias("qb"))
    right = queried.join(least, "query", "left").select("query", "query_id", "v", "least", F.explode(bins_of("v", F.col("least"))).alias("bin"), F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int").alias("qb"))

    def search(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return _nothing()
        r = r.sort_values("list", kind="stable")
        own, starts = np.unique(r["list"].to_numpy(), return_index=True)
        part = Index(index.centroids[own], index.codebooks)
        bound = lambda unit: reach(part, farthest[own], longest[own], unit)
        least = q["least"].fillna(-np.inf).to_numpy(np.float64)
        return _found(q, *scan(decoded(r), r["off"].to_numpy(), r["vec_id"].to_numpy(), _original(r["v"]), _original(q["v"]), q["query_id"].to_numpy(), least, k, starts, bound))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
    rest = written(rows.where(others), "other-rows")
    if not rest.isEmpty():
        found = found.unionByName(_compared(rest, written(asked.where(others).withColumn("query", -1 - F.col("query")), "other-queries"), k, bin_rows))
    best = Window.partitionBy("query").orderBy(F.isnan("score"), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
