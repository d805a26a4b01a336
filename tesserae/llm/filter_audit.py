"""Operator 12: an audit of how filters interact, over a packed bitmap index.

Every row gets a bit for each filter that it fails, for each label and for its
part. Tasks pack the bits of a block of rows into bitsets, ordered by part so that
a part is a run of words; for each set of filters that may have been applied
before and each filter that may come next, the bitset of the next is taken without
those of the set (AND-NOT), within the part, and its bits are counted. There are 80
such steps for five filters, of which all 600 steps of the 120 orders are made;
counts are sums, so blocks and partitions are added up. No row leaves its task
after that, and what does is 80 rows a part and block.

The filter that looks at the whole table (is the text that of a row with a smaller
id?) needs each text's smallest id: narrow rows of digests are grouped for it.
Digests that hold a ``HEAVY``th of all rows or more, of which there are at most
``HEAVY``, are broadcast; the others are joined by a shuffle. Texts are read once.

Defined results: a null text counts as empty; a null part and the empty one are one
part; a row with a null id has no labels, is no other row's smaller one, and fails
no comparison; of rows that share the smallest id none fails it; repeated label
rows count as set if any is; further columns are ignored; an empty table gives no
rows. Words are told apart by 64-bit hashes, texts by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text_stats import UPPER, _class, code_points, distinct, members
from .words import slices, split_words

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
#: A digest of so large a share of all rows is broadcast.
HEAVY = 1000
#: Rows of one packed block: a bitset of it has 128 KB.
BLOCK_ROWS = 1 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A 1, B 2, C 4, D 8."""
    symbols = _class(SYMBOLS)

    @F.arrow_udf("int")
    def judge(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int32)]
        for _, _, data, offsets in slices(texts):
            words = split_words(data, offsets, fold=False)
            n = np.diff(words.first)
            fails = (n < 100, 100 * distinct(words.hash, words.first) < 80 * n, 100 * members(data, offsets, UPPER) > 10 * code_points(data, offsets), members(data, offsets, symbols) > 0)
            out.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
        return pa.array(np.concatenate(out), pa.int32())

    return judge(text)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits of the failed filters, good and toxic of each row."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = written(source.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("bits")), "failures")
    known = rows.where("doc_id is not null")
    groups = written(known.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("n")).where("smallest < largest").select("digest", "smallest", "n"), "equal-texts")
    least = known.count() / HEAVY
    heavy, light = groups.where(F.col("n") >= least).drop("n"), groups.where(F.col("n") < least).drop("n")
    # at most HEAVY groups have so many rows
    first = known.join(F.broadcast(heavy), "digest")
    rest = known.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left")
    judged = first.unionByName(rest).withColumn("bits", F.col("bits") + F.when(F.col("doc_id") > F.col("smallest"), 16).otherwise(0))
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    labelled = judged.join(of, F.col("doc_id") == F.col("__d"), "left").select("part", "bits", flag("good"), flag("toxic"))
    return labelled.unionByName(rows.where("doc_id is null").select("part", "bits", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def _packed(bits: np.ndarray) -> np.ndarray:
    """A bitset of booleans in 64-bit words."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)


def _bits(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum(dtype=np.int64))


def block_counts(part: np.ndarray, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int) -> Iterator[tuple]:
    """(part number, filters before, next filter, the seven counts) of each part of a block and each step."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    fails = [_packed((bits[order] >> f) & 1 == 1) for f in range(n_filters)]
    marks = [_packed(x[order]) for x in (good, toxic)]
    empty = np.zeros(len(fails[0]), np.uint64)
    union = [empty]
    for s in range(1, 1 << n_filters):
        union.append(union[s & (s - 1)] | fails[(s & -s).bit_length() - 1])
    every = (1 << n_filters) - 1
    # the orders in which a set of so many filters comes before, and the others after
    fact = [1]
    for i in range(1, n_filters + 1):
        fact.append(fact[-1] * i)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = a // 64, -(-b // 64)
        member = np.zeros((hi - lo) * 64, bool)
        member[a - 64 * lo : b - 64 * lo] = True
        member = _packed(member)
        for f in range(n_filters):
            fail = fails[f][lo:hi] & member
            n_fail, alone = _bits(fail), _bits(fail & ~union[every & ~(1 << f)][lo:hi])
            steps, shapley = [], 0
            for s in range(1 << n_filters):
                if s >> f & 1:
                    continue
                removed = fail & ~union[s][lo:hi]
                n_removed = _bits(removed)
                kept = _bits(member & ~union[s | 1 << f][lo:hi])
                k = s.bit_count()
                shapley += fact[k] * fact[n_filters - 1 - k] * n_removed
                steps.append((s, kept, n_removed, n_fail - n_removed, alone, *(_bits(removed & m[lo:hi]) for m in marks)))
            for s, *counted in steps:
                yield (int(part[a]), s, f, *counted, shapley)


def step_counts(rows: DataFrame, n_filters: int = len(FILTERS), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows(part, bits, good, toxic) -> part, before (bits of the filters applied), filter (its number), ``COUNTS``."""
    names = ["part", "before", "filter", *COUNTS]

    def emitted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks()
        codes = block.column("part").combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        column = lambda c: block.column(c).to_numpy()
        found = list(block_counts(codes.indices.to_numpy(), column("bits"), column("good"), column("toxic"), n_filters))
        columns = list(zip(*found))
        arrays = [codes.dictionary.take(pa.array(columns[0], pa.int32())), *(pa.array(c, pa.int32()) for c in columns[1:3]), *(pa.array(c, pa.int64()) for c in columns[3:])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= block_rows:
                yield emitted(held)
                held, n = [], 0
        if held:
            yield emitted(held)

    made = rows.select("part", "bits", "good", "toxic").mapInArrow(run, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark, names: str = FILTERS) -> DataFrame:
    """filter_order, step, before, filter: a row for each step of each order of the filters."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and ``COUNTS``, for each part of docs(doc_id, text, lang) and each step of each order."""
    counted = step_counts(failures(docs, labels))
    # 600 rows
    return counted.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"]).select("part", "filter_order", "step", *COUNTS)
