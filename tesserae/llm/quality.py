"""Operator 7: quality classifier by importance resampling.

Two hashed n-gram models, one of target texts (labelled good) and one of all
raw text, give each text its log importance weight: the sum over its n-grams of
log p_target - log p_raw. The target model is shrunk towards the raw one, which
keeps n-grams that were seen a few times from deciding. A text of more than
``length`` n-grams has its weight tempered to that of ``length`` of them, since the
sum of a long text's says more about its length than its quality; shorter texts
keep their own weight. Gumbel noise, a seeded
function of the id, is added, and the k largest sums are the sample (Gumbel
top-k: k draws without replacement in proportion to the tempered weights). Texts
whose weights lie within a few units of the k-th are decided by the draw, those
far from it by their weight; a larger ``length`` leaves less to the draw.

k is given, or the count of rows whose tempered weight reaches that of the
``recall`` share of target rows. There each target row is weighed by a model
that was fitted without it: the target rows are dealt into ``FOLDS`` parts by id
hash, and each part is held out in turn.

Raw counts cover all rows and whole texts. The target models are fitted on at most
``sample`` labelled rows (those of smallest id hash), whose ids are broadcast.
The models are ``buckets`` numbers each, whatever the input; texts are never
shuffled, only counts and scores are.

Defined results: null and empty texts and texts without tokens have a null
weight and are not kept; without labelled target rows every other row is kept;
repeated rows are equal in weight and noise; an empty table gives an empty
result; columns named like the results are refused, others pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written
from .words import ngram_buckets, slices, split_tokens


FOLDS = 8


@dataclass
class Model:
    log_ratio: np.ndarray | None  # of each bucket; None without target rows
    held_out: list[np.ndarray]  # the same, fitted without the target rows of each fold
    n: int


def target_ids(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` ids labelled as good and not toxic."""
    of = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = of.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``docs`` with __fold: the fold of a target row, null for others."""
    fold = targets.select(F.col("doc_id").alias("__t"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("__fold"))
    return docs.join(F.broadcast(fold), docs["doc_id"] == F.col("__t"), "left").drop("__t")  # at most ``sample`` ids


def fit(docs: DataFrame, targets: DataFrame, n: int = 2, buckets: int = 1 << 18, shrink: float = 30.0) -> Model:
    names = [f"t{i}" for i in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros((FOLDS, buckets), np.int64)
        for b in batches:
            folds = b.column("__fold").fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in slices(b.column("text")):
                bucket, doc = ngram_buckets(split_tokens(data, offsets), n, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                of = folds[i:j][doc]
                for k in range(FOLDS):
                    target[k] += np.bincount(bucket[of == k], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), *(pa.array(t[seen]) for t in target)], names=["bucket", "raw", *names])

    rows = _marked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), targets).select("text", "__fold")
    counted = rows.mapInArrow(count, "bucket int, raw long, " + ", ".join(f"{t} long" for t in names))
    # counts of at most ``sample`` texts fit an int; at most ``buckets`` rows
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), *(F.sum(t).cast("int").alias(t) for t in names)).toPandas()
    raw, target = np.zeros(buckets), np.zeros((FOLDS, buckets))
    raw[found["bucket"]] = found["raw"]
    for k, t in enumerate(names):
        target[k][found["bucket"]] = found[t]

    def log_ratio(of: np.ndarray) -> np.ndarray:
        return np.log((of + shrink) / (raw * (of.sum() / max(raw.sum(), 1)) + shrink)).astype(np.float32)

    whole = target.sum(0)
    return Model(log_ratio(whole) if whole.sum() else None, [log_ratio(whole - t) for t in target], n)


def weights(model: Model, text: Column, length: float, fold: Column | None = None) -> Column:
    """struct<log_weight, tempered> of a text, null without n-grams; for rows with a fold by the model fitted without it, if ``fold`` is given."""
    none = np.zeros(1, np.float32)

    @F.arrow_udf("struct<log_weight:double,tempered:double>")
    def weigh(texts: pa.Array, folds: pa.Array) -> pa.Array:
        sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
        at = folds.fill_null(-1).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in slices(texts):
            whole = none if model.log_ratio is None else model.log_ratio
            bucket, doc = ngram_buckets(split_tokens(data, offsets), model.n, len(whole))
            total = np.bincount(doc, whole[bucket], j - i)
            of = at[i:j]
            for k in set(of[of >= 0].tolist()):
                mine = (of == k)[doc]
                total = np.where(of == k, np.bincount(doc[mine], model.held_out[k][bucket[mine]], j - i), total)
            sums.append(total)
            counts.append(np.bincount(doc, minlength=j - i))
        total, count = np.concatenate(sums), np.concatenate(counts)
        return pa.StructArray.from_arrays([pa.array(total, mask=count == 0), pa.array(total * np.minimum(1.0, length / np.maximum(count, 1)), mask=count == 0)], names=["log_weight", "tempered"])

    return weigh(F.coalesce(text, F.lit("")), F.lit(None).cast("int") if fold is None else fold)


def gumbel(id_col: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keyed: DataFrame, k: int, bins: int = 4096) -> tuple[float, int | None] | None:
    """(key, doc_id) of the k-th row by key, then id, both descending; None if k is 0 or there are no rows.

    Counts by bin narrow the range until the bin that holds the k-th row is small; only its rows are sorted.
    """
    rows = keyed.where("key is not null")
    if k <= 0:
        return None
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n:
        return None
    k = min(k, n)
    while n > 100_000 and high > low:
        inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
        bin_of = F.least(F.floor((F.col("key") - low) / (high - low) * bins), F.lit(bins - 1))
        counts = sorted(inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: -r["bin"])
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] == n:
            break
        low, high, n = r["low"], r["high"], r["n"]
    inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
    order = Window.orderBy(F.col("key").desc(), F.col("doc_id").desc_nulls_last())
    at = inside.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).first()
    return at["key"], at["doc_id"]


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, recall: float = 0.998, seed: int = 0, sample: int = 50_000, n: int = 2, buckets: int = 1 << 18, length: float = 100.0) -> DataFrame:
    """The rows of ``docs`` with log_weight, gumbel_key and kept."""
    if clash := {"log_weight", "gumbel_key", "kept", "__w"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    with scratch(docs.sparkSession):  # the result reads none of the tables
        targets = written(target_ids(labels, sample), "targets")
        model = fit(docs, targets, n, buckets)
        scored = docs.withColumn("__w", weights(model, docs["text"], length))
        scored = scored.withColumn("log_weight", F.col("__w.log_weight")).withColumn("gumbel_key", F.col("__w.tempered") + gumbel(docs["doc_id"], seed))
        if model.log_ratio is None and k is None:
            return scored.withColumn("kept", F.col("gumbel_key").isNotNull()).drop("__w")
        keyed = written(scored.select("doc_id", F.col("__w.tempered").alias("tempered"), F.col("gumbel_key").alias("key")), "gumbel-keys")
        if k is None:
            held = _marked(docs.select("doc_id", "text"), targets).where("__fold is not null")
            floor = held.select(weights(model, F.col("text"), length, F.col("__fold"))["tempered"].alias("w")).agg(F.percentile("w", F.lit(1 - recall))).first()[0]
            k = keyed.where(F.col("tempered") >= floor).count() if floor is not None else keyed.count()
        cut = kth_largest(keyed, k)
        if cut is None:
            return scored.withColumn("kept", F.lit(False)).drop("__w")
        key, last = cut
        tie = (F.col("gumbel_key") == key) & (F.lit(True) if last is None else docs["doc_id"] >= last)
        return scored.withColumn("kept", F.coalesce((F.col("gumbel_key") > key) | tie, F.lit(False))).drop("__w")
