"""Operator 9: exact dedup by content-defined chunk recipes.

A text (A-Z folded to lower case) is cut into content-defined chunks; its recipe
is the ordered list of its chunks' identifiers. An identifier is a digest that
has been verified: distinct (digest, chunk) pairs are gathered once, folded
within each task first, and a digest that stands for two different chunks is a
clash; texts that hold a clashing digest carry their chunks themselves in the
key. So texts are equal exactly when their keys are, and after the one pass
over distinct chunks only recipes move, never whole texts.

Groups are counted with partial aggregation and joined back to the recipes; a
group that holds a third of the rows is folded to a row per task, and its side
of the join can be split.

Defined results: null text counts as empty, and all empty texts are one group;
of equal texts the largest doc_id stays (in ``group_copies`` a repeated row that
ties with itself is marked as kept each time, ``drop_copies`` keeps one of them; a
null id is smaller than all others); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.chunking import ChunkSpec, cut_points, default_gear

from .shared import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPEC = ChunkSpec(target=4096, min_divisor=4, max_multiplier=4)


def normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)


def _chunks(data: bytes, spec: ChunkSpec, gear) -> list[bytes]:
    cuts = cut_points(data, spec, gear)
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def recipes(docs: DataFrame, id_col: str, text_col: str, spec: ChunkSpec, digest_bytes: int) -> DataFrame:
    """doc_id, recipe array<binary>, text_sha256."""
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = default_gear()
        for b in batches:
            offsets, ids, whole = [0], [], []
            for x in b.column("data"):
                data = x.as_py()
                ids += [hashlib.sha256(c).digest()[:digest_bytes] for c in _chunks(data, spec, gear)]
                offsets.append(len(ids))
                whole.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.binary())), pa.array(whole, pa.string())], names=["doc_id", "recipe", "text_sha256"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, recipe array<binary>, text_sha256 string")


def clashes(docs: DataFrame, text_col: str, spec: ChunkSpec, digest_bytes: int) -> DataFrame:
    """Digests that stand for more than one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = default_gear()
        for b in batches:
            chunks = {c for x in b.column("data") for c in _chunks(x.as_py(), spec, gear)}
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).digest()[:digest_bytes] for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], names=["chunk_id", "chunk"])

    pairs = docs.select(normalised(text_col).cast("binary").alias("data")).mapInArrow(run, "chunk_id binary, chunk binary")
    return pairs.distinct().groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")


def keyed(docs: DataFrame, id_col: str, text_col: str, spec: ChunkSpec = SPEC, digest_bytes: int = 32) -> DataFrame:
    """doc_id, text_sha256 and key: equal for equal texts and for no others."""
    made = written(recipes(docs, id_col, text_col, spec, digest_bytes), "recipes")
    bad = written(clashes(docs, text_col, spec, digest_bytes), "clashes")
    plain = made.select("doc_id", "text_sha256", F.col("recipe").alias("key"))
    if bad.isEmpty():
        return plain
    # rows whose recipe has a clashing digest get the text itself as the last item of the key
    hit = made.select("text_sha256", F.explode("recipe").alias("chunk_id")).join(bad, "chunk_id", "left_semi").select("text_sha256").distinct()
    texts = docs.select(normalised(text_col).cast("binary").alias("data")).withColumn("text_sha256", F.sha2("data", 256)).join(hit, "text_sha256", "left_semi").groupBy("text_sha256", "data").count()
    return plain.join(texts.select("text_sha256", "data"), "text_sha256", "left").select("doc_id", "text_sha256", F.when(F.col("data").isNull(), F.col("key")).otherwise(F.array_append("key", F.col("data"))).alias("key"))


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: ChunkSpec = SPEC, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = keyed(docs, id_col, text_col, spec, digest_bytes)
    groups = written(rows.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "copy-groups")
    return rows.join(groups, "key").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, with its columns: of the largest id, which may be null or stand for several texts; of rows that share id and text one stays."""
    at = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    with scratch(docs.sparkSession) as keep:
        groups = group_copies(docs, id_col, text_col)
        gone = keep(written(groups.where(~F.col("kept")).select(*at).distinct(), "exact-copies"))
        tied = keep(written(groups.where("kept").select(*at).groupBy("__id", "__sha").count().where("count > 1").drop("count"), "tied-copies"))
    rows = docs.withColumn("__text", F.sha2(normalised(text_col).cast("binary"), 256))
    same = rows[id_col].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha"))
    rows = rows.join(gone, same, "left_anti")
    if not tied.isEmpty():
        rows = rows.join(tied, same, "left_anti").unionByName(rows.join(tied, same, "left_semi").dropDuplicates([id_col, "__text"]))
    return rows.drop("__text")
