"""Compaction of metadata shards by their real sizes, and the relations that come out of it.

A shard's bytes are those of its parts: a file's record, its verification entries,
its metadata entry, a container with its chunks. A union holds each part once, from
the first shard that has it. So what a shard adds to a union that begins at some
shard are its parts whose last occurrence before lies ahead of that one: parts are
summed by (shard, place of the last occurrence) before anything is folded, and a
fold meets at most a row for each pair of shards of a stretch of creation time,
never the parts themselves.

Records of one file have as many segments in every shard; keys are not null, rows
with null keys belong to no union and are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import RECORD

#: Bytes of an entry of the lookup tables by file or container, and by chunk.
LOOKUP, CHUNK_LOOKUP = 12, 16
VERIFICATION, METADATA = 31, 30


def has(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(1 << bit)) != 0


def parts(files: DataFrame, containers: DataFrame) -> DataFrame:
    """shard_id, part, bytes of files(shard_id, file_hash, flags, n_segments) and containers(shard_id, container_hash, n_chunks); a part that a shard has twice counts once."""
    n = F.col("n_segments")
    of = lambda kind, size: F.struct(F.lit(kind).alias("kind"), size.cast("long").alias("bytes"))
    each = F.array(of("file", RECORD * (1 + n) + LOOKUP), F.when(has(VERIFICATION), of("verification", RECORD * n)), F.when(has(METADATA), of("metadata", F.lit(RECORD))))
    rows = files.where("file_hash is not null").select("shard_id", "file_hash", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p"))
    rows = rows.select("shard_id", F.struct(F.col("p.kind").alias("kind"), F.col("file_hash").alias("hash")).alias("part"), F.col("p.bytes").alias("bytes"))
    size = RECORD * (1 + F.col("n_chunks")) + LOOKUP + CHUNK_LOOKUP * F.col("n_chunks")
    held = containers.where("container_hash is not null").select("shard_id", F.struct(F.lit("container").alias("kind"), F.col("container_hash").alias("hash")).alias("part"), size.cast("long").alias("bytes"))
    return rows.unionByName(held).groupBy("shard_id", "part").agg(F.max("bytes").alias("bytes"))


def merge_plan(shards: DataFrame, parts: DataFrame, by: str, target: int, overhead: int, span: int) -> DataFrame:
    """by, stretch, place, shard_id, size, merge_group, merged_size of shards(by, shard_id, created).

    Shards of each ``by`` and stretch of ``span`` units of creation time, in order of
    creation, are merged while the union so far and the next shard, less one
    ``overhead`` (header and footer), stay within the target; what counts for the one
    after is the size of the union made, in which shared parts are held once.
    """
    stretch = F.floor(F.col("created") / span)
    order = Window.partitionBy(by, "stretch").orderBy("created", "shard_id")  # shards of a stretch
    placed = shards.select(by, stretch.alias("stretch"), "shard_id", "created").withColumn("place", F.row_number().over(order)).drop("created")
    seen = Window.partitionBy(by, "stretch", "part").orderBy("place")  # shards of a stretch that hold a part
    growth = parts.join(placed, "shard_id").withColumn("before", F.coalesce(F.lag("place").over(seen), F.lit(0)))
    growth = growth.groupBy(by, "stretch", "place", "before").agg(F.sum("bytes").alias("bytes"))
    # shards without parts take part with their overhead
    rows = growth.unionByName(placed.select(by, "stretch", "place", F.lit(0).alias("before"), F.lit(0).cast("long").alias("bytes")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group, start, held = [], -1, 0, 0
        for place, mine in pdf.groupby("place", sort=True):
            size = overhead + int(mine["bytes"].sum())
            if group < 0 or held + size - overhead > target:
                group, start, held = group + 1, place, size
            else:
                held += int(mine["bytes"][mine["before"] < start].sum())
            out.append((place, size, group, held))
        found = pd.DataFrame(out, columns=["place", "size", "merge_group", "merged_size"])
        found["merged_size"] = found.groupby("merge_group")["merged_size"].transform("last")
        return found.assign(**{by: pdf[by].iloc[0], "stretch": pdf["stretch"].iloc[0]})[[by, "stretch", "place", "size", "merge_group", "merged_size"]]

    schema = f"{by} {rows.schema[by].dataType.simpleString()}, stretch long, place int, size long, merge_group long, merged_size long"
    return placed.join(rows.groupBy(by, "stretch").applyInPandas(fold, schema), [by, "stretch", "place"])


def destinations(plan: DataFrame, by: str) -> DataFrame:
    """shard_id, place, into, state: the smallest id of its group is where a shard goes; obsolete if it is merged with others, skipped if alone."""
    group = Window.partitionBy(by, "stretch", "merge_group")
    return plan.select("shard_id", "place", F.min("shard_id").over(group).alias("into"), F.when(F.count("*").over(group) > 1, "obsolete").otherwise("skipped").alias("state"), "merged_size")


def merged_files(files: DataFrame, to: DataFrame) -> DataFrame:
    """shard_id, file_hash, flags, n_segments, and which shard the record, its verification and its metadata come from: the first that has them."""
    at = lambda *more: F.struct("place", F.col("shard_id").alias("shard"), *more)
    rows = files.where("file_hash is not null").join(to.select("shard_id", "place", "into"), "shard_id")
    out = rows.groupBy("into", "file_hash").agg(
        F.bit_or("flags").alias("flags"), F.min(at("n_segments")).alias("f"), F.min(F.when(has(VERIFICATION), at())).alias("v"), F.min(F.when(has(METADATA), at())).alias("m")
    )
    return out.select(F.col("into").alias("shard_id"), "file_hash", "flags", "f.n_segments", F.col("f.shard").alias("record_from"), F.col("v.shard").alias("verification_from"), F.col("m.shard").alias("metadata_from"))


def merged_containers(containers: DataFrame, to: DataFrame) -> DataFrame:
    """shard_id, container_hash, n_chunks, record_from: each container once a merged shard, from the first that has it."""
    rows = containers.where("container_hash is not null").join(to.select("shard_id", "place", "into"), "shard_id")
    out = rows.groupBy("into", "container_hash").agg(F.min(F.struct("place", F.col("shard_id").alias("shard"), "n_chunks")).alias("c"))
    return out.select(F.col("into").alias("shard_id"), "container_hash", "c.n_chunks", F.col("c.shard").alias("record_from"))


def taken_over(rows: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Rows that hang on a record (segments of files, chunks of containers), each from the shard its record came from, under the merged shard's id."""
    owner = merged.select(key, F.col("record_from").alias("shard_id"), F.col("shard_id").alias("into"))
    return rows.join(owner, [key, "shard_id"]).withColumn("shard_id", F.col("into")).drop("into").select(*rows.columns)
