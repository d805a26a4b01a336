"""Dedup against an index of known chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_locations(chunks: DataFrame) -> DataFrame:
    """chunk_hash, file_id, chunk_idx, length of each chunk's first place. A minimum, so copies fold before the shuffle."""
    first = chunks.groupBy("chunk_hash").agg(F.min(F.struct("file_id", "chunk_idx", "length")).alias("at"))
    return first.select("chunk_hash", "at.file_id", "at.chunk_idx", "at.length")


def flag_new(chunks: DataFrame) -> DataFrame:
    """chunks with is_new: whether this is the chunk's first place.

    First places are joined by place, not by hash: places are spread evenly, while
    one hash, such as a blank line's, may hold a large share of the rows.
    """
    first = first_locations(chunks).select("file_id", "chunk_idx", F.lit(True).alias("is_new"))
    return chunks.join(first, ["file_id", "chunk_idx"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def dedup_metrics(flagged: DataFrame, *by: str) -> DataFrame:
    new = F.col("is_new")
    out = flagged.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.sum("length").alias("total_bytes"),
        F.sum(new.cast("long")).alias("new_chunks"),
        F.sum(F.when(new, F.col("length")).otherwise(0)).alias("new_bytes"),
    )
    return with_shares(out)


def dedup_totals(chunks: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """The same by a label of the file, labels(file_id, by): all chunks are summed as they are read, new ones over first places; no chunk row is joined to another."""
    total = chunks.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    new = first_locations(chunks).groupBy("file_id").agg(F.count("*").alias("nn"), F.sum("length").alias("nb"))
    j = labels.join(total, "file_id").join(new, "file_id", "left").groupBy(by)
    out = j.agg(F.sum("n").alias("total_chunks"), F.sum("b").alias("total_bytes"), F.coalesce(F.sum("nn"), F.lit(0)).alias("new_chunks"), F.coalesce(F.sum("nb"), F.lit(0)).alias("new_bytes"))
    return with_shares(out)


def with_shares(out: DataFrame) -> DataFrame:
    out = out.withColumn("deduped_chunks", F.col("total_chunks") - F.col("new_chunks")).withColumn("deduped_bytes", F.col("total_bytes") - F.col("new_bytes"))
    return out.withColumn("dedup_ratio", F.round(F.coalesce(F.col("deduped_bytes") / F.nullif(F.col("total_bytes"), F.lit(0)), F.lit(0.0)), 6))


def runs_against_index(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Longest runs of consecutive chunks that match consecutive chunks of one indexed file.

    index(chunk_hash, target, target_idx) holds one place a chunk, as a stored table,
    so that adaptive execution can split a hash that many chunks have. On a run the
    difference of the places is constant, so runs are the gapless stretches of
    each (file, target, difference).
    """
    hits = chunks.join(index, "chunk_hash").withColumn("diagonal", F.col("chunk_idx") - F.col("target_idx"))
    order = Window.partitionBy("file_id", "target", "diagonal").orderBy("chunk_idx")
    islands = hits.withColumn("island", F.col("chunk_idx") - F.row_number().over(order))
    runs = islands.groupBy("file_id", "target", "diagonal", "island").agg(
        F.min("chunk_idx").alias("chunk_start"), (F.max("chunk_idx") + 1).alias("chunk_end"), F.min("target_idx").alias("target_start"), F.sum("length").alias("bytes")
    )
    return runs.select("file_id", "target", "chunk_start", "chunk_end", "target_start", "bytes")


def layered_lookup(chunks: DataFrame, layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each chunk's layer: that of the first layer, in order, that knows it; null if none does."""
    known = None
    for rank, (name, hashes) in enumerate(layers):
        part = hashes.select("chunk_hash", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("layer"))
        known = part if known is None else known.unionByName(part)
    best = known.groupBy("chunk_hash").agg(F.min("layer").alias("layer"))
    return chunks.join(best, "chunk_hash", "left").withColumn("layer", F.col("layer.name"))


def eligible_chunks(chunks: DataFrame, eligible: Column) -> DataFrame:
    """Distinct chunks that a shared index is asked for: those that start a file, and a share of all by hash."""
    return chunks.where((F.col("chunk_idx") == 0) | eligible).select("chunk_hash").distinct()


def keyed_lookup(chunks: DataFrame, layers: Sequence[tuple[str, DataFrame, Callable[[Column], Column] | None]]) -> DataFrame:
    """As ``layered_lookup``, for layers whose hashes are kept under a key: each chunk's hash is put under the layer's key before it is looked up."""
    found = chunks
    for rank, (_, hashes, under) in enumerate(layers):
        asked = F.col("chunk_hash") if under is None else under(F.col("chunk_hash"))
        known = hashes.select(F.col("chunk_hash").alias("__h")).distinct().withColumn(f"__in{rank}", F.lit(True))
        found = found.join(known, asked == F.col("__h"), "left").drop("__h")
    layer = F.coalesce(*(F.when(F.col(f"__in{rank}"), F.lit(name)) for rank, (name, _, _) in enumerate(layers)))
    return found.withColumn("layer", layer).drop(*(f"__in{rank}" for rank in range(len(layers))))


def file_starts(segments: DataFrame, placed: DataFrame) -> DataFrame:
    """container_hash, chunk_idx, chunk_hash of the chunks that start a file, once each."""
    starts = segments.where("seg_idx = 0").select("container_hash", F.col("chunk_start").alias("chunk_idx")).distinct()
    return placed.select("container_hash", "chunk_idx", "chunk_hash").join(starts, ["container_hash", "chunk_idx"], "left_semi")


def local_runs(chunks: DataFrame, packed: DataFrame, group_files: int) -> DataFrame:
    """Runs of chunks that lie in the container which was still open when they came: file_id, bin, chunk_start, chunk_end, pos_start, bytes.

    chunks in order of file within groups of ``group_files`` ids, packed(grp, file_id,
    chunk_idx, chunk_hash, bin, pos) their new ones. The open container is the one
    that the last new chunk went to.
    """
    here = packed.select("file_id", "chunk_idx", F.col("bin").alias("open"))
    order = Window.partitionBy("grp").orderBy("file_id", "chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.join(here, ["file_id", "chunk_idx"], "left").withColumn("grp", F.floor(F.col("file_id") / group_files)).withColumn("now", F.last("open", ignorenulls=True).over(order))
    place = packed.select("grp", "chunk_hash", "bin", "pos")
    hits = at.where("open is null").join(place, ["grp", "chunk_hash"]).where("bin = now").withColumn("diagonal", F.col("chunk_idx") - F.col("pos"))
    run = Window.partitionBy("file_id", "bin", "diagonal").orderBy("chunk_idx")
    runs = hits.withColumn("island", F.col("chunk_idx") - F.row_number().over(run)).groupBy("file_id", "bin", "diagonal", "island")
    return runs.agg(F.min("chunk_idx").alias("chunk_start"), (F.max("chunk_idx") + 1).alias("chunk_end"), F.min("pos").alias("pos_start"), F.sum("length").alias("bytes")).drop("diagonal", "island")


def two_pass(chunks: DataFrame, local: DataFrame, dedup_rows: DataFrame, shard_chunks: DataFrame, eligible: Column) -> tuple[DataFrame, DataFrame]:
    """Chunks looked up twice, with what the shared index tells in between: (chunks with pass, learnt chunk hashes).

    pass is 1 for what the local index has, 2 for what came with a shard that the
    shared index named, null for new chunks. The shared index is asked for chunks
    that start a file or are eligible and that the first pass didn't find; each
    answer brings all chunks of its shard.
    """
    known = local.select("chunk_hash").distinct()
    asked = chunks.where((F.col("chunk_idx") == 0) | eligible).select("chunk_hash").distinct().join(known, "chunk_hash", "left_anti")
    named = dedup_rows.join(asked, "chunk_hash", "left_semi").select("shard_id").distinct()
    learnt = shard_chunks.join(named, "shard_id", "left_semi").select("chunk_hash").distinct().join(known, "chunk_hash", "left_anti")
    both = known.withColumn("pass", F.lit(1)).unionByName(learnt.withColumn("pass", F.lit(2)))
    return chunks.join(both, "chunk_hash", "left"), learnt
