"""Reads of stored containers and files that tell what became of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def container_reads(asked: DataFrame, containers: DataFrame, placed: DataFrame) -> DataFrame:
    """asked(query_id, container_hash, chunk_start, chunk_end) -> query_id, outcome, n_chunks, bytes, chunks_sha256.

    Both bounds null ask for the whole container. Outcomes: ok, empty (the range holds
    nothing), not_found, out_of_range (it leaves the container). For the last two the
    other columns are null. chunks_sha256 is the digest of the range's chunk hashes in
    order; a container has a bounded number of chunks.
    """
    have = containers.select("container_hash", F.col("n_chunks").alias("held")).dropDuplicates(["container_hash"])
    j = asked.join(have, "container_hash", "left")
    whole = F.col("chunk_start").isNull() & F.col("chunk_end").isNull()
    start, end = F.when(whole, 0).otherwise(F.col("chunk_start")), F.when(whole, F.col("held")).otherwise(F.col("chunk_end"))
    j = j.select("query_id", "container_hash", "held", start.alias("start"), end.alias("end"))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("end") <= F.col("held")), F.lit(False))
    outcome = F.when(F.col("held").isNull(), "not_found").when(F.coalesce(F.col("start") >= F.col("end"), F.lit(False)), "empty").when(~inside, "out_of_range").otherwise("ok")
    j = j.withColumn("outcome", outcome)
    chunk = placed.select("container_hash", F.col("chunk_idx").alias("c"), "chunk_hash", "length").dropDuplicates(["container_hash", "c"])
    hit = j.where("outcome = 'ok'").join(chunk, "container_hash").where("c >= start and c < end")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "chunk_hash"))), lambda x: x["chunk_hash"]), "")
    got = hit.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.sha2(listed, 256).alias("digest"))
    zero = lambda c: F.when(F.col("outcome") == "empty", F.lit(0).cast("long")).otherwise(F.col(c))
    return j.select("query_id", "outcome").join(got, "query_id", "left").select("query_id", "outcome", zero("n").alias("n_chunks"), zero("b").alias("bytes"), F.col("digest").alias("chunks_sha256"))


def file_reads(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(query_id, file_id, start, end) -> query_id, outcome, size, start, end: the bytes that a read gives, cut at the file's end.

    A null bound is the file's own, and both null read any file, an empty one too.
    Outcomes: ok, not_found, invalid_range (it begins at the file's end or behind it, is
    turned round or negative); start and end are null unless the outcome is ok.
    """
    j = asked.join(files.select("file_id", "size").dropDuplicates(["file_id"]), "file_id", "left")
    start, end = F.coalesce("start", F.lit(0)), F.least(F.coalesce("end", "size"), "size")
    ranged = F.col("start").isNotNull() | F.col("end").isNotNull()
    invalid = ranged & ((start >= F.col("size")) | (start < 0) | (F.coalesce("end", "size") < start))
    outcome = F.when(F.col("size").isNull(), "not_found").when(invalid, "invalid_range").otherwise("ok")
    ok = lambda c: F.when(F.col("outcome") == "ok", c).cast("long")
    return j.withColumn("outcome", outcome).select("query_id", "outcome", "size", ok(start).alias("start"), ok(end).alias("end"))
