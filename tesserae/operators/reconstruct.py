"""Range reconstruction: which container chunks give the bytes [start, end) of a file.

Requests meet segments by file, then chunks by container; both are equal joins
with a range filter, since a file's segments and a container's chunks are bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import coalesced


def terms(requests: DataFrame, segments: DataFrame, placed: DataFrame) -> DataFrame:
    """query_id, term_idx, container_hash, chunk_start, chunk_end, unpacked_length, skip.

    requests(query_id, file_id, start, end); end null means to the end of the file.
    Segments that miss the range go, and chunks at the ends of the first and the
    last one that lie outside; ``skip`` is the offset of start in the first chunk.
    A request that starts at or past the end of its file has no terms.
    """
    before = Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = segments.withColumn("seg_start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    hit = requests.join(at, "file_id").where((F.col("seg_start") < F.coalesce("end", F.lit(2**62))) & (F.col("start") < F.col("seg_start") + F.col("bytes")))
    chunk = placed.select("container_hash", F.col("chunk_idx").alias("c"), F.col("byte_start").alias("c_start"), F.col("length").alias("c_len"))
    own = hit.join(chunk, "container_hash").where((F.col("c") >= F.col("chunk_start")) & (F.col("c") < F.col("chunk_end")))
    first_byte = F.min("c_start").over(Window.partitionBy("query_id", "seg_idx"))
    own = own.withColumn("f_start", F.col("seg_start") + F.col("c_start") - first_byte).withColumn("f_end", F.col("f_start") + F.col("c_len"))
    own = own.where((F.col("f_end") > F.col("start")) & ((F.col("f_start") < F.coalesce("end", F.lit(2**62)))))
    out = own.groupBy("query_id", "seg_idx", "container_hash").agg(
        F.min("c").alias("chunk_start"), (F.max("c") + 1).alias("chunk_end"), F.sum("c_len").alias("unpacked_length"), F.greatest(F.min(F.col("start") - F.col("f_start")), F.lit(0)).alias("d"), F.max(F.col("start") - F.col("f_start")).alias("skip")
    )
    order = Window.partitionBy("query_id").orderBy("seg_idx")
    numbered = out.withColumn("term_idx", F.row_number().over(order) - 1)
    return numbered.select("query_id", F.col("term_idx").cast("long").alias("term_idx"), "container_hash", "chunk_start", "chunk_end", "unpacked_length", F.when(F.col("term_idx") == 0, F.greatest("skip", F.lit(0))).otherwise(0).cast("long").alias("skip"))


def fetch_ranges(found: DataFrame, placed: DataFrame) -> DataFrame:
    """query_id, container_hash, chunk_start, chunk_end, byte_start, byte_end: chunk ranges to read, touching ones joined."""
    joined = coalesced(found.select("query_id", "container_hash", F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end")), ["query_id", "container_hash"])
    chunk = placed.select("container_hash", "chunk_idx", "byte_start", (F.col("byte_start") + F.col("length")).alias("byte_end"))
    first = chunk.select("container_hash", F.col("chunk_idx").alias("start"), "byte_start")
    last = chunk.select("container_hash", (F.col("chunk_idx") + 1).alias("end"), "byte_end")
    out = joined.join(first, ["container_hash", "start"]).join(last, ["container_hash", "end"])
    return out.select("query_id", "container_hash", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), "byte_start", "byte_end")


def multirange(fetches: DataFrame, per_fetch: int) -> DataFrame:
    """Ranges of a container in order, at most ``per_fetch`` to a request; byte ranges with inclusive end, as a header has them."""
    order = Window.partitionBy("query_id", "container_hash").orderBy("chunk_start")
    numbered = fetches.withColumn("request_idx", F.floor((F.row_number().over(order) - 1) / per_fetch))
    one = F.struct("chunk_start", F.concat_ws("-", F.col("byte_start").cast("string"), (F.col("byte_end") - 1).cast("string")).alias("r"))
    lists = numbered.groupBy("query_id", "container_hash", "request_idx").agg(F.array_sort(F.collect_list(one)).alias("rs"))
    return lists.select("query_id", "container_hash", "request_idx", F.concat(F.lit("bytes="), F.array_join(F.transform("rs", lambda x: x["r"]), ",")).alias("byte_ranges"))


def blocks_of_terms(found: DataFrame, fetches: DataFrame, strict: bool = False) -> DataFrame:
    """Each term with the fetch that contains its chunks; a term in none has null block columns, or ends the job if ``strict``."""
    block = fetches.select("query_id", "container_hash", F.col("chunk_start").alias("block_start"), F.col("chunk_end").alias("block_end"))
    inside = (F.col("t.chunk_start") >= F.col("b.block_start")) & (F.col("t.chunk_end") <= F.col("b.block_end"))
    on = (F.col("t.query_id") == F.col("b.query_id")) & (F.col("t.container_hash") == F.col("b.container_hash")) & inside
    out = found.alias("t").join(block.alias("b"), on, "left").select("t.query_id", "t.term_idx", "t.container_hash", "b.block_start", "b.block_end")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no block for term"), F.col("term_idx").cast("string"), F.lit("of"), F.col("query_id").cast("string")))
    return out.withColumn("block_start", F.coalesce("block_start", lost.cast("long"))) if strict else out


def batch_fetches(requests: DataFrame, known_files: DataFrame, fetches: DataFrame) -> DataFrame:
    """container_hash, n_ranges, byte_ranges of a batch of requests: each request's ranges in order, side by side, not joined across requests; unknown files are skipped."""
    asked = requests.join(known_files.select("file_id").distinct(), "file_id", "left_semi").select("query_id")
    one = F.struct("query_id", "chunk_start", F.concat_ws("-", F.col("byte_start").cast("string"), (F.col("byte_end") - 1).cast("string")).alias("r"))
    lists = fetches.join(asked, "query_id", "left_semi").groupBy("container_hash").agg(F.array_sort(F.collect_list(one)).alias("rs"))  # as many as the batch has
    return lists.select("container_hash", F.size("rs").cast("long").alias("n_ranges"), F.array_join(F.transform("rs", lambda x: x["r"]), ",").alias("byte_ranges"))


def file_pieces(requests: DataFrame, found: DataFrame, placed: DataFrame, payload: DataFrame) -> DataFrame:
    """query_id, piece_idx, offset, data: the requested bytes as pieces in order, one a chunk, from terms and payload(chunk_hash, data).

    Pieces add up to the range whatever its length; a chunk that is stored twice counts once.
    """
    chunk = placed.select("container_hash", F.col("chunk_idx").alias("c"), "chunk_hash")
    parts = found.join(chunk, "container_hash").where((F.col("c") >= F.col("chunk_start")) & (F.col("c") < F.col("chunk_end")))
    parts = parts.select("query_id", "term_idx", "c", "chunk_hash", "skip").join(payload.select("chunk_hash", "data"), "chunk_hash").dropDuplicates(["query_id", "term_idx", "c"])
    order = Window.partitionBy("query_id").orderBy("term_idx", "c")
    first = F.row_number().over(order) == 1
    own = parts.join(requests.select("query_id", (F.col("end") - F.col("start")).alias("want")), "query_id")
    own = own.withColumn("piece_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("from", F.when(first, F.col("skip")).otherwise(0).cast("long"))
    own = own.withColumn("len", F.octet_length("data") - F.col("from"))
    own = own.withColumn("offset", F.sum("len").over(order) - F.col("len")).withColumn("len", F.least("len", F.col("want") - F.col("offset")))
    return own.where("len > 0").select("query_id", "piece_idx", "offset", F.substring("data", (F.col("from") + 1).cast("int"), F.col("len").cast("int")).alias("data"))


def file_bytes(requests: DataFrame, found: DataFrame, placed: DataFrame, payload: DataFrame) -> DataFrame:
    """query_id, data: the pieces in one value, for ranges that fit one."""

    def joined(lists: pd.Series) -> pd.Series:
        return pd.Series([b"".join(bytes(x["data"]) for x in row) for row in lists], dtype=object)

    pieces = file_pieces(requests, found, placed, payload)
    lists = pieces.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("piece_idx", "data"))).alias("ps"))
    return lists.select("query_id", F.pandas_udf(joined, "binary")("ps").alias("data"))
