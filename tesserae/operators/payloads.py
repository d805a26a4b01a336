"""Container payloads: chunks with 8-byte headers one after the other.

Header: version, compressed length (3 bytes, low first), scheme, length (3 bytes,
low first). Schemes: 0 none, 1 LZ4 frame, 2 byte planes then LZ4 frame. A chunk
that doesn't shrink is stored with scheme 0. A container is bounded, so it is one
row; encoding and decoding are by row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.bytegroups import join_planes, split_planes

VERSION, HEADER = 0, 8
NONE, LZ4, PLANES = 0, 1, 2
MAX_CHUNK = 1 << 24 >> 1  # lengths have three bytes


def _encode(data: bytes, scheme: int) -> bytes:
    body = data
    if scheme != NONE:
        squeezed = pa.Codec("lz4").compress(split_planes(data) if scheme == PLANES else data, asbytes=True)
        body, scheme = (squeezed, scheme) if len(squeezed) < len(data) else (data, NONE)
    head = bytes([VERSION]) + struct.pack("<I", len(body))[:3] + bytes([scheme]) + struct.pack("<I", len(data))[:3]
    return head + body


def chosen_scheme(name: Column, planes: Column) -> Column:
    """The number of a scheme's name; ``auto`` is byte planes where they are recommended, else LZ4; null for no name of a scheme."""
    n = F.lower(F.trim(name))
    return F.when(n == "auto", F.when(planes, PLANES).otherwise(LZ4)).when(n == "none", NONE).when(n == "lz4", LZ4).when(n.isin("bg4-lz4", "bg4lz4"), PLANES)


def _decode(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while at < len(blob):
        if at + HEADER > len(blob):
            raise ValueError(f"a chunk header is cut off at byte {at}")
        version, scheme = blob[at], blob[at + 4]
        packed, size = int.from_bytes(blob[at + 1 : at + 4], "little"), int.from_bytes(blob[at + 5 : at + 8], "little")
        body = blob[at + HEADER : at + HEADER + packed]
        if version != VERSION or scheme not in (NONE, LZ4, PLANES) or len(body) != packed or size > MAX_CHUNK or packed > 2 * MAX_CHUNK:
            raise ValueError(f"no valid chunk at byte {at}")
        data = body if scheme == NONE else pa.Codec("lz4").decompress(body, size, asbytes=True)
        data = join_planes(data) if scheme == PLANES else data
        if len(data) != size:
            raise ValueError(f"the chunk at byte {at} has {len(data)} bytes, not {size}")
        yield scheme, packed, data
        at += HEADER + packed


def encode_containers(chunks: DataFrame, scheme: int = LZ4) -> DataFrame:
    """chunks(container_hash, chunk_idx, data) -> container_hash, n_chunks, payload; a column ``scheme`` decides chunk by chunk."""
    own = F.col("scheme") if "scheme" in chunks.columns else F.lit(scheme)
    lists = chunks.groupBy("container_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "data", own.alias("scheme")))).alias("c"))

    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([b"".join(_encode(bytes(x["data"]), x["scheme"]) for x in row) for row in lists], dtype=object)

    return lists.select("container_hash", F.size("c").cast("long").alias("n_chunks"), F.pandas_udf(run, "binary")("c").alias("payload"))


def container_faults(containers: DataFrame, listed: DataFrame, decoded: DataFrame) -> DataFrame:
    """container_hash, fault of containers that aren't what they say.

    containers(container_hash, n_chunks, bytes_raw), listed(container_hash, chunk_idx,
    chunk_hash, byte_start, length), decoded(container_hash, chunk_idx, chunk_hash,
    length) as their payload has it. Faults: zero (a hash of zeros), count (numbers
    of chunks differ), chunk (a chunk's hash or length differs), offset (a chunk
    doesn't begin where the one before ends), size (the last doesn't end at the size).
    """
    place = ["container_hash", "chunk_idx"]
    zero = containers.where(F.col("container_hash") == "0" * 64).select("container_hash", F.lit("zero").alias("fault"))
    n = lambda df, c: df.groupBy("container_hash").agg(F.count("*").alias(c))
    counts = containers.join(n(listed, "a"), "container_hash", "left").join(n(decoded, "b"), "container_hash", "left")
    count = counts.where("n_chunks <> coalesce(a, 0) or n_chunks <> coalesce(b, 0)").select("container_hash", F.lit("count").alias("fault"))
    j = listed.join(decoded.select(*place, F.col("chunk_hash").alias("h"), F.col("length").alias("l")), place)
    chunk = j.where("chunk_hash <> h or length <> l").select("container_hash", F.lit("chunk").alias("fault")).distinct()
    w = Window.partitionBy("container_hash").orderBy("chunk_idx")
    gap = listed.withColumn("due", F.coalesce(F.lag(F.col("byte_start") + F.col("length")).over(w), F.lit(0))).where("byte_start <> due").select("container_hash", F.lit("offset").alias("fault")).distinct()
    ends = listed.groupBy("container_hash").agg(F.max(F.col("byte_start") + F.col("length")).alias("end"))
    size = containers.join(ends, "container_hash").where("end <> bytes_raw").select("container_hash", F.lit("size").alias("fault"))
    return zero.unionByName(count).unionByName(chunk).unionByName(gap).unionByName(size)


def decode_containers(containers: DataFrame) -> DataFrame:
    """container_hash, chunk_idx, scheme, packed_length, length, data; a payload that ends within a chunk is an error."""
    names = ["container_hash", "chunk_idx", "scheme", "packed_length", "length", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column("container_hash").to_pylist(), b.column("payload")):
                rows = [(name, i, s, p, len(d), d) for i, (s, p, d) in enumerate(_decode(blob.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([("container_hash", pa.string()), ("chunk_idx", pa.int64()), ("scheme", pa.int64()), ("packed_length", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))

    return containers.select("container_hash", "payload").mapInArrow(run, "container_hash string, chunk_idx long, scheme long, packed_length long, length long, data binary")


def rebuilt_rows(containers: DataFrame) -> DataFrame:
    """container_hash, chunk_idx, chunk_hash, byte_start, length of containers whose listing is lost: payloads are decoded and their chunks hashed."""
    before = Window.partitionBy("container_hash").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = decode_containers(containers).select("container_hash", "chunk_idx", F.sha2("data", 256).alias("chunk_hash"), "length")
    return rows.select("container_hash", "chunk_idx", "chunk_hash", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("byte_start"), "length")
