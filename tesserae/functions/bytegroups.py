"""Byte planes, popcount statistics and frame compression of binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, BINS = 4, 9
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


def split_planes(data: bytes) -> bytes:
    """Bytes at positions 0, 4, 8, ... then 1, 5, ... and so on; a remainder falls to the lower planes."""
    a = np.frombuffer(data, np.uint8)
    return np.concatenate([a[k::LANES] for k in range(LANES)]).tobytes() if len(a) else b""


def join_planes(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    out, at = np.empty_like(a), 0
    for k in range(LANES):
        n = len(range(k, len(a), LANES))
        out[k::LANES] = a[at : at + n]
        at += n
    return out.tobytes()


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, "binary")


def byte_planes(data) -> Column:
    return _mapped(split_planes)(data)


def from_byte_planes(data) -> Column:
    return _mapped(join_planes)(data)


def lz4_frame(data) -> Column:
    return _mapped(lambda b: pa.Codec("lz4").compress(b, asbytes=True))(data)


def lz4_unframe(data, size) -> Column:
    """``size`` is that of the bytes within."""

    def run(z: pd.Series, n: pd.Series) -> pd.Series:
        codec = pa.Codec("lz4")
        return pd.Series([codec.decompress(b, int(k), asbytes=True) if k else b"" for b, k in zip(z, n)])

    return F.pandas_udf(run, "binary")(data, size)


def lane_popcounts(data) -> Column:
    """Counts by lane (position modulo 4) and number of set bits: lane * 9 + bits."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for b in s:
            bits = _POPCOUNT[np.frombuffer(b, np.uint8)]
            out.append(np.bincount(np.arange(len(bits)) % LANES * BINS + bits, minlength=LANES * BINS))
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")(data)


def popcount_histogram(blocks: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, lane, bits, n for each lane and bit count that occurs."""
    counted = blocks.select(F.col(id_col), F.posexplode(lane_popcounts(F.col(data_col))).alias("cell", "n"))
    return counted.where("n > 0").select(id_col, F.floor(F.col("cell") / BINS).alias("lane"), (F.col("cell") % BINS).cast("long").alias("bits"), "n")


def lane_divergence(histogram: DataFrame, id_col: str) -> DataFrame:
    """id, lane, entropy (base 2), divergence of the lane from all lanes (natural; null if one of its bins is empty).

    Each bin of the base counts from 1; the base total leaves those ones out.
    """
    base = histogram.groupBy(id_col, "bits").agg((F.sum("n") + 1).alias("base_n"))
    totals = histogram.groupBy(id_col).agg(F.sum("n").alias("base_total"))
    lanes = histogram.groupBy(id_col, "lane").agg(F.sum("n").alias("lane_total"))
    j = histogram.join(base, [id_col, "bits"]).join(totals, id_col).join(lanes, [id_col, "lane"])
    p, q = F.col("n") / F.col("lane_total"), F.col("base_n") / F.col("base_total")
    out = j.groupBy(id_col, "lane").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.sum(p * F.log(p / q)).alias("kl"), F.count("*").alias("bins"))
    return out.select(id_col, "lane", "entropy", F.when(F.col("bins") == BINS, F.col("kl")).alias("divergence"))


def planes_recommended(divergence: DataFrame, id_col: str, limit: float = 0.02) -> DataFrame:
    worst = divergence.groupBy(id_col).agg(F.greatest(F.coalesce(F.max("divergence"), F.lit(0.0)), F.lit(0.0)).alias("max_divergence"))
    return worst.withColumn("recommended", F.col("max_divergence") > limit)
