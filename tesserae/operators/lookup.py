"""Lookup of many hashes at once in an index that is laid out by ranges of the hash.

An index is a folder of Parquet files, parted by the first digits of the hash and
sorted by it within a file. A batch of hashes names the ranges that it hits, of
which there are at most 16 ** ``digits``; only the folders of those are read, and
within them row groups are skipped by their statistics. Hashes meet by their
truncated form first, as the sorted tables of a shard hold it, and count as found
if they agree in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "range"
DIGITS = 2


def write_index(rows: DataFrame, path: str, key: str = "chunk_hash", digits: int = DIGITS, mode: str = "append") -> None:
    """Writes ``rows`` by ranges of ``key``; a large range is several files that don't overlap."""
    ranged = rows.withColumn(RANGE, F.substring(key, 1, digits))
    ranged.repartitionByRange(F.col(key)).sortWithinPartitions(RANGE, key).write.mode(mode).partitionBy(RANGE).parquet(path)


def read_index(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    return spark.read.schema(f"{schema}, {RANGE} string").option("basePath", base or path).parquet(path)


def hit(index: DataFrame, asked: DataFrame, key: str = "chunk_hash", digits: int = DIGITS) -> DataFrame:
    """The part of the index whose ranges the asked hashes hit: other folders aren't read."""
    # at most 16 ** digits rows
    ranges = [r[0] for r in asked.where(F.col(key).isNotNull()).select(F.substring(key, 1, digits)).distinct().collect()]
    return index.where(F.col(RANGE).isin(ranges)) if ranges else index.where("false")


def lookup(asked: DataFrame, index: DataFrame, key: str = "chunk_hash", digits: int = DIGITS, truncate: int = 16, most: int = 8) -> DataFrame:
    """The index's row of each asked hash that it has: ``key`` and the index's other columns.

    asked(key) may repeat hashes; each is answered once. Of several rows of a hash the
    smallest is taken, in order of the columns. ``most`` or more different hashes under one
    truncated form, ``truncate`` digits, end the job: an index with a bounded number of slots
    can't hold them. Null hashes are not found.
    """
    values = [c for c in index.columns if c not in (key, RANGE)]
    short = lambda c: F.substring(c, 1, truncate)
    want = asked.where(F.col(key).isNotNull()).select(F.col(key).alias("__want")).distinct().withColumn("__short", short("__want")).withColumn(RANGE, F.substring("__want", 1, digits))
    near = hit(index, asked, key, digits).withColumn("__short", short(key))
    met = want.join(near, [RANGE, "__short"])
    found = met.groupBy("__want").agg(F.count_distinct(key).alias("__n"), F.min(F.when(F.col(key) == F.col("__want"), F.struct(*values))).alias("__at"))
    full = F.raise_error(F.concat(F.lit("too many hashes begin like "), F.col("__want"))).cast("boolean")
    found = found.where(F.when(F.col("__n") >= most, full).otherwise(F.col("__at").isNotNull()))
    return found.select(F.col("__want").alias(key), *[F.col(f"__at.`{c}`").alias(c) for c in values])
