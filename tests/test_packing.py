import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import packing

SCHEMA = "grp long, file_id long, chunk_idx long, chunk_hash string, length long"


def awkward(seed):
    """One group with most rows, small ones, runs of empty chunks and chunks over the bound."""
    rng = random.Random(seed)
    rows = [(g, f, i, f"{g}-{f}-{i}", rng.choice([0, 0, 1, 30, rng.randrange(100), 250])) for g, files in ((7, 9), (1, 2), (3, 1)) for f in range(files) for i in range(rng.randrange(1, 60))]
    rows += [(7, 5, i, f"x{i}", 0) for i in range(100, 160)]
    rng.shuffle(rows)
    return rows


def state(df):
    return sorted(tuple(r) for r in df.select("grp", "file_id", "chunk_idx", "chunk_hash", "length", "bin", "pos").collect())


@pytest.mark.parametrize("max_bytes, max_chunks, rows", [(200, 8, 20), (200, 8, 3), (100_000, 50, 7), (300, 100_000, 11), (10, 1, 20), (100_000, 100_000, 5)])
def test_ranges_make_the_containers_of_the_fold(spark, max_bytes, max_chunks, rows):
    df = spark.createDataFrame(awkward(max_chunks + rows), SCHEMA)
    assert state(packing.pack_ranges(df, max_bytes, max_chunks, rows)) == state(packing.pack(df, max_bytes, max_chunks))


def test_one_group_is_many_tasks(spark):
    df = spark.range(4000).select(F.lit(0).cast("long").alias("grp"), F.lit(1).cast("long").alias("file_id"), F.col("id").alias("chunk_idx"), F.col("id").cast("string").alias("chunk_hash"), (F.col("id") * 37 % 101).alias("length"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        made = packing.pack_ranges(df, 500, 8, 100)
        tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 4000 and len(tasks) > 8 and max(tasks) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert state(made) == state(packing.pack(df, 500, 8))


def test_nothing_to_pack(spark):
    assert packing.pack_ranges(spark.createDataFrame([], SCHEMA), 10, 2).count() == 0
