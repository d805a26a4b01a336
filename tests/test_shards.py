import random

from pyspark.sql import functions as F

from tesserae.operators import shards


def test_running_sums_are_exact_and_spread(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([rng.randrange(1000), 500]), rng.choice([None, 10, 70]), rng.randrange(100), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "shard_id long, created long, expires long, size long, n_chunks long")
    newest = sorted(rows, key=lambda r: (-r[1], r[0]))
    upto, indexed, live, states = 0, {}, 0, {}
    for i, _, expires, size, n in newest:
        indexed[i] = upto < 5000
        upto += n
        if expires == 70:
            live += size
            states[i] = "live" if live <= 4000 else "pruned"
        else:
            states[i] = "deleted" if expires == 10 else "expired"
    assert {r["shard_id"]: r["state"] for r in shards.retained(df, 60, 30, 4000).collect()} == states
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = shards.indexed_within(df, 5000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r["shard_id"]: r["indexed"] for r in got} == indexed and len(got) == 400
    assert len({r["task"] for r in got}) > 1
    assert shards.indexed_within(df.limit(0), 5000).count() == 0
