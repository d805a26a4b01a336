"""Operator 5: sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into cells; each virtual node of each shard takes the cells
after it up to the next node. A row's cell is the hash of its id. Every shard
first keeps rows of its own cells, in ring order, up to its capacity; rows over
that go on clockwise to the next node whose shard has room. With no headroom
the capacities add up to the row count, so counts differ by one at most
(law ``rows``); with headroom h no shard exceeds (1 + h) times the mean.

Rows are only counted by cell (``cells`` numbers, a parameter, whatever the
input) before the plan of cells is made on the driver; the plan is a table of
``cells`` rows plus a split for each shard, small enough to broadcast. A row
finds its shard by its cell and its place within the cell. DataFrame functions
alone run on the executors.

Defined results: null text has no bytes and CRC 0; a null id hashes as its own
key; repeated rows each get a slot; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAN = "array<struct<cell:bigint,from_rank:bigint,to_rank:bigint,shard:int,slot:bigint>>"


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int, cells: int) -> list[int]:
    """The owner of each cell: the shard of the last virtual node at or before it, clockwise."""
    nodes = spark.range(n_shards * virtual_nodes).select((F.col("id") % n_shards).cast("int").alias("shard"), (F.col("id") / n_shards).cast("long").alias("v"))
    placed = nodes.select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "v"), F.lit(cells)).alias("cell"))
    at = {r["cell"]: r["shard"] for r in placed.groupBy("cell").agg(F.min("shard").alias("shard")).collect()}
    owner, last = [0] * cells, at[max(at)]
    for c in range(cells):
        last = owner[c] = at.get(c, last)
    return owner


def capacities(total: int, n_shards: int, headroom: float) -> list[int]:
    if headroom > 0:
        return [int(-(-total * (1 + headroom) // n_shards))] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def plan_cells(counts: dict[int, int], owner: list[int], room: list[int]) -> list[dict]:
    """Runs of places within cells, each with its shard and its first slot there."""
    room, used, plan, over = list(room), [0] * len(room), [], []

    def give(cell: int, start: int, stop: int, shard: int) -> int:
        n = min(stop - start, room[shard])
        if n:
            plan.append({"cell": cell, "from_rank": start, "to_rank": start + n, "shard": shard, "slot": used[shard]})
            room[shard] -= n
            used[shard] += n
        return start + n

    for cell in sorted(counts):
        kept = give(cell, 0, counts[cell], owner[cell])
        if kept < counts[cell]:
            over.append((cell, kept, counts[cell]))
    for cell, start, stop in over:
        at = cell
        while start < stop:
            at = (at + 1) % len(owner)
            start = give(cell, start, stop, owner[at])
    return plan


def shard_rows(docs: DataFrame, n_shards: int, key: Column, columns: list[Column], virtual_nodes: int = 64, cells: int = 16384, headroom: float = 0.0) -> DataFrame:
    """``columns`` of each row with shard int and slot long, gapless from 0 in each shard."""
    spark = docs.sparkSession
    named = docs.select(F.xxhash64(F.lit("key"), key).alias("__pos"), *columns)
    # the cells are cut from the hash by range, so ring order is hash order
    cell = F.shiftrightunsigned("__pos", 64 - (cells.bit_length() - 1)).alias("__cell")
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    counts = {r["__cell"]: r["n"] for r in docs.select(F.xxhash64(F.lit("key"), key).alias("__pos")).groupBy(cell).agg(F.count("*").alias("n")).collect()}
    plan = plan_cells(counts, ring(spark, n_shards, virtual_nodes, cells), capacities(sum(counts.values()), n_shards, headroom))
    runs = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), PLAN)).alias("p")).select("p.*")
    kept = [c for c in named.columns if c != "__pos"]
    placed = named.select("*", cell).withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy("__pos", *kept)) - 1)
    inside = (F.col("__cell") == F.col("cell")) & (F.col("__rank") >= F.col("from_rank")) & (F.col("__rank") < F.col("to_rank"))
    # at most cells + n_shards * cells rows of five numbers
    return placed.join(F.broadcast(runs), inside).select(*kept, F.col("shard"), (F.col("slot") + F.col("__rank") - F.col("from_rank")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return shard_rows(docs, n_shards, F.col("doc_id"), columns).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
