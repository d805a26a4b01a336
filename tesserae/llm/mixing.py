"""Operator 6: mixing sources to target weights.

Targets come from capped water-filling: each source gets its weight's share of
the total; one whose share exceeds ``max_epochs`` times its own size is held
there, and the excess goes to the others in proportion to their weights, until
none is above. Sorted by cap / weight, the held sources are a prefix, so running
sums give the level without iteration.

A row is taken ``floor(target / size)`` times, and once more if it is among the
seeded sample that fills the rest. The sample decides the ``large`` largest rows
of a source (by power of two, then by seeded hash) by carrying the error from row
to row, and fills what remains with the others in order of seeded hash: sums by
hash cell find the cell in which the goal is reached, and only that cell's rows
are put in order. So no source is sorted as a whole, and a source that holds a
third of the rows is spread over its hash cells.

Defined results: null text has size 0; the null source is a source of its own,
last in order; rows of size 0 are taken 0 words; repeated rows are sampled each
for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """source, source_size -> source, source_size, target. One row a source: a few rows in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_epochs))
    all_rows = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the first source in order that the level of its rest doesn't overfill: those before it are held
    filled = weighed.withColumn("k", F.row_number().over(ordered)).withColumn("level", level)
    filled = filled.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))).over(all_rows)["level"])
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def repeats(rows: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, large: int = 64, cells: int = 4096, ordered_by: str = "doc_id") -> DataFrame:
    """rows(doc_id, source, size) -> doc_id, size, source_size, target, times, row_id, row_id following the order of a written copy."""
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    rows = written(rows.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("row_id"), F.xxhash64(F.lit(seed), F.col(ordered_by)).alias("h")), "mix-rows")
    return _repeats_of(rows, weights, max_epochs, large, cells)


def _repeats_of(rows: DataFrame, weights, max_epochs: float, large: int, cells: int) -> DataFrame:
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = written(goals.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    goal_of = goals.select(F.col("source").alias("g"), "goal", F.col("source_size").alias("goal_size"))

    # the largest rows: error carried along an array of at most ``large`` items a source
    log_size = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(log_size.desc(), "h", "row_id"))).where(F.col("k") <= large)
    lists = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "row_id", "size"))).alias("items")).join(goal_of, F.col("source").eqNullSafe(F.col("g")))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("picked"), F.lit(0).cast("bigint").alias("words"))

    def step(acc, item):
        carry = acc["carry"] + item["size"] * F.col("goal") / F.greatest(F.col("goal_size"), F.lit(1))
        take = (carry >= item["size"] / 2) & (item["size"] > 0)
        return F.struct(
            F.when(take, carry - item["size"]).otherwise(carry).alias("carry"),
            F.when(take, F.array_append(acc["picked"], item["row_id"])).otherwise(acc["picked"]).alias("picked"),
            F.when(take, acc["words"] + item["size"]).otherwise(acc["words"]).alias("words"),
        )

    decided = lists.withColumn("r", F.aggregate("items", start, step))
    decided = written(decided.select("source", F.transform("items", lambda i: F.struct(i["row_id"].alias("id"), F.array_contains("r.picked", i["row_id"]).cast("int").alias("more"))).alias("rows_of"), (F.col("goal") - F.col("r.words")).alias("left_over")), "mix-large")
    large_rows = decided.select(F.explode("rows_of").alias("x")).select(F.col("x.id").alias("large_id"), "x.more")

    # the others: in order of hash until the goal is reached
    marked = rows.join(large_rows, F.col("row_id") == F.col("large_id"), "left").withColumn("cell", F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1)))
    marked = written(marked.select("doc_id", "source", "size", "row_id", "h", "cell", "more"), "mix-marked")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.where("more is null").groupBy("source", "cell").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    left = decided.select(F.col("source").alias("g"), "left_over")
    edge = sums.join(left, F.col("source").eqNullSafe(F.col("g"))).where(F.col("upto") > F.col("left_over")).groupBy("source").agg(F.min(F.struct("cell", (F.col("left_over") - F.col("upto") + F.col("words")).alias("room"))).alias("e"))
    by_source = goals.join(edge.select(F.col("source").alias("s"), F.col("e.cell").alias("edge"), F.col("e.room").alias("room")), F.col("source").eqNullSafe(F.col("s")), "left")
    by_source = written(by_source.select(F.col("source").alias("g"), "source_size", "target", "whole", F.coalesce("edge", F.lit(cells)).alias("edge"), F.coalesce("room", F.lit(0.0)).alias("room")), "mix-edges")

    joined = marked.join(by_source, F.col("source").eqNullSafe(F.col("g")))
    out = lambda df, more: df.select("doc_id", "size", "source_size", "target", (F.col("whole") + more).cast("long").alias("times"), "row_id")
    at_edge = F.col("more").isNull() & (F.col("cell") == F.col("edge"))
    in_order = Window.partitionBy("source").orderBy("h", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    edge_rows = joined.where(at_edge).withColumn("seen", F.sum("size").over(in_order))
    rest = out(joined.where(~at_edge), F.coalesce(F.col("more"), (F.col("cell") < F.col("edge")).cast("int")))
    return rest.unionByName(out(edge_rows, (F.col("seen") - F.col("size") / 2 <= F.col("room")).cast("int")))


def word_count(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    mixed = repeats(docs.select("doc_id", "source", word_count("text").alias("size")), seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. Rows of one id, source and text repeat alike, as often as the most drawn of them."""
    key = F.struct(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("text"))
    with scratch(docs.sparkSession) as keep:
        drawn = repeats(docs.select(key.alias("doc_id"), "source", word_count("text").alias("size")), seed, ordered_by="doc_id.doc_id").where("times > 0")
        times = drawn.groupBy(F.col("doc_id").alias("k")).agg(F.max("times").alias("__times")).select(F.col("k.doc_id").alias("__id"), F.col("k.source").alias("__source"), F.col("k.text").alias("__hash"), "__times")
        times = keep(written(times, "mix-times"))
    # the id first: rows with their texts are then sorted by a number, not by a struct
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    again = docs.join(times, same)
    return again.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[docs[c] for c in docs.columns])
