"""Operator 3: chat formatting of preference pairs.

Chosen and rejected conversations are compared turn by turn; the turns before
the first difference are rendered once as the prompt, the rest of each as a
completion with a mask: the code point spans that are trained on (the text and
end mark of assistant turns; a prompt has none). Prefixes are found on digests
of turns; a text moves once, to the place where it is rendered.

Output is one row a pair, segment (prompt, chosen, rejected) and part: part p
holds turns p * ``part_turns`` and on of the conversation, so a conversation of
any length is rendered in rows of bounded size; parts in order are the whole.
DataFrame functions alone are used.

Defined results: null role and text count as empty; turns that tie are ordered by
role and text; repeated rows are turns of their own; a conversation without a
partner has all turns but its last as prompt, the last as chosen and no rejected
rows; a completion without turns has no rows; the turns with a null conv_id
are one conversation, which has no partner; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

START, END = "<|im_start|>", "<|im_end|>"


def ordered_turns(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, conv, pos from 0, role, text, digest; of the first ``most`` turns of each conversation, or of all.

    conv is the id in a struct: it is never null, so joins on it keep a null id.
    """
    turns = conversations.select("conv_id", F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("digest", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("nth", F.row_number().over(order))
    if most is not None:
        turns = turns.where(F.col("nth") <= most)  # Spark drops the others before it shuffles
    return turns.select("conv_id", "conv", (F.col("nth") - 1).cast("long").alias("pos"), "role", "text", "digest")


def pair_by_first_turn(turns: DataFrame, hot: int = 1000) -> DataFrame:
    """conv_id, pair_id, side (0 chosen, 1 rejected), alone.

    Conversations with the same first turn are paired in order of id: first with
    second, third with fourth. All are sorted by (first turn, id) in ranges, of
    ``hot`` conversations at least on average; a conversation's rank is its place
    within the range and the counts of its first turn in earlier ranges, so that
    no task holds a whole first turn. The conversation without id has no partner.
    """
    first = F.when(F.col("conv_id").isNull(), "").otherwise(F.col("digest"))  # "" is no digest
    firsts = written(turns.where("pos = 0").select("conv_id", first.alias("first")), "first-turns")
    most = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(most, firsts.count() // hot + 1)
    # the id has the range in its upper bits and the place within the range in the lower 33
    placed = firsts.repartitionByRange(ranges, "first", "conv_id").sortWithinPartitions("first", "conv_id").withColumn("id", F.monotonically_increasing_id())
    placed = written(placed, "first-turn-places")
    placed = placed.withColumn("range", F.shiftright("id", 33))
    counts = placed.groupBy("first", "range").agg(F.min("id").alias("begin"), F.count("*").alias("n"))
    earlier = Window.partitionBy("first").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("first", "range", "begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.join(counts, ["first", "range"]).withColumn("pair", F.floor((F.col("id") - F.col("begin") + F.col("before")) / 2))
    pairs = ranked.groupBy("first", "pair").agg(F.array_sort(F.collect_list(F.struct("conv_id"))).alias("both"))  # at most two
    pairs = pairs.select(F.col("both")[0]["conv_id"].alias("pair_id"), (F.size("both") == 1).alias("alone"), F.posexplode("both").alias("side", "of"))
    return pairs.select(F.col("of")["conv_id"].alias("conv_id"), "pair_id", "side", "alone")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def format_pairs(turns: DataFrame, pairs: DataFrame, part_turns: int = 64) -> DataFrame:
    """pair_id, segment, part, n_turns, text, mask_spans array<struct<start, end>>."""
    pairs = pairs.select(F.struct("conv_id").alias("conv"), F.struct("pair_id").alias("pair"), "side", "alone")
    slim = turns.select("conv", "pos", "digest").join(pairs, "conv")
    at = slim.groupBy("pair", "pos").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("alone").alias("alone"))
    same = (F.col("n") == 2) & (F.col("lo") == F.col("hi"))
    prefix = at.groupBy("pair").agg(F.when(F.max("alone"), F.max("pos")).otherwise(F.coalesce(F.min(F.when(~same, F.col("pos"))), F.max("pos") + 1)).alias("prefix"))
    placed = turns.join(pairs, "conv").join(prefix, "pair")
    segment = F.when(F.col("pos") < F.col("prefix"), "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    placed = placed.where(~((F.col("pos") < F.col("prefix")) & (F.col("side") == 1)))

    shown = placed.select(
        "pair",
        segment.alias("segment"),
        F.floor(F.col("pos") / part_turns).cast("long").alias("part"),
        F.struct(
            "pos",
            rendered(F.col("role"), F.col("text")).alias("shown"),
            (F.length("role") + len(START) + 1).alias("skip"),
            (F.length("text") + len(END)).alias("take"),
            (F.col("role") == "assistant").alias("trained"),
        ).alias("t"),
    )
    parts = shown.groupBy("pair", "segment", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # at most part_turns items
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + t["skip"]
        span = F.struct(begin.cast("long").alias("start"), (begin + t["take"]).cast("long").alias("end"))
        return F.struct((acc["at"] + F.length(t["shown"])).cast("long").alias("at"), F.when(t["trained"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.when(F.col("segment") == "prompt", F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.aggregate("ts", start, step)["spans"])
    return parts.select("pair.pair_id", "segment", "part", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("text"), spans.alias("mask_spans"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return format_pairs(ordered_turns(conversations), pair_by_first_turn(ordered_turns(conversations, 1)))
