"""Range edits of files that are stored as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import coalesced


def validated(edits: DataFrame, sizes: DataFrame) -> DataFrame:
    """edits(file_id, start, end, new_length), sizes(file_id, size) -> file_id, valid, new_size.

    Edits of a file must not overlap and must lie inside it; new_size is null if they don't.
    """
    w = Window.partitionBy("file_id").orderBy("start", "end")
    checked = edits.join(sizes, "file_id").withColumn("ok", (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("size")) & (F.col("start") >= F.coalesce(F.lag("end").over(w), F.lit(0))))
    out = checked.groupBy("file_id").agg(F.bool_and("ok").alias("valid"), (F.max("size") + F.sum("new_length") - F.sum(F.col("end") - F.col("start"))).alias("s"))
    return out.select("file_id", "valid", F.when(F.col("valid"), F.col("s")).alias("new_size"))


def snapped(edits: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows of whole segments around the edits: file_id, start, end, n_edits. spans(file_id, seg_start, seg_end)."""
    j = edits.join(spans, "file_id")
    wide = j.groupBy("file_id", "start", "end").agg(F.max(F.when(F.col("seg_start") <= F.col("start"), F.col("seg_start"))).alias("s"), F.min(F.when(F.col("seg_end") >= F.col("end"), F.col("seg_end"))).alias("e"))
    wide = wide.select("file_id", F.coalesce("s", F.col("start")).alias("start"), F.coalesce("e", F.col("end")).alias("end"))
    return coalesced(wide, ["file_id"]).withColumnRenamed("n_ranges", "n_edits")


def untouched(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments that overlap no window of their file."""
    w = windows.select(F.col("file_id").alias("f"), F.col("start").alias("ws"), F.col("end").alias("we"))
    return spans.join(w, (F.col("file_id") == F.col("f")) & (F.col("seg_start") < F.col("we")) & (F.col("ws") < F.col("seg_end")), "left_anti")


def assigned(edits: DataFrame, windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each edit with the start of its window: file_id, start, end, window_start.

    A pure insert at the end of a window belongs to the next one if that begins
    there, except at the end of the file.
    """
    w = windows.select("file_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    j = edits.join(sizes, "file_id").join(w, "file_id")
    insert = F.col("start") == F.col("end")
    inside = (F.col("ws") <= F.col("start")) & (F.col("end") <= F.col("we"))
    held = j.where(inside & (~insert | (F.col("start") < F.col("we")) | (F.col("we") == F.col("size"))))
    # an insert at an end that no window begins at stays with the window that ends there
    either = held.groupBy("file_id", "start", "end").agg(F.max("ws").alias("window_start"))
    at_end = j.where(inside & insert).groupBy("file_id", "start", "end").agg(F.max("ws").alias("w"))
    return at_end.join(either, ["file_id", "start", "end"], "full_outer").select("file_id", "start", "end", F.coalesce("window_start", "w").alias("window_start"))


def spliced(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files(file_id, data), edits(file_id, start, end, data), valid and not overlapping -> file_id, data after the edits.

    The untouched pieces between edits and the edits' data, in order, make the new file.
    """
    w = Window.partitionBy("file_id").orderBy("start", "end")
    known = edits.select("file_id", "start", "end", F.col("data").alias("new")).withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0)))
    last = edits.groupBy("file_id").agg(F.max("end").alias("rest"))
    body = files.select("file_id", "data")
    cut = lambda a, n: F.substring("data", (a + 1).cast("int"), n.cast("int"))
    before = known.join(body, "file_id").select("file_id", F.col("start").alias("at"), F.lit(0).alias("k"), F.col("end").alias("e"), F.hex(cut(F.col("from"), F.col("start") - F.col("from"))).alias("piece"))
    new = known.select("file_id", F.col("start").alias("at"), F.lit(1).alias("k"), F.col("end").alias("e"), F.hex("new").alias("piece"))
    tail = body.join(last, "file_id", "left").select("file_id", F.lit(2**62).alias("at"), F.lit(2).alias("k"), F.lit(2**62).alias("e"), F.hex(cut(F.coalesce("rest", F.lit(0)), F.lit(2**31 - 1))).alias("piece"))
    pieces = before.unionByName(new).unionByName(tail)
    joined = pieces.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("at", "e", "k", "piece"))).alias("p"))
    return joined.select("file_id", F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("data"))


def stored_chunks(segments: DataFrame, placed: DataFrame) -> DataFrame:
    """The chunk list of files that are stored as segments: file_id, chunk_idx, byte_start, length, chunk_hash. No bytes are read."""
    before = Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    at = segments.withColumn("n", F.col("chunk_end") - F.col("chunk_start")).withColumn("first_chunk", sums("n")).withColumn("first_byte", sums("bytes"))
    chunk = placed.select("container_hash", F.col("chunk_idx").alias("c"), F.col("byte_start").alias("c_start"), "length", "chunk_hash")
    own = at.join(chunk, "container_hash").where((F.col("c") >= F.col("chunk_start")) & (F.col("c") < F.col("chunk_end")))
    base = F.min("c_start").over(Window.partitionBy("file_id", "seg_idx"))
    return own.select("file_id", (F.col("first_chunk") + F.col("c") - F.col("chunk_start")).alias("chunk_idx"), (F.col("first_byte") + F.col("c_start") - base).alias("byte_start"), "length", "chunk_hash")


def windows_of_edits(chunks: DataFrame, edits: DataFrame, low: int, high: int) -> DataFrame:
    """Windows to cut anew, see ``sessions.edit_windows``, with their bytes: file_id, start_chunk, end_chunk, start, end. An edit at the end of a file touches its last chunk."""
    from .sessions import edit_windows

    size = chunks.groupBy("file_id").agg(F.max(F.col("byte_start") + F.col("length")).alias("size"))
    start = F.least("start", F.col("size") - 1)
    inside = edits.join(size, "file_id").select("file_id", start.alias("start"), F.greatest("end", start + 1).alias("end"))
    found = edit_windows(chunks, inside, low, high)
    own = chunks.select("file_id", "chunk_idx", "byte_start", (F.col("byte_start") + F.col("length")).alias("byte_end")).join(found, "file_id").where((F.col("chunk_idx") >= F.col("start_chunk")) & (F.col("chunk_idx") < F.col("end_chunk")))
    return own.groupBy("file_id", "start_chunk", "end_chunk").agg(F.min("byte_start").alias("start"), F.max("byte_end").alias("end"))


def gaps(windows: DataFrame) -> DataFrame:
    """What lies between the windows of a file, before the first and after the last: file_id, gap_start, gap_end in chunks, window: the start of the window before."""
    w = Window.partitionBy("file_id").orderBy("start_chunk")
    begins = windows.select("file_id", F.coalesce(F.lag("end_chunk").over(w), F.lit(0)).alias("gap_start"), F.col("start_chunk").alias("gap_end"), F.lag("start_chunk").over(w).alias("window"))
    last = windows.groupBy("file_id").agg(F.max("end_chunk").alias("gap_start"), F.lit(2**62).alias("gap_end"), F.max("start_chunk").alias("window"))
    return begins.unionByName(last).where("gap_start < gap_end")


def composed(segments: DataFrame, placed: DataFrame, windows: DataFrame, made: DataFrame) -> DataFrame:
    """Segments of files after their windows were replaced: file_id, seg_idx, container_hash, chunk_start, chunk_end, bytes.

    windows(file_id, start_chunk, end_chunk) don't touch each other; made(file_id,
    start_chunk, seg_idx, container_hash, chunk_start, chunk_end, bytes) are the new
    segments of each. Segments outside the windows are taken over, those that a window
    cuts into as far as they lie outside: windows begin and end with chunks.
    """
    before = Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = segments.withColumn("n", F.col("chunk_end") - F.col("chunk_start")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    met = at.join(gaps(windows), "file_id").where((F.col("first") < F.col("gap_end")) & (F.col("gap_start") < F.col("first") + F.col("n")))
    start, end = F.greatest("first", "gap_start"), F.least(F.col("first") + F.col("n"), "gap_end")
    left = met.select("file_id", start.alias("pos"), "container_hash", (F.col("chunk_start") + start - F.col("first")).alias("a"), (F.col("chunk_start") + end - F.col("first")).alias("b"))
    chunk = placed.select("container_hash", "chunk_idx", "byte_start", (F.col("byte_start") + F.col("length")).alias("byte_end"))
    left = left.join(chunk.select("container_hash", F.col("chunk_idx").alias("a"), "byte_start"), ["container_hash", "a"]).join(chunk.select("container_hash", (F.col("chunk_idx") + 1).alias("b"), "byte_end"), ["container_hash", "b"])
    old = left.select("file_id", "pos", F.lit(0).cast("long").alias("k"), "container_hash", F.col("a").alias("chunk_start"), F.col("b").alias("chunk_end"), (F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    new = made.select("file_id", F.col("start_chunk").alias("pos"), F.col("seg_idx").cast("long").alias("k"), "container_hash", "chunk_start", "chunk_end", "bytes")
    order = Window.partitionBy("file_id").orderBy("pos", "k")
    return old.unionByName(new).withColumn("seg_idx", (F.row_number().over(order) - 1).cast("long")).select("file_id", "seg_idx", "container_hash", "chunk_start", "chunk_end", "bytes")


def composed_chunks(chunks: DataFrame, windows: DataFrame, made: DataFrame) -> DataFrame:
    """The chunk list after the windows were replaced: file_id, chunk_idx, chunk_hash, length.

    made(file_id, start_chunk, chunk_idx, chunk_hash, length) are the new chunks of each window.
    Chunks after a window move by as many as it and those before it have grown; no chunk is numbered anew in its file's order.
    """
    n_new = made.groupBy("file_id", "start_chunk").agg(F.count("*").alias("n_new"))
    w = Window.partitionBy("file_id").orderBy("start_chunk")
    grown = windows.select("file_id", "start_chunk", "end_chunk").join(n_new, ["file_id", "start_chunk"], "left").withColumn("by", F.coalesce("n_new", F.lit(0)) - (F.col("end_chunk") - F.col("start_chunk"))).withColumn("upto", F.sum("by").over(w))
    shift = grown.select("file_id", F.col("start_chunk").alias("window"), F.col("upto").alias("move"), (F.col("upto") - F.col("by")).alias("own"))
    between = gaps(windows).join(shift, ["file_id", "window"], "left")
    kept = chunks.join(between, "file_id").where((F.col("chunk_idx") >= F.col("gap_start")) & (F.col("chunk_idx") < F.col("gap_end")))
    kept = kept.select("file_id", (F.col("chunk_idx") + F.coalesce("move", F.lit(0))).alias("chunk_idx"), "chunk_hash", "length")
    new = made.join(shift.withColumnRenamed("window", "start_chunk"), ["file_id", "start_chunk"]).select("file_id", (F.col("start_chunk") + F.col("own") + F.col("chunk_idx")).alias("chunk_idx"), "chunk_hash", "length")
    return kept.unionByName(new)
