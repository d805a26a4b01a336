"""Order-dependent dedup of files: greedy runs, fragmentation control, session leftovers.

A file is a fold over its chunks in order, so each file is one group and files
are independent; what they are held against is joined beforehand, as at most one
place a chunk. A group is as large as one file's chunk list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = "file_id long, seg_idx long, target string, chunk_start long, chunk_end long, bytes long, decision string"


START = (None, None, [], False, 0)


def cited_ranges(rows, state, window: int, limit: float, low: float, last: bool):
    """Closed ranges (seg_idx, target, start, end, bytes, decision) of a file's next chunks, and the state to go on from.

    rows are (target, target_idx, length) in order; target is None for a chunk
    that nothing knows. Chunks at consecutive places of one target are a run. A
    run that goes on from the last range joins it. Any other run of known chunks
    is held against the mean number of chunks of the last ``window`` ranges, once
    there are so many: a run shorter than the mean becomes new data (decision
    ``prevented``) while the mean is under the bar. The bar is ``low * limit``; it
    is ``limit`` from a rejection on, until the mean has reached that.
    """
    run, held, sizes, strict, n_closed = state
    sizes, closed = list(sizes), []

    def settle(target, at, chunks, size):
        nonlocal held, strict, n_closed
        decision = "new" if target is None else "known"
        follows = held is not None and target is not None and held[0] == target and held[2] == at
        if target is not None and not follows and len(sizes) == window:
            mean = sum(sizes) / window
            strict = strict and mean < limit
            if chunks < mean < (limit if strict else low * limit):
                target, at, decision, strict = None, 0, "prevented", True
        if follows or (held is not None and target is None and held[4] == decision):
            held = (*held[:2], held[2] + chunks, held[3] + size, decision)
            sizes[-1] += chunks
            return
        if held is not None:
            closed.append((n_closed, *held))
            n_closed += 1
        held = (target, at, at + chunks, size, decision)
        sizes.append(chunks)
        del sizes[:-window]

    for target, at, size in rows:
        if run is not None and target is not None and run[0] == target and run[1] + run[2] == at:
            run = (target, run[1], run[2] + 1, run[3] + size)
            continue
        if run is not None:
            settle(*run)
        run = (target, 0 if target is None else at, 1, size)
    if last:
        if run is not None:
            settle(*run)
        if held is not None:
            closed.append((n_closed, *held))
        return closed, START
    return closed, (run, held, sizes, strict, n_closed)


def greedy_segments(chunks: DataFrame, index: DataFrame, window: int = 128, limit: float = 8.0, low: float = 0.5) -> DataFrame:
    """Files as runs of known chunks and runs of new data, first match first; see ``cited_ranges``.

    index(chunk_hash, target string, target_idx long) holds one place a chunk.
    """
    place = index.select("chunk_hash", "target", "target_idx")
    located = chunks.select("file_id", "chunk_idx", "chunk_hash", "length").join(place, "chunk_hash", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        rows = zip(pdf["target"].where(pdf["target"].notna(), None), pdf["target_idx"].fillna(-1).astype("int64"), pdf["length"])
        closed, _ = cited_ranges(rows, START, window, limit, low, True)
        return pd.DataFrame([(pdf["file_id"].iloc[0], *r) for r in closed], columns=["file_id", "seg_idx", "target", "chunk_start", "chunk_end", "bytes", "decision"])

    return located.groupBy("file_id").applyInPandas(fold, SEGMENTS)


def session_metrics(segments: DataFrame, shared: DataFrame, uploads: DataFrame) -> DataFrame:
    """The 13 sums of a session by file.

    segments as ``greedy_segments`` gives them; shared(target) are targets that the
    shared index named; uploads(file_id, container_bytes, shard_bytes) is what was sent.
    """
    chunks, size = F.col("chunk_end") - F.col("chunk_start"), F.col("bytes")
    known, prevented = F.col("decision") == "known", F.col("decision") == "prevented"
    s = segments.join(shared.select("target", F.lit(True).alias("by_shared")).distinct(), "target", "left")
    of = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0))
    out = s.groupBy("file_id").agg(
        *(f.alias(n.format(unit)) for unit, what in (("bytes", size), ("chunks", chunks)) for n, f in (
            ("total_{}", F.sum(what)), ("deduped_{}", of(known, what)), ("new_{}", of(~known, what)),
            ("deduped_{}_by_global_dedup", of(known & F.col("by_shared"), what)), ("defrag_prevented_dedup_{}", of(prevented, what)),
        ))
    )
    sent = uploads.groupBy("file_id").agg(F.sum("container_bytes").alias("container_bytes_uploaded"), F.sum("shard_bytes").alias("shard_bytes_uploaded"))
    out = out.join(sent, "file_id", "left").fillna(0, ["container_bytes_uploaded", "shard_bytes_uploaded"])
    return out.withColumn("total_bytes_uploaded", F.col("container_bytes_uploaded") + F.col("shard_bytes_uploaded"))


def merged_leftovers(leftovers: DataFrame, by: str, max_bytes: int, max_chunks: int) -> DataFrame:
    """leftovers(by, file_id, bytes, chunks) in order of file -> container number of each.

    The open container takes the next leftover if both fit together; else the
    larger of the two is closed and the smaller stays open.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_id")
        home: dict = {}
        opened: list = []
        held, count, made = 0, 0, 0
        for f, b, c in pdf[["file_id", "bytes", "chunks"]].itertuples(index=False):
            if held + b <= max_bytes and count + c <= max_chunks:
                opened, held, count = opened + [f], held + b, count + c
                continue
            closed, kept = (opened, ([f], b, c)) if held >= b else ([f], (opened, held, count))
            home |= dict.fromkeys(closed, made)
            made += 1
            opened, held, count = kept
        home |= dict.fromkeys(opened, made)
        return pdf.assign(container=pdf["file_id"].map(home))

    kept = leftovers.select(by, "file_id", "bytes", "chunks")
    kind = kept.schema[by].dataType.simpleString()
    return kept.groupBy(by).applyInPandas(fold, f"{by} {kind}, file_id long, bytes long, chunks long, container long")


def flush_windows(made: DataFrame, interval_ms: int = 20_000, most: int = 64) -> DataFrame:
    """made(session, ts_ms, container) -> the same with flush: which flush of its session takes a container.

    A window begins with its first container; one that comes ``interval_ms`` or more
    after that, or finds ``most`` in the window, begins the next. A fold over a
    session's containers in order of time.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "container"])
        flushes, begin, held, k = [], None, 0, 0
        for at in pdf["ts_ms"].tolist():
            if begin is None or at - begin >= interval_ms or held == most:
                begin, held, k = at, 0, k + (begin is not None)
            held += 1
            flushes.append(k)
        return pdf.assign(flush=flushes)

    kept = made.select("session", "ts_ms", "container")
    return kept.groupBy("session").applyInPandas(fold, f"session {kept.schema['session'].dataType.simpleString()}, ts_ms long, container {kept.schema['container'].dataType.simpleString()}, flush long")


def chain_size(ranges: DataFrame, terms: DataFrame) -> DataFrame:
    """ranges(block, start, end), terms(block, start, end, size) -> block, size of each block that has ranges.

    A block's chunk ranges are those that are fetched for it; its size is told by
    terms that follow each other from the first range's start to the last one's end.
    Which places such chains reach, and with how many bytes, is carried over the
    terms in order of start: a term that begins at a reached place makes its end
    reached, and the end of a range makes the start of the next one reached at no
    cost. The first way to a place counts. Null where the last end is not reached:
    terms leave a hole, or overlap without sharing ends.

    A block's terms are folded as distinct (start, end), so a fold has no more steps than pairs
    of a container's chunks.
    """
    size = F.col("size").cast("long")
    place = lambda c: F.col(c).cast("long").alias(c)
    own = ranges.select("block", place("start"), place("end")).groupBy("block").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("r"))
    found = terms.groupBy("block", place("start"), place("end")).agg(F.min(size).alias("size")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "end", "size"))).alias("t"))
    bridge = F.transform("r", lambda x, i: F.struct(x["end"].alias("key"), F.get("r", i + 1)["start"].alias("value")))
    bridges = F.map_from_entries(F.filter(bridge, lambda x: x["key"] < x["value"]))

    def reached(places: Column, at: Column, bytes_: Column) -> Column:
        return F.when(at.isNull() | F.map_contains_key(places, at), places).otherwise(F.map_concat(places, F.create_map(at, bytes_)))

    def step(places: Column, term: Column) -> Column:
        with_term = F.try_element_at(places, term["start"]) + term["size"]
        further = reached(reached(places, term["end"], with_term), F.try_element_at("bridges", term["end"]), with_term)
        return F.when(with_term.isNull(), places).otherwise(further)

    seed = F.create_map(F.get("r", F.lit(0))["start"], F.lit(0).cast("long"))
    joined = own.withColumn("bridges", bridges).join(found, "block", "left")
    places = F.aggregate(F.coalesce("t", F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>")), seed, step)
    return joined.select("block", F.try_element_at(places, F.element_at("r", -1)["end"]).alias("size"))


def edit_windows(chunks: DataFrame, edits: DataFrame, low: int, high: int) -> DataFrame:
    """Chunk windows to cut anew around edits: file_id, start_chunk, end_chunk.

    chunks(file_id, chunk_idx, byte_start, length), edits(file_id, start, end). A
    window begins with the first chunk that an edit touches and goes on until two
    chunks in a row have stable sizes, in [low, high); windows that touch are one.
    """
    from .intervals import coalesced

    w = Window.partitionBy("file_id").orderBy("chunk_idx")
    stable = (F.col("length") >= low) & (F.col("length") < high)
    follows = F.lead("length").over(w)
    ends = chunks.withColumn("settled", stable & (follows >= low) & (follows < high))
    # for each chunk the end of the first settled pair from it on, or the end of the file
    after = Window.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(0, Window.unboundedFollowing)
    ends = ends.withColumn("stop", F.coalesce(F.min(F.when(F.col("settled"), F.col("chunk_idx") + 2)).over(after), F.max("chunk_idx").over(after) + 1))
    ends = ends.withColumn("next_stop", F.coalesce(F.lead("stop").over(w), F.col("chunk_idx") + 1))
    hit = edits.join(ends, "file_id").where((F.col("start") < F.col("byte_start") + F.col("length")) & (F.col("byte_start") < F.greatest("end", F.col("start") + 1)))
    one = hit.groupBy("file_id", "start", "end").agg(F.min("chunk_idx").alias("a"), F.max_by("next_stop", "chunk_idx").alias("b"))
    return coalesced(one.select("file_id", F.col("a").alias("start"), F.col("b").alias("end")), ["file_id"]).select("file_id", F.col("start").alias("start_chunk"), F.col("end").alias("end_chunk"))
