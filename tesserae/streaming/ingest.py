"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.functions.chunking import ChunkSpec, cut_points, default_gear
from tesserae.operators import dedup, lookup, sessions
from tesserae.operators.metrics import MILESTONES, STAGES

CHUNKS = "file_id long, chunk_idx long, offset long, length long, chunk_hash string"


def chunk_blocks(blocks: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """Content-defined chunks of files that arrive as blocks(file_id, block_seq, data, is_last), in any block sizes.

    The state of a file is the bytes since the last certain cut: less than the
    largest chunk. A chunk is emitted once a later cut can't move it, or with the
    last block. Blocks of a file must arrive in order of block_seq across batches;
    within a batch they are put in order.
    """
    gear = default_gear()

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, offset, idx = state.get if state.exists else (b"", 0, 0)
        batch = pd.concat(list(parts)).sort_values("block_seq")
        data = bytes(tail) + b"".join(map(bytes, batch["data"]))
        last = bool(batch["is_last"].any())
        cuts = cut_points(data, spec, gear)
        # the final cut is the end of what has come so far, not of a chunk, unless the chunk is full
        if not last and cuts and cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0) < spec.max_size:
            cuts.pop()
        out, start = [], 0
        for end in cuts:
            out.append((key[0], idx, offset + start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
            idx, start = idx + 1, end
        if last:
            state.remove()
        else:
            state.update((data[start:], offset + start, idx))
        yield pd.DataFrame(out, columns=["file_id", "chunk_idx", "offset", "length", "chunk_hash"])

    return blocks.groupBy("file_id").applyInPandasWithState(advance, CHUNKS, "tail binary, offset long, chunk_idx long", "append", GroupStateTimeout.NoTimeout)


def _earlier(spark: SparkSession, index_path: str, number: int) -> DataFrame:
    """What batches before this one have put into a hash index."""
    return lookup.read_index(spark, index_path, "chunk_hash string, batch long").where(F.col("batch") < number)


def index_new_chunks(chunks: DataFrame, index_path: str, checkpoint: str, interval: str | None = None):
    """Appends chunks that the index hasn't got, batch by batch; a restart from the checkpoint repeats no batch in the result.

    Each batch is one folder named by its number, overwritten if the batch runs again. The
    index is laid out by ranges of the hash, and a batch reads those that it hits.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("chunk_hash").agg(F.min(F.struct("file_id", "chunk_idx", "length")).alias("at")).select("chunk_hash", "at.*")
        known = lookup.hit(_earlier(spark, index_path, number), first)
        lookup.write_index(first.join(known.select("chunk_hash"), "chunk_hash", "left_anti"), f"{index_path}/batch={number}", mode="overwrite")

    # so that the first batch finds a table
    chunks.sparkSession.createDataFrame([], "chunk_hash string, file_id long, chunk_idx long, length long").write.mode("ignore").parquet(f"{index_path}/batch=-1/{lookup.RANGE}=none")
    writer = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def cite_stream(located: DataFrame, window: int = 128, limit: float = 8.0, low: float = 0.5) -> DataFrame:
    """Files as ranges of known and new chunks while their chunks arrive: what ``sessions.greedy_segments`` gives, range by range.

    located(file_id, chunk_idx, target, target_idx, length, is_last): chunks with the
    place that the index knows, if any. A file's state is its open run and range, and
    the sizes of its last ranges; a range is emitted once the next one begins. Chunks
    of a file must arrive in order across batches; within a batch they are put in order.
    """

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = json.loads(state.get[0]) if state.exists else sessions.START
        batch = pd.concat(list(parts)).sort_values("chunk_idx")
        places = zip(batch["target"].where(batch["target"].notna(), None), map(int, batch["target_idx"].fillna(-1)), map(int, batch["length"]))
        last = bool(batch["is_last"].any())
        closed, at = sessions.cited_ranges(places, at, window, limit, low, last)
        state.remove() if last else state.update((json.dumps(at),))
        yield pd.DataFrame([(key[0], *r) for r in closed], columns=["file_id", "seg_idx", "target", "chunk_start", "chunk_end", "bytes", "decision"])

    return located.groupBy("file_id").applyInPandasWithState(advance, sessions.SEGMENTS, "at string", "append", GroupStateTimeout.NoTimeout)


def two_pass_stream(chunks: DataFrame, index_path: str, found_path: str, dedup_rows: DataFrame, shard_chunks: DataFrame, eligible: Column, checkpoint: str):
    """Looks up each batch twice, see ``dedup.two_pass``; what the shared index told and what is new goes into the local index for the batches that follow.

    found_path has a folder a batch: the chunks with their pass. Folders are named by
    the batch's number and overwritten if the batch runs again.
    """
    chunks.sparkSession.createDataFrame([], "chunk_hash string").write.mode("ignore").parquet(f"{index_path}/batch=-1/{lookup.RANGE}=none")

    def look(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = lookup.hit(_earlier(spark, index_path, number), batch).select("chunk_hash")
        found, learnt = dedup.two_pass(batch, known, dedup_rows, shard_chunks, eligible)
        found.write.mode("overwrite").parquet(f"{found_path}/batch={number}")
        done = spark.read.parquet(f"{found_path}/batch={number}")
        lookup.write_index(done.where("pass is null").select("chunk_hash").distinct().unionByName(learnt), f"{index_path}/batch={number}", mode="overwrite")

    return chunks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame) -> DataFrame:
    """Furthest stage and most verified bytes of each upload, whatever order events come in; for update mode."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    at = events.groupBy("upload_id").agg(F.max(rank).alias("rank"), F.coalesce(F.max("verified"), F.lit(0)).alias("verified"), F.count("*").alias("n_events"))
    return at.select("upload_id", F.when(F.col("rank") > 0, F.element_at(F.array(*map(F.lit, STAGES)), F.greatest(F.col("rank"), F.lit(1)).cast("int"))).alias("stage"), "verified", "n_events")


def credited_progress(events: DataFrame) -> DataFrame:
    """The totals of ``metrics.credited_progress`` while events(shard_id, seq, stage, verified, total) arrive, a row for each shard that an update moves; for update mode.

    A shard's state is its counters and its furthest milestone. Events of a batch are
    taken in order of seq; a later batch can't move anything back.
    """
    rank = {m: i + 1 for i, m in enumerate(MILESTONES)}

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        verified, total, at = state.get if state.exists else (0, 0, 0)
        for stage, v, n in pd.concat(list(parts)).sort_values("seq")[["stage", "verified", "total"]].itertuples(index=False):
            if stage == "validating" and not at:
                verified, total = (int(max(a, 0 if pd.isna(b) else b)) for a, b in ((verified, v), (total, n)))
            elif stage in rank:
                verified, at = max(verified, total), max(at, rank[stage])
        state.update((verified, total, at))
        yield pd.DataFrame([(key[0], MILESTONES[at - 1] if at else "validating", total, verified, int(at >= 2), int(at == 3))], columns=["shard_id", "stage", "total", "completed", "stored", "synced"])

    return events.groupBy("shard_id").applyInPandasWithState(advance, "shard_id long, stage string, total long, completed long, stored long, synced long", "verified long, total long, rank long", "update", GroupStateTimeout.NoTimeout)


def windowed_rates(samples: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Sum and count by client and window of ts; rows later than the watermark are left out."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "client_id").agg(F.sum("value").alias("total"), F.count("*").alias("n")).select("client_id", F.col("window.start").alias("start"), "total", "n")
