"""Packing new chunks into bounded containers, and what follows from the packing.

Packing is a fold in order. ``pack`` folds a group in one task, so its groups have
to be bounded ranges of files; ``pack_ranges`` makes the same containers for groups
of any size, a whole source in one order included.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.shared import written

PACK = "grp long, file_id long, chunk_idx long, chunk_hash string, length long, bin long, pos long"


def pack(new_chunks: DataFrame, max_bytes: int, max_chunks: int) -> DataFrame:
    """new_chunks(grp, file_id, chunk_idx, chunk_hash, length) with bin and pos: a container is cut before the chunk that would exceed a bound."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file_id", "chunk_idx"])
        bins, places = [], []
        b = held = n = 0
        for size in pdf["length"].tolist():
            if n and (held + size > max_bytes or n == max_chunks):
                b, held, n = b + 1, 0, 0
            bins.append(b)
            places.append(n)
            held, n = held + size, n + 1
        return pdf.assign(bin=bins, pos=places)

    return new_chunks.select("grp", "file_id", "chunk_idx", "chunk_hash", "length").groupBy("grp").applyInPandas(fold, PACK)


def _next_starts(upto: np.ndarray, max_bytes: int, max_chunks: int) -> np.ndarray:
    """For a container that starts at each place, the place of the next start; n if that lies behind the range. ``upto`` has n + 1 running sums."""
    n = len(upto) - 1
    at = np.arange(n)
    by_bytes = np.maximum(np.searchsorted(upto, upto[:-1] + max_bytes, side="right") - 1, at + 1)
    return np.minimum(np.minimum(by_bytes, at + max_chunks), n)


def _sums(lengths: pd.Series) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(np.int64))])


MOVES = "grp long, range long, s long, upto long, bins long, held long, chunks long, n long, bytes long"


def range_moves(placed: DataFrame, max_bytes: int, max_chunks: int) -> DataFrame:
    """For each place ``s`` of a range at which its first container can start: the containers begun from there on, and what the last holds at the end.

    The container that is open before a range takes fewer than ``max_chunks`` chunks
    of it, so there are at most ``max_chunks`` such places a range, whatever came before.
    """

    def moves(pdf: pd.DataFrame) -> pd.DataFrame:
        upto = _sums(pdf.sort_values("id")["length"])
        n = len(upto) - 1
        after = _next_starts(upto, max_bytes, max_chunks)
        last = np.where(after < n, after, np.arange(n))
        hops = (after < n).astype(np.int64)
        while ((far := last[last]) != last).any():  # doubles the hops of each round
            hops, last = hops + hops[last], far
        s = np.arange(min(n, max_chunks))
        begin = last[s]
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "range": pdf["range"].iloc[0], "s": s, "upto": upto[s + 1], "bins": hops[s] + 1, "held": upto[n] - upto[begin], "chunks": n - begin, "n": n, "bytes": upto[n]})

    return placed.select("grp", "range", "id", "length").groupBy("grp", "range").applyInPandas(moves, MOVES)


def range_entries(moves: DataFrame, max_bytes: int, max_chunks: int) -> DataFrame:
    """grp, range, bin, held, chunks: the containers begun before each range, and what the open one holds there.

    A group's ranges are gone through in order, one range's moves in memory at a time.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MOVES.split(", ")]
        rows = (r for b in batches for r in zip(*(b[c].tolist() for c in names)))
        for grp, of_group in groupby(rows, itemgetter(0)):
            begun = held = chunks = 0
            for place, of_range in groupby(of_group, itemgetter(1)):
                yield pd.DataFrame([(grp, place, begun, held, chunks)], columns=["grp", "range", "bin", "held", "chunks"])
                n = size = 0
                first = None
                for _, _, s, upto, *there, n, size in of_range:
                    if first is None and (not chunks or held + upto > max_bytes or chunks + s == max_chunks):
                        first = there
                if first is None:
                    held, chunks = held + size, chunks + n
                else:
                    begun, held, chunks = begun + first[0], first[1], first[2]

    ordered = moves.repartition("grp").sortWithinPartitions("grp", "range", "s")
    return ordered.mapInPandas(walk, "grp long, range long, bin long, held long, chunks long")


def pack_ranges(new_chunks: DataFrame, max_bytes: int, max_chunks: int, rows: int = 250_000) -> DataFrame:
    """The same as ``pack``, for groups of any size: no task holds more than a range of about ``rows`` chunks.

    Chunks are sorted in ranges by group and place. Each range tells for every place
    at which its first container can start how its last one ends (``range_moves``);
    going through these few rows in order tells what is open before each range
    (``range_entries``), and then all ranges are packed side by side. Chunks are
    distinct by (grp, file_id, chunk_idx); lengths are not null. A chunk larger than
    ``max_bytes`` has a container to itself; an empty table gives an empty result.
    """
    names = ["grp", "file_id", "chunk_idx"]
    new = written(new_chunks.select(F.col("grp").cast("long").alias("grp"), "file_id", "chunk_idx", "chunk_hash", "length"), "new-chunks")
    placed = new.repartitionByRange(new.count() // rows + 1, *names).sortWithinPartitions(*names).withColumn("id", F.monotonically_increasing_id())
    # the id has the range in its upper bits and the place within the range in the lower 33
    placed = written(placed, "chunks-in-order").withColumn("range", F.shiftright("id", 33))
    entries = written(range_entries(range_moves(placed, max_bytes, max_chunks), max_bytes, max_chunks), "range-entries")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        upto = _sums(pdf["length"])
        n, bin_, held, chunks = len(upto) - 1, *pdf[["bin", "held", "chunks"]].iloc[0].tolist()
        over = np.flatnonzero((held + upto[1:] > max_bytes) | (chunks + np.arange(n) == max_chunks)) if chunks else [0]
        starts, at, after = [], int(over[0]) if len(over) else n, _next_starts(upto, max_bytes, max_chunks).tolist()
        while at < n:
            starts.append(at)
            at = after[at]
        nth = np.searchsorted(starts, np.arange(n), side="right")  # 0: still in the container that was open
        pos = np.arange(n) - np.concatenate([[-chunks], starts]).astype(np.int64)[nth]
        return pdf[["grp", "file_id", "chunk_idx", "chunk_hash", "length"]].assign(bin=bin_ - 1 + nth, pos=pos)

    return placed.join(entries, ["grp", "range"]).groupBy("grp", "range").applyInPandas(assign, PACK)


def containers(packed: DataFrame) -> DataFrame:
    """container_hash, grp, bin, n_chunks, bytes_raw: named by the hash of its chunk hashes in order."""
    listed = packed.groupBy("grp", "bin").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_hash"))).alias("c"), F.count("*").alias("n_chunks"), F.sum("length").alias("bytes_raw"))
    name = F.sha2(F.array_join(F.transform("c", lambda x: x["chunk_hash"]), ""), 256)
    return listed.select(name.alias("container_hash"), "grp", "bin", "n_chunks", "bytes_raw")


def container_chunks(packed: DataFrame, named: DataFrame) -> DataFrame:
    """container_hash, chunk_idx, chunk_hash, byte_start, length."""
    start = Window.partitionBy("grp", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.withColumn("byte_start", F.coalesce(F.sum("length").over(start), F.lit(0)).cast("long"))
    return placed.join(named.select("grp", "bin", "container_hash"), ["grp", "bin"]).select("container_hash", F.col("pos").alias("chunk_idx"), "chunk_hash", "byte_start", "length")


def segments(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """Files as runs of container chunks: file_id, seg_idx, container_hash, chunk_start, chunk_end, bytes.

    A segment goes on while the container is the same and the next chunk follows the last.
    """
    at = placed.select("chunk_hash", "container_hash", F.col("chunk_idx").alias("at"))
    located = chunks.select("file_id", "chunk_idx", "chunk_hash", "length").join(at, "chunk_hash")
    w = Window.partitionBy("file_id").orderBy("chunk_idx")
    follows = (F.lag("container_hash").over(w) == F.col("container_hash")) & (F.lag("at").over(w) + 1 == F.col("at"))
    marked = located.withColumn("begins", (~F.coalesce(follows, F.lit(False))).cast("long"))
    numbered = marked.withColumn("seg_idx", F.sum("begins").over(w) - 1)
    return numbered.groupBy("file_id", "seg_idx").agg(F.first("container_hash").alias("container_hash"), F.min("at").alias("chunk_start"), (F.max("at") + 1).alias("chunk_end"), F.sum("length").alias("bytes")).select(
        "file_id", "seg_idx", "container_hash", "chunk_start", "chunk_end", "bytes"
    )


def retest_windows(placed: DataFrame, every: int = 32) -> DataFrame:
    """The chunk whose compression decision holds for each stretch of ``every`` chunks of a container."""
    w = Window.partitionBy("container_hash", F.floor(F.col("chunk_idx") / every)).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("decided_by", F.first("chunk_hash").over(w))
