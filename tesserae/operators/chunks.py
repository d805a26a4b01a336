"""Files to chunk rows: file_id, chunk_idx, chunk_hash, length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.chunking import WINDOW, ChunkSpec, candidates, chosen_cuts, cut_points, default_gear
from tesserae.sources.shared import written


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One chunk a line; blank lines are chunks too. Null text has none."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("file_id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    return lines.select("file_id", F.col("i").cast("long").alias("chunk_idx"), F.sha2("line", 256).alias("chunk_hash"), F.octet_length("line").cast("long").alias("length"))


def content_chunks(files: DataFrame, spec: ChunkSpec = ChunkSpec(), with_data: bool = False) -> DataFrame:
    """Content-defined chunks of files(file_id long, data binary), hashed with SHA-256; each file is cut within its row."""
    fields = "file_id long, chunk_idx long, offset long, length long, chunk_hash string" + (", data binary" if with_data else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = default_gear()
        for b in batches:
            ids, idx, at, size, digest, data = [], [], [], [], [], []
            for file_id, value in zip(b.column("file_id").to_pylist(), b.column("data")):
                body = value.as_py() or b""
                cuts = cut_points(body, spec, gear)
                for i, (x, y) in enumerate(zip([0, *cuts], cuts)):
                    ids.append(file_id)
                    idx.append(i)
                    at.append(x)
                    size.append(y - x)
                    digest.append(hashlib.sha256(body[x:y]).hexdigest())
                    if with_data:
                        data.append(body[x:y])
            columns = [pa.array(c, pa.int64()) for c in (ids, idx, at, size)] + [pa.array(digest, pa.string())] + ([pa.array(data, pa.binary())] if with_data else [])
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "chunk_idx", "offset", "length", "chunk_hash"] + ["data"] * with_data)

    return files.select("file_id", "data").mapInArrow(run, fields)


def _runs(file_id: np.ndarray, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a batch's blocks by file and place, and where in it runs of blocks that follow each other begin."""
    order = np.lexsort((offset, file_id))
    f, at, n = file_id[order], offset[order], size[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (f[1:] != f[:-1]) | (at[1:] != at[:-1] + n[:-1])
    return order, np.flatnonzero(begins)


def _places(body: np.ndarray, gear: np.ndarray, mask: int, stretch: int = 1 << 18) -> np.ndarray:
    """``candidates`` of long data, a stretch at a time: eight bytes for each are held."""
    found = [np.zeros(0, np.int64)]
    for x in range(0, len(body), stretch):
        low = max(0, x - WINDOW + 1)
        at = candidates(body[low : x + stretch], gear, mask) + low
        found.append(at[at > x])
    return np.concatenate(found)


def _own_places(spec: ChunkSpec):
    """Of each run of blocks that lie together: its places that its own bytes allow, and its first and last bytes, ``WINDOW`` - 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, edge = default_gear(), WINDOW - 1
        for b in batches:
            b = b.filter(pc.greater(pc.coalesce(pc.binary_length(b.column("data")), pa.scalar(0, pa.int32())), 0))
            if not b.num_rows:
                continue
            size = pc.binary_length(b.column("data")).to_numpy().astype(np.int64)
            numbered = b.column("file_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            offset = b.column("offset").to_numpy(zero_copy_only=False)
            order, first = _runs(numbered, offset, size)
            body = np.frombuffer(b"".join(b.column("data").take(pa.array(order)).to_pylist()), np.uint8)
            start = np.concatenate([[0], np.cumsum(size[order])])[[*first, len(order)]]
            # whether a place allows a cut depends on WINDOW bytes: those of one run, from its WINDOW-th on
            at = _places(body, gear, spec.mask)
            of = np.searchsorted(start, at, "left") - 1
            inside = at - start[of]
            own = inside > edge
            places = np.concatenate([[0], np.cumsum(np.bincount(of[own], minlength=len(first)))])
            begin = offset[order[first]]
            values = (inside + begin[of])[own]
            front = [body[x : min(x + edge, y)].tobytes() for x, y in zip(start[:-1].tolist(), start[1:].tolist())]
            tail = [body[max(y - edge, x) : y].tobytes() for x, y in zip(start[:-1].tolist(), start[1:].tolist())]
            columns = [pa.array(begin), pa.array(np.diff(start)), pa.array(front, pa.binary()), pa.array(tail, pa.binary()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values))]
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(order[first])), *columns], names=["file_id", "offset", "size", "front", "tail", "allowed"])

    return run


def _seam_places(spec: ChunkSpec):
    """Places among a run's first bytes, from what comes before them and themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = default_gear()
        for b in batches:
            found = []
            for offset, tails, front in zip(b.column("offset").to_pylist(), b.column("tails").to_pylist(), b.column("front").to_pylist()):
                head = b"".join(x["tail"] for x in tails)[1 - WINDOW :]
                at = candidates(np.frombuffer(head + front, np.uint8), gear, spec.mask) - len(head)
                found.append((at[at > 0] + offset).tolist())
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("offset"), pa.array([0] * b.num_rows, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file_id", "offset", "size", "allowed"])

    return run


def _choose(spec: ChunkSpec):
    """Rows of runs and seams, in order of file and place -> the cuts of each file."""

    def cuts_of(file_id, offset: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple:
        own = size > 0
        ends = np.cumsum(size[own])
        if (offset[own] != np.concatenate([[0], ends[:-1]])).any():
            raise ValueError(f"the blocks of file {file_id} don't follow each other")
        cuts = np.array(chosen_cuts(np.sort(allowed), int(ends[-1]), spec), np.int64)
        starts = np.concatenate([[0], cuts[:-1]])
        return file_id, cuts, starts

    def told(found: list[tuple]) -> pa.RecordBatch:
        n = [len(cuts) for _, cuts, _ in found]
        ids = pa.array([f for f, _, _ in found], pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
        cuts, starts = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.arange(k) for k in n])), pa.array(starts), pa.array(cuts - starts)], names=["file_id", "chunk_idx", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids, lists = b.column("file_id").to_pylist(), b.column("allowed")
            offset, size = b.column("offset").to_numpy(), b.column("size").to_numpy()
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            allowed = lists.flatten().to_numpy()
            bounds = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            found = []
            for x, y in zip(bounds, bounds[1:]):
                if held and ids[x] != last:
                    found.append(cuts_of(last, *(np.concatenate(c) for c in zip(*held))))
                    held = []
                last = ids[x]
                held.append((offset[x:y], size[x:y], allowed[upto[x] : upto[y]]))
            if found:
                yield told(found)
        if held:
            yield told([cuts_of(last, *(np.concatenate(c) for c in zip(*held)))])

    return run


def cuts_of_blocks(blocks: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """file_id, chunk_idx, offset, length of files that come as blocks(file_id, offset, data), cut as they would be in one piece.

    Whether a cut is allowed at a place depends on the last ``WINDOW`` bytes alone.
    Blocks stay where they are: a task puts blocks that follow each other in a batch
    together to runs, finds the places that a run's own bytes decide and gives out its
    first and last bytes, ``WINDOW`` - 1 at most. Those meet by where they lie in the
    file: the bytes before a run come from as many earlier ones as it takes, so blocks
    may have any length and lie in any order. Of the data nothing else is shuffled. Cuts
    are then chosen by file among the allowed places, about one for ``target`` bytes.

    A file whose blocks leave a hole or overlap ends the job; one without bytes has no chunks.
    """
    marked = written(blocks.select("file_id", "offset", "data").mapInArrow(_own_places(spec), "file_id long, offset long, size long, front binary, tail binary, allowed array<long>"), "block-places")
    stretch = lambda c: F.floor(c / WINDOW)
    ends = marked.select("file_id", (F.col("offset") + F.col("size")).alias("end"), "tail")
    # a tail is of use to runs that begin less than WINDOW bytes after its end: in its stretch of WINDOW bytes or the next
    ends = ends.withColumn("at", F.explode(F.array(stretch(F.col("end")), stretch(F.col("end")) + 1)))
    fronts = marked.select("file_id", "offset", "front", stretch(F.col("offset")).alias("at"))
    met = fronts.join(ends, ["file_id", "at"], "left").withColumn("near", (F.col("end") <= F.col("offset")) & (F.col("end") > F.col("offset") - (WINDOW - 1)))
    seams = met.groupBy("file_id", "offset").agg(F.first("front").alias("front"), F.array_sort(F.collect_list(F.when(F.col("near"), F.struct("end", "tail")))).alias("tails"))
    between = seams.mapInArrow(_seam_places(spec), "file_id long, offset long, size long, allowed array<long>")

    places = marked.select("file_id", "offset", "size", "allowed").unionByName(between)
    return places.repartition("file_id").sortWithinPartitions("file_id", "offset").mapInArrow(_choose(spec), "file_id long, chunk_idx long, offset long, length long")


def running_offsets(chunks: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Adds byte_start: the sum of the sizes before, within the group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("byte_start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def stable_boundary(chunks: DataFrame, low: int, high: int) -> DataFrame:
    """The first chunk of each file after which two sizes in a row lie in [low, high)."""
    w = Window.partitionBy("file_id").orderBy("chunk_idx")
    inside = lambda c: (c >= low) & (c < high)
    marked = chunks.withColumn("ok", inside(F.lead("length", 1).over(w)) & inside(F.lead("length", 2).over(w)))
    return marked.groupBy("file_id").agg(F.min(F.when(F.col("ok"), F.col("chunk_idx"))).alias("stable_idx"))


def natural_groups(chunks: DataFrame, cut) -> DataFrame:
    """Runs of chunks that end with a natural cut: file_id, group_idx, n_chunks, bytes."""
    before = Window.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    grouped = chunks.withColumn("group_idx", F.coalesce(F.sum(cut.cast("long")).over(before), F.lit(0)))
    return grouped.groupBy("file_id", "group_idx").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("bytes"))


def next_stable_boundary(chunks: DataFrame, asked: DataFrame, low: int, high: int) -> DataFrame:
    """asked(file_id, position) -> file_id, position, boundary: the end of the first two chunks in a row of sizes in [low, high) that begin at a chunk's end at or after the position; null if there are none."""
    w = Window.partitionBy("file_id").orderBy("chunk_idx")
    inside = lambda c: (c >= low) & (c < high)
    a, b = F.lead("length", 1).over(w), F.lead("length", 2).over(w)
    ends = running_offsets(chunks, "file_id", "chunk_idx", "length").withColumn("stop", F.col("byte_start") + F.col("length"))
    pairs = ends.withColumn("ok", inside(a) & inside(b)).withColumn("boundary", F.col("stop") + a + b).where("ok").select(F.col("file_id").alias("f"), "stop", "boundary")
    j = asked.join(pairs, (F.col("file_id") == F.col("f")) & (F.col("stop") >= F.col("position")), "left")
    return j.groupBy("file_id", "position").agg(F.min_by("boundary", "stop").alias("boundary"))
