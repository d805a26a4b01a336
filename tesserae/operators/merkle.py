"""Merkle hashes of ordered chunk lists, many lists at a time.

A level's nodes are grouped in order: a group ends at the first node from the
third on whose hash is a multiple of four, at the ninth node, or with the level.
A parent's hash covers a line ``hash : size`` for each child. Levels of all
lists in a batch are hashed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.blake3 import NODE_KEY, RANGE_KEY, from_hex, keyed_hashes, to_hex
from tesserae.functions.hashes import ZERO

SHORTEST, LONGEST, FANOUT = 2, 9, 4
Node = tuple[str, int]


def group_ends(hashes: list[str]) -> list[int]:
    """Where the groups of a level end (exclusive)."""
    ends, start, n = [], 0, len(hashes)
    cuts = [int(h[-1], 16) % FANOUT == 0 for h in hashes]
    while start < n:
        stop = min(start + LONGEST, n)
        end = next((i + 1 for i in range(start + SHORTEST, stop) if cuts[i]), stop)
        ends.append(end)
        start = end
    return ends


def roots(lists: list[list[Node]]) -> list[str]:
    """Root hash of each list; a list of one node is its own root, an empty one has the zero hash."""
    level = [list(x) for x in lists]
    while any(len(x) > 1 for x in level):
        groups = []
        for i, nodes in enumerate(level):
            if len(nodes) > 1:
                ends = group_ends([h for h, _ in nodes])
                groups += [(i, nodes[a:b]) for a, b in zip([0, *ends], ends)]
        made = keyed_hashes(["".join(f"{h} : {s}\n" for h, s in g).encode() for _, g in groups], NODE_KEY)
        for i in {i for i, _ in groups}:
            level[i] = []
        for (i, g), raw in zip(groups, made):
            level[i].append((to_hex(raw), sum(s for _, s in g)))
    return [x[0][0] if x else ZERO for x in level]


def file_hashes(lists: list[list[Node]], salt: bytes = bytes(32)) -> list[str]:
    """Roots hashed once more under a salt; an empty list keeps the zero hash."""
    return salted_roots(lists, roots(lists), salt)


def salted_roots(lists: list[list[Node]], tops: list[str], salt: bytes = bytes(32)) -> list[str]:
    salted = keyed_hashes([from_hex(t) for t in tops], salt)
    return [to_hex(s) if x else ZERO for x, s in zip(lists, salted)]


def range_hashes(lists: list[list[str]]) -> list[str]:
    return [to_hex(x) for x in keyed_hashes([b"".join(map(from_hex, h)) for h in lists], RANGE_KEY)]


def slices_of_lists(sizes: list[int], most: int = 50_000) -> Iterator[tuple[int, int]]:
    """Runs of lists of ``most`` items together, or one longer list: first, end."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def node_lists(column: pa.Array) -> list[list[Node]]:
    """Nodes of each row of a column of lists of structs with chunk_hash and length."""
    flat = column.flatten()
    nodes = list(zip(flat.field("chunk_hash").to_pylist(), flat.field("length").to_pylist()))
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).tolist()
    return [nodes[x:y] for x, y in zip([0, *ends], ends)]


def merkle_hashes(chunks: DataFrame, key: str = "file_id", ranges: bool = True) -> DataFrame:
    """chunks(key, chunk_idx, chunk_hash, length) -> key, container_hash, file_hash and, if asked for, range_hash of each list."""
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_hash", "length"))).alias("nodes"))
    kind = lists.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in slices_of_lists(pc.list_value_length(b.column("nodes")).to_pylist()):
                part = b.slice(at, end - at)
                nodes = node_lists(part.column("nodes"))
                tops = roots(nodes)
                hashed = [tops, salted_roots(nodes, tops)] + [range_hashes([[h for h, _ in x] for x in nodes])] * ranges
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(h, pa.string()) for h in hashed)], names=[key, *names])

    names = ["container_hash", "file_hash"] + ["range_hash"] * ranges
    return lists.select(key, "nodes").mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{x} string" for x in names)]))
