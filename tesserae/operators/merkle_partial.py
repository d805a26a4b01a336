"""Merkle hashes of very long lists from parts: each part is hashed where it is, and parts are merged in order.

A part doesn't know where the group that reaches into it began. It follows all
nine possibilities at once; where they have come to the same group end, that
boundary is certain whatever lies before. Nodes before the first certain boundary
and after the last stay as they are, a few a level; the groups between are hashed
and make the next level, where the same holds.

Hashing a few nodes at a time costs a hundred times what it costs beside others, so
the steps are generators that give out what they need hashed; ``in_step`` runs
those of many parts and files side by side and hashes for all of them at once.
"""

from __future__ import annotations

import json
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.blake3 import NODE_KEY, from_hex, keyed_hashes, to_hex
from tesserae.functions.hashes import ZERO

from .merkle import FANOUT, LONGEST, SHORTEST, Node, node_lists, slices_of_lists

Asking = Generator[list[bytes], list[bytes]]


def in_step(runs: list[Asking]) -> list:
    """What each of the generators returns; the messages that they ask for are hashed together."""
    done: list = [None] * len(runs)
    asked: dict[int, list[bytes]] = {}

    def go(i: int, made: list[bytes] | None) -> None:
        try:
            asked[i] = runs[i].send(made)
        except StopIteration as end:
            done[i] = end.value
            asked.pop(i, None)

    for i in range(len(runs)):
        go(i, None)
    while asked:
        now = list(asked.items())
        made = keyed_hashes([m for _, messages in now for m in messages], NODE_KEY)
        at = 0
        for i, messages in now:
            go(i, made[at : at + len(messages)])
            at += len(messages)
    return done


def _ends_group(place: int, node: Node) -> bool:
    return place == LONGEST - 1 or place >= SHORTEST and int(node[0][-1], 16) % FANOUT == 0


def first_certain(nodes: list[Node]) -> int | None:
    """The first place that is a group boundary however many nodes the group before has."""
    places = set(range(LONGEST))
    for i, node in enumerate(nodes):
        places = {0 if _ends_group(p, node) else p + 1 for p in places}
        if places == {0}:
            return i + 1
    return None


def closed_groups(nodes: list[Node], at_end: bool) -> Asking:
    """Parents of the groups that end within ``nodes``, which start at a boundary, and the nodes after."""
    groups, group = [], []
    for node in nodes:
        group.append(node)
        if _ends_group(len(group) - 1, node):
            groups.append(group)
            group = []
    if at_end and group:
        groups.append(group)
        group = []
    made = (yield ["".join(f"{h} : {s}\n" for h, s in g).encode() for g in groups]) if groups else []
    return [(to_hex(raw), sum(s for _, s in g)) for raw, g in zip(made, groups)], group


@dataclass
class Level:
    left: list[Node]
    right: list[Node]
    split: bool  # whether a certain boundary parts left and right


@dataclass
class Part:
    levels: list[Level]
    at_start: bool

    def dump(self) -> str:
        return json.dumps([self.at_start, [[x.left, x.right, x.split] for x in self.levels]])

    @staticmethod
    def load(text: str) -> Part:
        start, levels = json.loads(text)
        return Part([Level([tuple(n) for n in a], [tuple(n) for n in b], s) for a, b, s in levels], start)


def part_of(nodes: list[Node], at_start: bool) -> Part:
    return in_step([making_part(nodes, at_start)])[0]


def making_part(nodes: list[Node], at_start: bool) -> Asking:
    levels, seq = [], nodes
    while seq or not levels:
        bound = 0 if at_start else first_certain(seq)
        if bound is None:
            levels.append(Level(seq, [], False))
            break
        parents, right = yield from closed_groups(seq[bound:], False)
        levels.append(Level(seq[:bound], right, True))
        seq = parents
        if not seq:
            break
    return Part(levels, at_start)


def merged(a: Part, b: Part) -> Part:
    """The part of both lists, of which b's follows a's."""
    return in_step([merging(a, b)])[0]


def merging(a: Part, b: Part) -> Asking:
    levels: list[Level] = []
    between: list[Node] = []
    for i in range(max(len(a.levels), len(b.levels)) + 1 + LONGEST):
        x = a.levels[i] if i < len(a.levels) else Level([], [], a.at_start)
        y = b.levels[i] if i < len(b.levels) else Level([], [], False)
        if i >= len(a.levels) and i >= len(b.levels) and not between:
            break
        if x.split:
            left, seq = x.left, x.right + between + y.left
        else:
            seq = x.left + between + y.left
            bound = first_certain(seq)
            bound = len(seq) if bound is None and y.split else bound
            if bound is None:
                levels.append(Level(seq, [], False))
                between = []
                continue
            left, seq = seq[:bound], seq[bound:]
        # a boundary that is certain in b ends the groups that reach it
        between, open_ = yield from closed_groups(seq, False)
        levels.append(Level(left, y.right if y.split else open_, True))
    return Part(levels, a.at_start)


def root(part: Part) -> str:
    """Of a part that is the whole list."""
    return in_step([closing(part)])[0]


def closing(part: Part) -> Asking:
    if not part.at_start:
        raise ValueError("the list's start is missing")
    tail: list[Node] = []
    for i in range(len(part.levels) + 64):
        own = part.levels[i].right if i < len(part.levels) else []
        seq = own + tail
        above = any(x.left or x.right for x in part.levels[i + 1 :])
        if not above and len(seq) <= 1:
            return seq[0][0] if seq else ZERO
        tail = (yield from closed_groups(seq, True))[0]
    raise ValueError("a list of more than 2**64 nodes")


def merkle_hashes_of_parts(chunks: DataFrame, part_chunks: int = 1 << 16) -> DataFrame:
    """chunks(file_id, chunk_idx, chunk_hash, length) -> file_id, file_hash; no task holds more than ``part_chunks`` chunks of a file, and later a few nodes a level of each part."""

    def hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in slices_of_lists(pc.list_value_length(b.column("nodes")).to_pylist()):
                some = b.slice(at, end - at)
                made = in_step([making_part(nodes, part == 0) for nodes, part in zip(node_lists(some.column("nodes")), some.column("part").to_pylist())])
                yield pa.RecordBatch.from_arrays([some.column("file_id"), some.column("part"), pa.array([x.dump() for x in made], pa.string())], names=["file_id", "part", "state"])

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in slices_of_lists(pc.list_value_length(b.column("states")).to_pylist(), 5_000):
                some = b.slice(at, end - at)
                parts = [[Part.load(x["state"]) for x in states] for states in some.column("states").to_pylist()]
                while any(len(p) > 1 for p in parts):
                    pairs = [(i, k) for i, p in enumerate(parts) for k in range(0, len(p) - 1, 2)]
                    made = dict(zip(pairs, in_step([merging(*parts[i][k : k + 2]) for i, k in pairs])))
                    parts = [[made.get((i, k), p[k]) for k in range(0, len(p), 2)] for i, p in enumerate(parts)]
                tops = keyed_hashes([from_hex(x) for x in in_step([closing(p[0]) for p in parts])], bytes(32))
                yield pa.RecordBatch.from_arrays([some.column("file_id"), pa.array([to_hex(x) for x in tops], pa.string())], names=["file_id", "file_hash"])

    lists = chunks.withColumn("part", F.floor(F.col("chunk_idx") / part_chunks)).groupBy("file_id", "part").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_hash", "length"))).alias("nodes"))
    parts = lists.select("file_id", "part", "nodes").mapInArrow(hash_parts, "file_id long, part long, state string")
    states = parts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("part", "state"))).alias("states"))
    return states.select("file_id", "states").mapInArrow(join_parts, "file_id long, file_hash string")
