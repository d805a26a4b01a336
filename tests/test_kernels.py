import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import blake3, bytegroups, hashes
from tesserae.functions.chunking import ChunkSpec, WINDOW, candidates, cut_points, default_gear
from tesserae.operators import chunks, intervals, merkle
from tesserae.operators.chunks import _own_places, _places, cuts_of_blocks

GEAR = default_gear()


def scanned_cuts(data, spec):
    """Byte at a time: the hash is rolled over everything since the last cut."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(GEAR[b])) % 2**64
        size = i + 1 - start
        if size >= spec.max_size or size >= spec.min_size and h & spec.mask == 0 and size > WINDOW:
            out.append(i + 1)
            start, h = i + 1, 0
    return out + [len(data)] * (start < len(data))


@pytest.mark.parametrize("target", [1024, 2048])
def test_cuts_equal_a_scan(target):
    rng = random.Random(7)
    spec = ChunkSpec(target=target)
    for n in (0, 1, 100, 5000, 60_000):
        data = rng.randbytes(n)
        assert cut_points(data, spec, GEAR) == scanned_cuts(data, spec)


def test_constant_data_is_cut_at_the_maximum():
    assert cut_points(bytes([59]) * 1_000_000, ChunkSpec(), GEAR) == [131072, 262144, 393216, 524288, 655360, 786432, 917504, 1000000]


def test_cuts_survive_a_change_before_them():
    data = random.Random(3).randbytes(200_000)
    spec = ChunkSpec(target=1024)
    a, b = cut_points(data, spec, GEAR), cut_points(data[:500] + b"inserted" + data[500:], spec, GEAR)
    assert len({len(data) - x for x in a} & {len(data) + 8 - x for x in b}) > 0.9 * len(a)


# published vectors: key and input 0, 1, ..., 250, 0, 1, ... of the given length
KEY = b"whats the Elvish word for friend"
VECTORS = {
    0: "92b2b75604ed3c761f9d6f62392c8a92", 1: "6d7878dfff2f485635d39013278ae14f", 1023: "c951ecdf03288d0fcc96ee3413563d8a", 1024: "75c46f6f3d9eb4f55ecaaee480db732e",
    1025: "357dc55de0c7e382c900fd6e320acc04", 31744: "efa53b389ab67c593dba624d898d0f73", 102400: "1c35d1a5811083fd7119f5d5d1ba027b",
}


def test_keyed_hashes_equal_the_published_vectors():
    data = bytes(i % 251 for i in range(102400))
    got = blake3.keyed_hashes([data[:n] for n in VECTORS], KEY)
    assert [x.hex()[:32] for x in got] == list(VECTORS.values())


# fixed values: lists of (hash, size), their root, and salted file hashes
A, B = "cfc5d07f6f03c29bbf424132963fe08d19a37d5757aaf520bf08119f05cd56d6", "c3e67584b5c4fc2a89837ec39e40f2c8a6bb0b2987ac94cd4b31e5fbdd210a72"
GOLDEN = [
    ([], hashes.ZERO, {hashes.ZERO: hashes.ZERO}),
    ([(hashes.ZERO, 0)], hashes.ZERO, {hashes.ZERO: "638a6bc391964a85939d48f008e8bdbae6a7975e7ca2d87a3ce2492f4e4d8a4c"}),
    ([(A, 100)] * 4, "89f2ada89ff8c96763c6b25010e6dd76a4c05b1466207633ea559acf2093211b", {hashes.ZERO: "2cdba690d0e09563596e0cda626d43eb4c96ef1e994fe72d9b2f5a83cfcd36dd"}),
    ([(A, 100), (B, 200)] * 2, "90f8313ef12df385d237a067aded02562c35ded12116e32eba401dbc86c38031", {"d08d1b24938b34a558972c6fe99f6153ef502f064b74d8ca890cdfb8eb4f953c": "6812247dc5740215154ace7e4ffe271914da445524492677d36bdb6ec1282142"}),
    (
        [(hashes.ZERO, 0), (A, 100), (B, 200), ("0d2beb91b9196929a5ddec9f6e306924ddf4a24268e3e59fd8464738d525af37", 300), ("adf8773496a9b7319b2e50dc98093f344053b17d8ad37100b9c07d9805988784", 400),
         ("4ac202caf347fc1e9c874b1ef6a1c5e619141eb775a6f43f0f0124ccd0060d9e", 500), ("b3b28636f65c149ea52eb1f94669466f70f033b54cea792824c696ba6ef3c389", 600), ("0e2c1a002aae913d2c0fc8ddfa4e9e14b7b311b3b0d458726d5d9f6a6318013c", 700)],
        "f62abe77e3fb9c954fe52b0028027ddc90c064c45951a4fd2211d87e5c0011db",
        {hashes.ZERO: "d1b068be5bbdb38992269e8efe61f601881e39f7a7585fd76883cc6ea5c23b44"},
    ),
]


def test_merkle_hashes_equal_known_values():
    assert merkle.roots([x[0] for x in GOLDEN]) == [x[1] for x in GOLDEN]
    for nodes, _, salted in GOLDEN:
        for salt, want in salted.items():
            assert merkle.file_hashes([nodes], blake3.from_hex(salt)) == [want]


def test_merkle_groups_are_two_to_nine_wide():
    rng = random.Random(1)
    for n in (2, 3, 10, 57, 500):
        ends = merkle.group_ends([rng.randbytes(32).hex() for _ in range(n)])
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and max(sizes) <= 9 and all(s > 2 for s in sizes[:-1])


def test_merkle_in_spark_equals_the_function(spark):
    rows = [(f, i, hashlib.sha256(bytes([f, i % 250])).hexdigest(), i) for f in range(3) for i in range(40 * f)]
    got = {r["file_id"]: r for r in merkle.merkle_hashes(spark.createDataFrame(rows, "file_id long, chunk_idx long, chunk_hash string, length long")).collect()}
    for f in (1, 2):
        assert got[f]["file_hash"] == merkle.file_hashes([[(h, n) for g, _, h, n in rows if g == f]])[0]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_byte_planes_round_trip(data):
    assert bytegroups.join_planes(bytegroups.split_planes(data)) == data


def test_hash_digits_and_bytes(spark):
    digits = hashlib.sha256(b"x").hexdigest()
    raw = blake3.from_hex(digits)
    df = spark.createDataFrame([(digits, raw)], "h string, r binary")
    row = df.select(hashes.to_raw("h").alias("raw"), hashes.from_raw("r").alias("hex"), hashes.from_base64(hashes.to_base64("h")).alias("again"), hashes.low_bits("h", 1024).alias("low"), hashes.truncated("h").alias("t")).first()
    assert (bytes(row["raw"]), row["hex"], row["again"], row["t"]) == (raw, digits, digits, digits[:16])
    assert row["low"] == int(digits[-16:], 16) % 1024


def test_chunks_do_not_depend_on_partitions(spark):
    rows = [(i, random.Random(i).randbytes(9000)) for i in range(20)] + [(99, b""), (100, None)]
    df = spark.createDataFrame(rows, "file_id long, data binary")
    spec = ChunkSpec(target=1024)
    a = chunks.content_chunks(df.repartition(1), spec).orderBy("file_id", "chunk_idx").collect()
    b = chunks.content_chunks(df.repartition(7), spec).orderBy("file_id", "chunk_idx").collect()
    assert a == b and {r["file_id"] for r in a} == set(range(20))
    assert sum(r["length"] for r in a) == 20 * 9000


def test_interval_pieces(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 20, 21), (2, 5, 5)], "k long, start long, end long")
    assert [tuple(r) for r in intervals.coalesced(df, ["k"]).orderBy("k", "start").collect()] == [(1, 0, 12, 2), (1, 20, 21, 1), (2, 5, 5, 1)]
    assert [tuple(r) for r in intervals.fixed_segments(df.where("k = 1 and start = 0"), 4).orderBy("start").collect()] == [(1, 0, 4), (1, 4, 8), (1, 8, 10)]
    binned = intervals.binned(df.where("start = 10"), "start", "end", 4).select(F.col("bin")).collect()
    assert [r["bin"] for r in binned] == [2]


def test_blocks_of_any_length_are_cut_like_the_whole(spark):
    spec = ChunkSpec(target=1024)
    rng = random.Random(4)
    files = {1: rng.randbytes(20_000), 2: rng.randbytes(20_000), 3: b"\x3b" * 9_000, 4: rng.randbytes(50), 5: rng.randbytes(6_000), 6: b"ab" * 2_000}
    widths = {1: [40], 2: [1], 3: [700], 4: [63], 5: [1, 62, 63, 64, 65, 200], 6: [3, 5000]}
    blocks = []
    for f, data in files.items():
        at = k = 0
        while at < len(data):
            w = widths[f][k % len(widths[f])]
            blocks.append((f, at, data[at : at + w]))
            at, k = at + w, k + 1
        blocks.append((f, len(data), b""))
    rng.shuffle(blocks)
    df = spark.createDataFrame(blocks, "file_id long, offset long, data binary")
    out = cuts_of_blocks(df, spec)
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r["file_id"], []).append(r["offset"] + r["length"])
    assert got == {f: cut_points(d, spec, default_gear()) for f, d in files.items()}
    # of the data no more than edges of blocks is shuffled
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan and "front" in plan
    with pytest.raises(Exception, match="don't follow"):
        cuts_of_blocks(df.where("not (file_id = 3 and offset = 1400)"), spec).collect()
    assert cuts_of_blocks(df.limit(0), spec).count() == 0


def test_blocks_that_lie_together_are_one_run():
    """Of 500 blocks of 40 bytes in one batch the edges of one run are given out, not those of each block."""
    spec, rng = ChunkSpec(target=1024), random.Random(5)
    files = {i: rng.randbytes(20_000) for i in (1, 2)}
    rows = [(f, at, d[at : at + 40]) for f, d in files.items() for at in range(0, len(d), 40)] + [(2, 20_000, b""), (3, 0, None)]
    rows = [r for r in rows if r[:2] != (2, 8_000)]  # a hole parts the second file's blocks
    rng.shuffle(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["file_id", "offset", "data"])
    got = [x for b in _own_places(spec)(iter([batch, batch.slice(0, 0)])) for x in b.to_pylist()]
    assert sorted((x["file_id"], x["offset"], x["size"]) for x in got) == [(1, 0, 20_000), (2, 0, 8_000), (2, 8_040, 11_960)]
    for x in got:
        data = files[x["file_id"]][x["offset"] : x["offset"] + x["size"]]
        assert (x["front"], x["tail"]) == (data[:63], data[-63:])
        assert x["allowed"] == [x["offset"] + int(at) for at in candidates(np.frombuffer(data, np.uint8), default_gear(), spec.mask) if at > 63]
    whole = np.frombuffer(files[1], np.uint8)
    assert all((_places(whole, default_gear(), spec.mask, n) == candidates(whole, default_gear(), spec.mask)).all() for n in (64, 999, 1 << 18))
