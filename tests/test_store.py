import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import blake3, digests
from tesserae.functions.chunking import ChunkSpec, cut_points, default_gear
from tesserae.operators import edits, lookup, payloads, sessions
from tesserae.plans.engine import Engine
from tesserae.sources import store
from tesserae.streaming import ingest

SPEC = ChunkSpec(target=1024)


def bodies(n=12):
    shared = random.Random(0).randbytes(20_000)
    return [(i, shared[: 1000 * i] + random.Random(i).randbytes(3000 + i) + shared[5000:]) for i in range(n)] + [(n, b"")]


def test_engine_stores_and_rebuilds(spark, tmp_path):
    files = bodies()
    df = spark.createDataFrame(files, "file_id long, data binary")
    engine = Engine(spark, f"file://{tmp_path}/store", SPEC, max_bytes=5120, max_chunks=8, group_files=4)
    dry = {r["file_id"]: r.asDict() for r in engine.ingest(df, dry_run=True).collect()}
    made = {r["file_id"]: r.asDict() for r in engine.ingest(df).collect()}
    assert dry == made and sum(r["deduped_bytes"] for r in made.values()) > 0
    rng = random.Random(1)
    asks, want = [], {}
    for q in range(60):
        f, data = files[rng.randrange(12)]
        a = rng.randrange(len(data))
        b = rng.choice([None, a + 1 + rng.randrange(9000)])
        asks.append((q, f, a, b))
        want[q] = data[a:b]
    got = {r["query_id"]: bytes(r["data"]) for r in engine.reconstruct(spark.createDataFrame(asks, "query_id long, file_id long, start long, end long")).collect()}
    assert got == want
    past = spark.createDataFrame([(0, 1, 10**6, None), (1, 12, 0, None)], "query_id long, file_id long, start long, end long")
    assert engine.reconstruct(past).count() == 0
    # what is stored already adds nothing
    again = engine.ingest(df.withColumn("file_id", F.col("file_id") + 100), dry_run=True)
    assert again.agg(F.sum("new_bytes")).first()[0] == 0
    total = engine.totals().first()
    assert total["n_files"] == 12 and total["stored_bytes"] == sum(r["new_bytes"] for r in made.values())
    limits = engine._stored("containers").agg(F.max("bytes_raw"), F.max("n_chunks")).first()
    assert limits[0] <= 5120 and limits[1] <= 8
    spliced = engine.splice(spark.createDataFrame([(3, 10, 20, b"new"), (3, 4000, 4000, b"inserted")], "file_id long, start long, end long, data binary")).first()
    old = files[3][1]
    assert bytes(spliced["data"]) == old[:10] + b"new" + old[20:4000] + b"inserted" + old[4000:]


def test_engine_reads_committed_batches_only(spark, tmp_path):
    files = bodies(6)
    df = spark.createDataFrame(files, "file_id long, data binary")
    path = f"file://{tmp_path}/store"
    first = Engine(spark, path, SPEC, max_bytes=5120, max_chunks=8, group_files=4)
    lazy = first.ingest(df.where("file_id < 3"))
    # a batch that dies after its payload and its segments, and is repeated
    dying = Engine(spark, path, SPEC, max_bytes=5120, max_chunks=8, group_files=4)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tesserae.operators.merkle.merkle_hashes", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dying.ingest(df.where("file_id >= 3"))
    assert first.totals().first()["n_files"] == 3
    dying.ingest(df.where("file_id >= 3"))
    assert lazy.count() == 3  # figures of an earlier batch can still be read
    # a second writer that knows of nothing stores the same chunks again
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Engine, "_stored", lambda self, name, old=Engine._stored: old(self, name).where("false"))
        first.ingest(df.withColumn("file_id", F.col("file_id") + 100))
    whole = first._stored("files").select(F.col("file_id").alias("query_id"), "file_id", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    got = {r["query_id"]: bytes(r["data"]) for r in first.reconstruct(whole).collect()}
    assert got == {i + k: d for i, d in files for k in (0, 100) if d}
    pieces = sorted((r["query_id"], r["piece_idx"], r["offset"], bytes(r["data"])) for r in first.read_pieces(whole.where("file_id = 2")).collect())
    assert b"".join(p[3] for p in pieces) == files[2][1] and [p[2] for p in pieces] == [sum(len(q[3]) for q in pieces[:i]) for i in range(len(pieces))]


def test_keyed_hashes_of_columns(spark):
    key = "ab" * 32
    df = spark.createDataFrame([(b"x" * n,) for n in (0, 5, 3000)], "d binary").withColumn("h", digests.data_hash("d"))
    for r in df.withColumn("k", digests.keyed("h", key)).withColumn("z", digests.keyed("h", "0" * 64)).collect():
        assert r["h"] == blake3.to_hex(blake3.keyed_hashes([bytes(r["d"])], blake3.DATA_KEY)[0])
        assert r["k"] == blake3.to_hex(blake3.keyed_hashes([blake3.from_hex(r["h"])], blake3.from_hex(key))[0]) and r["z"] == r["h"]


def test_payload_errors_and_schemes(spark):
    rng = random.Random(2)
    for scheme in (payloads.NONE, payloads.LZ4, payloads.PLANES):
        for data in (b"", b"abc", b"z" * 5000, rng.randbytes(999)):
            blob = payloads._encode(data, scheme)
            (kept, _, back), = payloads._decode(blob)
            assert back == data and (kept == payloads.NONE or len(blob) - 8 < len(data))
    with pytest.raises(ValueError, match="cut off"):
        list(payloads._decode(payloads._encode(b"abc", 0) + b"\0\0"))
    df = spark.createDataFrame([("c", 1, b"two"), ("c", 0, b"one" * 90)], "container_hash string, chunk_idx long, data binary")
    assert [bytes(r["data"]) for r in payloads.decode_containers(payloads.encode_containers(df)).orderBy("chunk_idx").collect()] == [b"one" * 90, b"two"]


def runs_as_rows(runs):
    return [(t, a + k if t else -1, 10) for t, a, n in runs for k in range(n)]


def decisions(runs, **how):
    closed, _ = sessions.cited_ranges(runs_as_rows(runs), sessions.START, last=True, **how)
    return [(r[5], r[3] - r[2]) for r in closed]


def test_short_runs_are_rejected_only_when_the_window_is_full():
    twos = [(f"t{k}", 0, 2) for k in range(4)]
    how = dict(window=4, limit=8, low=0.5)
    assert decisions(twos + [("x", 0, 1)], **how) == [("known", 2)] * 4 + [("prevented", 1)]
    # a run of the mean length passes; a longer one too
    assert decisions(twos + [("x", 0, 2), ("y", 5, 3)], **how) == [("known", 2)] * 5 + [("known", 3)]
    assert decisions(twos[:3] + [("x", 0, 1)], **how) == [("known", 2)] * 3 + [("known", 1)]
    # after a rejection the bar is the limit itself: mean (2 + 2 + 1 + 15) / 4 = 5 is under 8, though over 4
    assert decisions(twos + [("x", 0, 1), ("y", 0, 15), ("z", 0, 3)], **how)[-2:] == [("known", 15), ("prevented", 3)]
    # once the mean has reached the limit the bar is low again: mean 22 / 4 = 5.5 is over 4
    again = decisions(twos + [("x", 0, 1)] + [(f"y{k}", 0, 10) for k in range(4)] + [("a", 0, 9), ("b", 0, 1), ("c", 0, 1), ("d", 0, 1)], **how)
    assert again[4:] == [("prevented", 1)] + [("known", 10)] * 4 + [("known", 9)] + [("known", 1)] * 3
    # a run that goes on where the last range ended joins it, however short
    assert decisions(twos + [("t3", 2, 1)], **how) == [("known", 2)] * 3 + [("known", 3)]


def test_ranges_do_not_depend_on_where_the_rows_are_cut():
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(6), 1 + rng.randrange(9)) for _ in range(400)]
    rows = [(t, a if t else -1, n) for t, a, n in rows]
    whole, _ = sessions.cited_ranges(rows, sessions.START, 8, 3.0, 0.5, True)
    for _ in range(5):
        state, parts, at = sessions.START, [], 0
        while at < len(rows):
            stop = at + 1 + rng.randrange(50)
            closed, state = sessions.cited_ranges(rows[at:stop], state, 8, 3.0, 0.5, stop >= len(rows))
            parts, at = parts + closed, stop
        assert parts == whole and state == sessions.START
    assert sum(r[4] for r in whole) == sum(n for _, _, n in rows)


def test_greedy_segments_add_up(spark):
    chunks = [(f, i, f"h{(f * 7 + i) % 40}", 10) for f in range(6) for i in range(30)]
    df = spark.createDataFrame(chunks, "file_id long, chunk_idx long, chunk_hash string, length long")
    index = spark.createDataFrame([(f"h{k}", "t", k) for k in range(0, 35)], "chunk_hash string, target string, target_idx long")
    out = sessions.greedy_segments(df, index, window=2, limit=4.0).collect()
    for f in range(6):
        own = [r for r in out if r["file_id"] == f]
        assert sum(r["bytes"] for r in own) == 300 and sum(r["chunk_end"] - r["chunk_start"] for r in own) == 30
    known = [r for r in out if r["file_id"] == 0]
    assert [(r["target"], r["chunk_start"], r["chunk_end"]) for r in known] == [("t", 0, 30)]


def test_leftovers_close_the_larger(spark):
    df = spark.createDataFrame([(0, 1, 60, 1), (0, 2, 30, 1), (0, 3, 50, 1), (0, 4, 70, 1)], "g long, file_id long, bytes long, chunks long")
    got = {r["file_id"]: r["container"] for r in sessions.merged_leftovers(df, "g", 100, 8).collect()}
    # 1 and 2 fit (90); 3 doesn't: 90 is closed, 50 stays; 4 doesn't: 70 is closed, 50 stays
    assert got == {1: 0, 2: 0, 4: 1, 3: 2}


def plain_chain_size(ranges, terms):
    """Every chain of terms and bridges is walked; None if none comes to the end."""
    ends = {a[1]: b[0] for a, b in zip(ranges, ranges[1:]) if a[1] < b[0]}
    found, todo = {}, [(ranges[0][0], 0)]
    while todo:
        at, size = todo.pop()
        if found.setdefault(at, size) == size:
            todo += [(e, size + n) for s, e, n in terms if s == at and e not in found]
            todo += [(ends[at], size)] if at in ends and ends[at] not in found else []
    return found.get(ranges[-1][1])


def test_chain_sizes_follow_the_rule(spark):
    # ranges, terms -> size
    cases = [
        ([(0, 5)], [(0, 5, 1000)], 1000), ([(0, 6)], [(0, 2, 200), (4, 6, 500)], None), ([(0, 5)], [(1, 5, 800)], None), ([(0, 5)], [(0, 3, 600)], None), ([(0, 5)], [], None),
        ([(0, 5)], [(0, 3, 600), (1, 4, 700), (3, 5, 400)], 1000), ([(3, 8)], [(3, 8, 1000)], 1000), ([(0, 8)], [(0, 5, 50), (3, 5, 20), (5, 8, 30)], 80), ([(0, 8)], [(0, 3, 30), (6, 8, 20)], None),
        ([(0, 3), (5, 8)], [(0, 3, 300), (5, 8, 400)], 700), ([(0, 3), (5, 8)], [(0, 3, 300)], None), ([(0, 3), (5, 8)], [(5, 8, 400)], None), ([(0, 3), (5, 8), (9, 10)], [(0, 3, 1), (5, 8, 1), (9, 10, 1), (5, 7, 1)], 3),
    ]
    rng = random.Random(9)
    for _ in range(60):
        sizes = [rng.randrange(1, 9) for _ in range(12)]
        cuts = sorted(rng.sample(range(13), 4))
        ranges = [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if rng.random() < 0.6 else [(cuts[0], cuts[3])]
        terms = [(a, b, sum(sizes[a:b])) for r in ranges for a in range(*r) for b in range(a + 1, r[1] + 1) if rng.random() < 0.3]
        cases.append((ranges, terms, plain_chain_size(ranges, terms)))
    ranges = spark.createDataFrame([(i, *r) for i, c in enumerate(cases) for r in c[0]], "block long, start long, end long")
    terms = spark.createDataFrame([(i, *t) for i, c in enumerate(cases) for t in c[1] * 2], "block long, start long, end long, size long")
    assert {r["block"]: r["size"] for r in sessions.chain_size(ranges, terms).collect()} == {i: c[2] for i, c in enumerate(cases)}
    assert sessions.chain_size(ranges.limit(0), terms).count() == 0


def test_edit_assignment(spark):
    windows = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "file_id long, start long, end long")
    asks = spark.createDataFrame([(1, 2, 5), (1, 10, 10), (1, 20, 20)], "file_id long, start long, end long")
    sizes = spark.createDataFrame([(1, 20)], "file_id long, size long")
    assert sorted((r["start"], r["window_start"]) for r in edits.assigned(asks, windows, sizes).collect()) == [(2, 0), (10, 10), (20, 10)]


def test_edit_windows_end_after_two_stable_chunks(spark):
    lengths = [50, 900, 200, 900, 300, 300, 300]
    rows = [(1, i, sum(lengths[:i]), n) for i, n in enumerate(lengths)]
    chunks = spark.createDataFrame(rows, "file_id long, chunk_idx long, byte_start long, length long")
    asks = spark.createDataFrame([(1, 60, 70)], "file_id long, start long, end long")
    assert [(r["start_chunk"], r["end_chunk"]) for r in sessions.edit_windows(chunks, asks, 100, 600).collect()] == [(1, 6)]


def test_columns_of_ranges_names_and_offsets(spark):
    df = spark.createDataFrame([("bytes=3-9", "/x/" + "a" * 64 + ".mdb", [0, 4, 9]), ("5-", "x.mdb", [0, 4, 4]), ("9-3", "b" * 64 + ".mdb", [1, 2])], "r string, p string, o array<long>")
    rows = df.select(digests.parsed_range("r").alias("r"), digests.shard_name("p").alias("p"), digests.strictly_increasing("o").alias("ok"), digests.rebased(F.col("o"), F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("b")).collect()
    assert [r["r"] and tuple(r["r"]) for r in rows] == [(3, 10), (5, None), None]
    assert [r["p"] for r in rows] == ["a" * 64, None, "b" * 64] and [r["ok"] for r in rows] == [True, False, False] and rows[0]["b"] == [0, 4, 9, 11]


def test_relations_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i:064x}", i) for i in range(50)], store.SCHEMAS["files"])
    store.write(df, f"file://{tmp_path}", "files")
    assert store.read(spark, f"file://{tmp_path}", "files").count() == 50
    (tmp_path / "s").mkdir()
    for name in ("c" * 64 + ".mdb", "other.txt"):
        (tmp_path / "s" / name).write_bytes(b"123")
    assert [(r["shard_hash"], r["size"]) for r in store.shard_files(spark, f"file://{tmp_path}/s").collect()] == [("c" * 64, 3)]
    assert store.files(spark, f"file://{tmp_path}/s", glob="*.txt").count() == 1
    assert [r["v"] for r in store.first_of_each(spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 5)], "k string, p long, v long"), "k", "p").orderBy("k").collect()] == [10, 5]


def test_stream_of_blocks_gives_the_batch_chunks(spark, tmp_path):
    files = [(i, random.Random(i).randbytes(9000 + 700 * i)) for i in range(4)]
    gear = default_gear()
    want = set()
    for f, data in files:
        cuts = cut_points(data, SPEC, gear)
        want |= {(f, i, a, b - a, hashlib.sha256(data[a:b]).hexdigest()) for i, (a, b) in enumerate(zip([0, *cuts], cuts))}
    src = tmp_path / "in"
    for batch in range(4):
        rows = []
        for f, data in files:
            step = 517 + 100 * f
            blocks = [data[i : i + step] for i in range(0, len(data), step)]
            share = -(-len(blocks) // 4)
            rows += [(f, k, blocks[k], k == len(blocks) - 1) for k in range(batch * share, min(len(blocks), (batch + 1) * share))]
        spark.createDataFrame(rows, "file_id long, block_seq long, data binary, is_last boolean").coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = spark.readStream.schema("file_id long, block_seq long, data binary, is_last boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = ingest.chunk_blocks(stream, SPEC).writeStream.format("memory").queryName("cut").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert {tuple(r) for r in spark.table("cut").collect()} == want


def test_stream_index_and_progress(spark, tmp_path):
    src, index = f"file://{tmp_path}/chunks", f"file://{tmp_path}/index"
    schema = "file_id long, chunk_idx long, chunk_hash string, length long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ingest.index_new_chunks(stream, index, f"file://{tmp_path}/cp2").awaitTermination(240)
        return spark.read.parquet(index).where("batch >= 0")

    spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "a", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r["chunk_hash"] for r in run().collect()) == ["a", "b"]
    spark.createDataFrame([(2, 0, "b", 1), (2, 1, "c", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted((r["chunk_hash"], r["file_id"]) for r in run().collect()) == [("a", 1), ("b", 1), ("c", 2)]
    events = spark.createDataFrame([(1, "result", 9), (1, "validating", 3), (2, "odd", None), (2, "validating", 4)], "upload_id long, stage string, verified long")
    assert sorted(map(tuple, ingest.progress(events).collect())) == [(1, "result", 9, 2), (2, "validating", 4, 2)]


def test_stream_of_ranges_gives_the_batch_ranges(spark, tmp_path):
    rng = random.Random(5)
    chunks = [(f, i, rng.choice([None, "a", "b"]), rng.randrange(4), 1 + rng.randrange(9)) for f in range(3) for i in range(90)]
    chunks = [(f, i, t, a if t else None, n, i == 89) for f, i, t, a, n in chunks]
    schema = "file_id long, chunk_idx long, target string, target_idx long, length long, is_last boolean"
    src = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([c for c in chunks if c[1] // 30 == k], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.cite_stream(stream, 4, 3.0).writeStream.format("memory").queryName("cited").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = set()
    for f in range(3):
        closed, _ = sessions.cited_ranges([(t, -1 if a is None else a, n) for g, _, t, a, n, _ in chunks if g == f], sessions.START, 4, 3.0, 0.5, True)
        want |= {(f, *r) for r in closed}
    assert {tuple(r) for r in spark.table("cited").collect()} == want


def test_stream_learns_from_the_shared_index(spark, tmp_path):
    schema = "file_id long, chunk_idx long, chunk_hash string, length long"
    rows = spark.createDataFrame([("a", 1)], "chunk_hash string, shard_id long")
    shard = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "shard_id long, chunk_hash string")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/chunks")
        ingest.two_pass_stream(stream, f"file://{tmp_path}/index", f"file://{tmp_path}/found", rows, shard, F.lit(False), f"file://{tmp_path}/cp").awaitTermination(240)
        return sorted(((r["file_id"], r["chunk_hash"], r["pass"]) for r in spark.read.parquet(f"file://{tmp_path}/found").collect()), key=lambda r: r[:2])

    spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/chunks")
    first = [(1, "a", 2), (1, "b", 2), (1, "c", None)]
    assert run() == first
    spark.createDataFrame([(2, 0, "b", 1), (2, 1, "c", 1), (2, 2, "d", 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/chunks")
    assert run() == sorted(first + [(2, "b", 1), (2, "c", 1), (2, "d", None)], key=lambda r: r[:2])


def test_own_tables_are_cleaned_up(spark):
    import os

    from tesserae.sources import shared

    kept, shared._MADE[:] = list(shared._MADE), []
    df = shared.written(spark.range(5), "five")
    path = shared._MADE[0].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    assert shared.clean_up(spark) == 1 and not os.path.exists(path) and shared.clean_up(spark) == 0
    shared._MADE[:] = kept


def test_lookup_reads_only_the_ranges_it_hits(spark, tmp_path):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    path = f"file://{tmp_path}/index"
    lookup.write_index(spark.createDataFrame([(h, i) for i, h in enumerate(hashes)], "chunk_hash string, at long"), path)
    lookup.write_index(spark.createDataFrame([(hashes[7], 3)], "chunk_hash string, at long"), path)
    index = lookup.read_index(spark, path, "chunk_hash string, at long")
    asked = spark.createDataFrame([(hashes[7],), (hashes[7],), (hashes[99],), ("f" * 64,), (None,)], "chunk_hash string")
    assert {tuple(r) for r in lookup.lookup(asked, index).collect()} == {(hashes[7], 3), (hashes[99], 99)}
    read = lookup.hit(index, asked).select(F.input_file_name()).distinct().count()
    every = index.select(F.input_file_name()).distinct().count()
    assert read <= 8 and every > 200
    plan = lookup.lookup(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan
    assert lookup.lookup(asked.limit(0), index).count() == 0 and lookup.lookup(asked, index.where("false")).count() == 0


def test_lookup_verifies_whole_hashes_and_refuses_crowds(spark, tmp_path):
    hashes = ["ab" + f"{i:062x}" for i in range(12)]
    path = f"file://{tmp_path}/index"
    lookup.write_index(spark.createDataFrame([(h, i) for i, h in enumerate(hashes)], "chunk_hash string, at long"), path)
    index = lookup.read_index(spark, path, "chunk_hash string, at long")
    asked = spark.createDataFrame([(hashes[5],), ("ab" + "9" * 62,)], "chunk_hash string")
    # all twelve begin alike
    with pytest.raises(Exception, match="too many hashes"):
        lookup.lookup(asked, index, truncate=16).collect()
    few = index.where("at < 7")
    assert [tuple(r) for r in lookup.lookup(asked, few, truncate=16).collect()] == [(hashes[5], 5)]
    assert [tuple(r) for r in lookup.lookup(asked, index, truncate=64).collect()] == [(hashes[5], 5)]


def test_a_batch_keeps_of_the_index_only_what_it_asked_for(spark, tmp_path):
    files = bodies(8)
    df = spark.createDataFrame(files, "file_id long, data binary")
    engine = Engine(spark, f"file://{tmp_path}/store", SPEC, max_bytes=5120, max_chunks=8, group_files=4, index_digits=1)
    engine.ingest(df)
    stored = engine._stored("chunk_index").count()
    engine.ingest(spark.createDataFrame([(50, files[3][1][:4000])], "file_id long, data binary"))
    kept = spark.read.parquet(*[f"file://{p}" for p in (tmp_path / "store" / "staging").glob("*/known")]).count()
    assert stored > 20 and kept < 8
    whole = spark.createDataFrame([(1, 50, 0, None)], "query_id long, file_id long, start long, end long")
    assert bytes(engine.reconstruct(whole).first()["data"]) == files[3][1][:4000]


def test_splice_of_stored_files_reads_windows_only(spark, tmp_path):
    rng = random.Random(8)
    files = {i: rng.randbytes(60_000) for i in range(4)} | {4: b"", 5: rng.randbytes(300)}
    engine = Engine(spark, f"file://{tmp_path}/store", SPEC, max_bytes=5120, max_chunks=8, group_files=4, index_digits=1)
    engine.ingest(spark.createDataFrame(list(files.items()), "file_id long, data binary"))
    long = rng.randbytes(4_000)
    asked = {
        0: [(30_000, 30_010, b"new")],
        1: [(0, 0, b"at the start"), (25_000, 40_000, b""), (60_000, 60_000, b"at the end")],
        2: [(100, 200, long), (200, 200, b"touching"), (59_990, 60_000, b"")],
        3: [(0, 60_000, b"all of it")],
        5: [(0, 300, b"")],
    }
    rows = [(f, a, b, d, f + 100) for f, es in asked.items() for a, b, d in es]
    schema = "file_id long, start long, end long, data binary, new_id long"
    done = {r["new_id"]: r for r in engine.splice_stored(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for f, es in asked.items():
        out, at = b"", 0
        for a, b, d in es:
            out, at = out + files[f][at:a] + d, b
        want[f + 100] = out + files[f][at:]
    whole = spark.createDataFrame([(f, f, 0, None) for f in want], "query_id long, file_id long, start long, end long")
    got = {r["query_id"]: bytes(r["data"]) for r in engine.reconstruct(whole).collect()}
    assert got == {f: d for f, d in want.items() if d}
    # chunks, and so hashes, are those of the whole files after the edits
    fresh = {r["file_id"]: r["file_hash"] for r in engine.hash_files(spark.createDataFrame(list(want.items()), "file_id long, data binary")).collect()}
    stored = {r["file_id"]: (r["file_hash"], r["size"]) for r in engine._stored("files").where("file_id >= 100").collect()}
    assert stored == {f: (fresh[f], len(d)) for f, d in want.items() if d}
    # what is read and cut is in proportion to the edits
    assert done[100]["bytes_read"] < 12_000 and done[101]["bytes_read"] < 30_000 and done[103]["bytes_read"] == 0
    assert {f: r["size"] for f, r in done.items()} == {f: len(d) for f, d in want.items()}
    for wrong in ([(0, 5, 9, b"", 200), (0, 8, 10, b"", 200)], [(0, 59_999, 60_001, b"", 200)], [(77, 0, 0, b"x", 200)]):
        with pytest.raises(ValueError):
            engine.splice_stored(spark.createDataFrame(wrong, schema))


def test_csv_and_json_lines_round_trip(spark, tmp_path):
    rows = [(1, "a, \"b\"\nc", 0.1, None), (2, None, 1e300, 5), (3, "é", -0.0, 7)]
    df = spark.createDataFrame(rows, "id long, name string, rate double, n long")
    store.write_csv(df.select("id", "rate", "n"), f"file://{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.schema("id long, rate double, n long").option("header", "true").csv(f"file://{tmp_path}/csv").collect())) == [(i, r, n) for i, _, r, n in rows]
    documents = store.as_documents(df.withColumn("k", F.col("id")), "k")
    assert '"n":null' in documents.where("k = 1").first()["document"]
    documents.select("document").write.text(f"file://{tmp_path}/json")
    (tmp_path / "json" / "more.txt").write_text("not a document\n{\"id\": 9}\n")
    got = store.json_lines(spark, f"file://{tmp_path}/json", df.schema).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([*rows, (9, None, None, None), (None, None, None, None)], key=repr)
