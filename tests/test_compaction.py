import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import compaction
from tesserae.plans.shard_store import RELATIONS, ShardStore

V, M = 1 << 31, 1 << 30


def made(seed, n=40):
    """Shards with files and containers that many of them share, as lists of rows by relation."""
    rng = random.Random(seed)
    segments = {f"f{i}": rng.randrange(0, 6) for i in range(30)}
    chunks = {f"c{i}": rng.randrange(1, 9) for i in range(12)}
    out = {name: [] for name in RELATIONS}
    for s in range(n):
        out["shards"].append((s, rng.randrange(60), 1000 + rng.randrange(9)))
        if s == 7:
            continue  # a shard without rows
        for f in rng.sample(sorted(segments), rng.randrange(1, 9)):
            out["shard_files"].append((s, f, rng.choice([0, V, M, V | M]), segments[f]))
            out["shard_segments"] += [(s, f, k, "c0", k, k + 1, 10 + s) for k in range(segments[f])]
        for c in rng.sample(sorted(chunks), rng.randrange(0, 4)):
            out["shard_containers"].append((s, c, chunks[c]))
            out["shard_chunks"] += [(s, c, k, f"{c}.{k}", 5) for k in range(chunks[c])]
    return out


def frames(spark, rows, keep=lambda s: True):
    return {n: spark.createDataFrame([r for r in rows[n] if keep(r[0])], RELATIONS[n]) for n in RELATIONS}


def plain(rows, target, overhead, span):
    """shard -> (place's group, own size, merged size), and the groups' members in order, by sets of parts."""
    of = {s: {} for s, *_ in rows["shards"]}
    for s, f, flags, n in rows["shard_files"]:
        of[s] |= {("f", f): 48 * (1 + n) + 12} | ({("v", f): 48 * n} if flags & V else {}) | ({("m", f): 48} if flags & M else {})
    for s, c, n in rows["shard_containers"]:
        of[s][("c", c)] = 48 * (1 + n) + 12 + 16 * n
    size = lambda parts: overhead + sum(parts.values())
    groups, held, last = [], {}, None
    for s, created, _ in sorted(rows["shards"], key=lambda r: (r[1] // span, r[1], r[0])):
        if last != created // span or size(held) + size(of[s]) - overhead > target:
            groups.append([])
            held = {}
        last, held = created // span, held | of[s]
        groups[-1].append(s)
    merged = {s: size({k: v for m in g for k, v in of[m].items()}) for g in groups for s in g}
    return groups, {s: (size(of[s]), merged[s]) for s in of}


@pytest.mark.parametrize("seed,target,span", [(1, 3000, 20), (2, 6000, 60), (3, 10, 60), (4, 10**9, 1000)])
def test_groups_by_the_size_of_unions(spark, seed, target, span):
    rows = made(seed)
    df = frames(spark, rows)
    shards = df["shards"].withColumn("kind", F.lit("a"))
    plan = compaction.merge_plan(shards, compaction.parts(df["shard_files"], df["shard_containers"]), "kind", target, 248, span).collect()
    groups, sizes = plain(rows, target, 248, span)
    assert {r["shard_id"]: (r["size"], r["merged_size"]) for r in plan} == sizes
    got = {}
    for r in sorted(plan, key=lambda r: r["place"]):
        got.setdefault((r["stretch"], r["merge_group"]), []).append(r["shard_id"])
    assert sorted(got.values()) == sorted(groups)


def test_parts_of_repeated_and_null_rows(spark):
    files = spark.createDataFrame([(1, "a", V, 2), (1, "a", 0, 2), (1, None, V, 2), (2, "a", M, 2)], RELATIONS["shard_files"])
    none = spark.createDataFrame([(1, None, 3)], RELATIONS["shard_containers"])
    assert sorted((r["shard_id"], r["part"]["kind"], r["bytes"]) for r in compaction.parts(files, none).collect()) == [(1, "file", 156), (1, "verification", 96), (2, "file", 156), (2, "metadata", 48)]
    shards = spark.createDataFrame([], "kind string, shard_id long, created long")
    assert compaction.merge_plan(shards, compaction.parts(files, none), "kind", 9, 1, 5).count() == 0


def test_records_come_from_the_first_shard_that_has_them(spark):
    files = spark.createDataFrame([(5, "a", 0, 1), (3, "a", V, 1), (4, "a", V | M, 1)], RELATIONS["shard_files"])
    to = spark.createDataFrame([(5, 1, 3), (4, 2, 3), (3, 3, 3)], "shard_id long, place int, into long")
    assert [tuple(r) for r in compaction.merged_files(files, to).collect()] == [(3, "a", V | M, 1, 5, 4, 4)]


def seen(store):
    return {n: sorted(map(tuple, store.read(n).collect())) for n in RELATIONS}


def test_a_compaction_is_seen_as_a_whole(spark, tmp_path):
    rows = made(6)
    store = ShardStore(spark, str(tmp_path))
    first = store.add(frames(spark, rows, lambda s: s < 15))
    store.add(frames(spark, rows, lambda s: s >= 15))
    before = seen(store)
    assert before == {n: sorted(rows[n]) for n in RELATIONS}
    # a run that dies before the swap changes nothing, and can be repeated
    store._staged("died", 6000, 60)
    assert seen(store) == before and store.sweep() == []
    report = {r["shard_id"]: r for r in store.compact(6000, 60).collect()}
    groups, sizes = plain(rows, 6000, 248, 60)
    into = {s: min(g) for g in groups for s in g}
    assert {s: r["into"] for s, r in report.items()} == into and any(len(g) > 1 for g in groups)
    after = seen(store)
    newest, soonest = ({i: f(r[at] for r in rows["shards"] if into[r[0]] == i) for i in set(into.values())} for f, at in ((max, 1), (min, 2)))
    assert after["shards"] == sorted((i, newest[i], soonest[i]) for i in newest)
    place = {s: k for k, s in enumerate(s for g in groups for s in g)}

    def union(name, key):
        owner = {}
        for r in rows[key]:
            at = (into[r[0]], r[1])
            owner[at] = min(owner.get(at, r[0]), r[0], key=place.get)
        return owner

    files, containers = union("shard_segments", "shard_files"), union("shard_chunks", "shard_containers")
    assert {(r[0], r[1]) for r in after["shard_files"]} == set(files) and {(r[0], r[1]) for r in after["shard_containers"]} == set(containers)
    assert after["shard_segments"] == sorted((into[r[0]], *r[1:]) for r in rows["shard_segments"] if files[into[r[0]], r[1]] == r[0])
    assert after["shard_chunks"] == sorted((into[r[0]], *r[1:]) for r in rows["shard_chunks"] if containers[into[r[0]], r[2 - 1]] == r[0])
    # the sizes told are those of the relations written
    parts = compaction.parts(store.read("shard_files"), store.read("shard_containers")).groupBy("shard_id").agg(F.sum("bytes").alias("n")).collect()
    assert {r["shard_id"]: r["n"] + 248 for r in parts} == {i: sizes[i][1] for i in newest if sizes[i][1] > 248}
    # folders go only where nothing is left of them
    dead = store.sweep()
    assert seen(store) == after and all(not (tmp_path / n / f"batch={b}").exists() for n in RELATIONS for b in dead)
    assert (first in dead) == all(len(next(g for g in groups if s in g)) > 1 for s in range(15))
    # once more nothing is merged that was merged up to the target
    assert {r["state"] for r in store.compact(10, 60).collect()} == {"skipped"} and seen(store) == after


def test_shards_need_all_relations(spark, tmp_path):
    with pytest.raises(ValueError, match="shard_chunks"):
        ShardStore(spark, str(tmp_path)).add({n: df for n, df in frames(spark, made(1, 2)).items() if n != "shard_chunks"})
    assert ShardStore(spark, str(tmp_path)).read("shard_files").count() == 0
