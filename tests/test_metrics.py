import random

import pytest

from tesserae.operators import metrics


def test_ewma_has_no_cut(spark):
    rng = random.Random(3)
    rows, at = [("a", 0, 100.0), ("a", 49, 0.0), ("b", 0, 1e300), ("b", 6 * 1000, 0.0), (None, 5, 2.0), (None, 11, None), ("n", 1, None)], 0
    for _ in range(300):
        at += rng.choice([0, 1, 1, 5, 40, 300, 20000])
        rows.append(("c", at, rng.uniform(0, 1000)))
    got = metrics.ewma_whole(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", "v", 6).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [(v, 2.0 ** ((t - r["t"]) / 12)) for k, t, v in rows if k == r["k"] and t <= r["t"] and v is not None]
        want = sum(v * w * w for v, w in past) / sum(w * w for _, w in past) if past else None
        assert r["ewma"] == (want and pytest.approx(want, rel=1e-9)), r
    assert {round(r["ewma"], 2) for r in got if r["k"] == "a"} == {100.0, 0.35}


def test_ewma_by_count_decays_by_weight(spark):
    rng = random.Random(4)
    rows = [("k", i, rng.uniform(0, 9), rng.choice([0.5, 1.0, 30.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w double")
    got = {r["i"]: r["ewma"] for r in metrics.ewma_by_count(df, "k", "i", "v", 4, df["w"]).collect()}
    weight = value = 0.0
    for _, i, v, w in rows:
        weight, value = weight * 2 ** (-w / 4) + w, value * 2 ** (-w / 4) + v
        assert got[i] == pytest.approx(value / weight, rel=1e-9)


def test_speeds_follow_the_tracker(spark):
    rng, rows, at, total = random.Random(5), [], 0, 0
    for i in range(60):
        at, total = at + rng.choice([1, 2, 30, 500]), max(0, total + rng.choice([-50, 0, 10, 400]))
        rows += [("k", at, total)] + [("k", at, total + 7)] * (i % 3 == 0)
    got = {r["t"]: (r["n"], r["rate"]) for r in metrics.speeds(spark.createDataFrame(rows, "k string, t long, v long"), "k", "t", "v", 8).collect()}
    weight = value = n = last = 0
    last_at = None
    for _, t, v in rows:
        if t == last_at:
            continue
        elapsed = 8 if last_at is None else t - last_at
        decay = 2 ** (-(t - (last_at or t)) / 8)
        weight, value = weight * decay + elapsed, value * decay + max(0, v - last)
        n, last, last_at = n + 1, v, t
        assert got[t] == (n, pytest.approx(value / weight, rel=1e-9) if n >= 4 else None)
    assert len(got) == n


def test_progress_is_credited_once(spark, tmp_path):
    from tesserae.streaming import ingest

    rng = random.Random(6)
    kinds = ["validating", "validating", "uploading", "syncing", "result", "error", None]
    # fixed cases: a stale frame; skipped validation; result alone; repeated syncing; frames after a milestone
    cases = {
        1: [("validating", 2, 5), ("validating", 1, 3)], 2: [("validating", 4, 10), ("uploading", None, None)], 3: [("result", None, None)],
        4: [("validating", 10, 10), ("syncing", None, None), ("syncing", None, None), ("uploading", None, None)], 5: [("syncing", None, None), ("validating", 3, 9), ("result", None, None)], 6: [("error", 1, 1)],
    }
    want = {1: ("validating", 5, 2, 0, 0), 2: ("uploading", 10, 10, 0, 0), 3: ("result", 0, 0, 1, 1), 4: ("syncing", 10, 10, 1, 0), 5: ("result", 0, 0, 1, 1), 6: ("validating", 0, 0, 0, 0)}
    for k in range(10, 60):
        cases[k] = [(rng.choice(kinds), rng.choice([None, rng.randrange(20)]), rng.choice([None, rng.randrange(30)])) for _ in range(rng.randrange(1, 8))]
    rows = [(k, i, *e) for k, es in cases.items() for i, e in enumerate(es)]
    schema = "shard_id long, seq long, stage string, verified long, total long"
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    got = {r[0]: tuple(r)[1:] for r in metrics.credited_progress(shuffled).collect()}
    assert {k: got[k] for k in want} == want and set(got) == set(cases)
    assert metrics.credited_progress(shuffled.limit(0)).count() == 0
    # as a stream, two events of each shard a batch
    src = f"file://{tmp_path}/events"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part] or rows[:0], schema).coalesce(1).write.mode("append").parquet(src)
    out = ingest.credited_progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    seen = {}

    def keep(batch, _):
        seen.update({r[0]: tuple(r)[1:] for r in batch.collect()})

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    assert seen == got


def test_regression_of_a_client_with_most_points(spark):
    rng = random.Random(11)
    # one client has three quarters of the points, others few; a null key is a client as well
    rows = [("hot", i, rng.uniform(0, 20), rng.uniform(0, 3)) for i in range(3000)] + [(k, i, float(i), rng.random()) for k in ("a", "b", None) for i in range(300)] + [("one", 1, 2.0, 3.0), ("same", 1, 2.0, 3.0), ("same", 2, 2.0, 4.0), ("same", 3, 2.0, None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, x double, y double")
    got = {r["k"]: r for r in metrics.ew_regression(df, "k", "i", 40, 10.0).collect()}
    for k in ("hot", "a", "b", None):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        w = [2.0 ** (-(len(mine) - 1 - n) / 40) for n in range(len(mine))]
        mx, my = (sum(v * r[c] for v, r in zip(w, mine)) / sum(w) for c in (1, 2))
        slope = sum(v * (x - mx) * (y - my) for v, (_, x, y) in zip(w, mine)) / sum(v * (x - mx) ** 2 for v, (_, x, _) in zip(w, mine))
        assert (got[k]["n"], got[k]["weight"], got[k]["slope"], got[k]["mean_at"]) == (len(mine), pytest.approx(sum(w)), pytest.approx(slope), pytest.approx(my + slope * (10 - mx)))
    assert got["one"]["slope"] is None and got["same"]["slope"] is None and got["same"]["n"] == 3 and len(got) == 6
    assert metrics.ew_regression(df.limit(0), "k", "i", 40, 10.0).count() == 0
    # the large client's points are folded in several tasks, none far above its share
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = [r["n"] for r in metrics.range_moments(df, "k", "i", 40).where("k = 'hot'").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(blocks) == 3000 and len(blocks) > 2 and max(blocks) < 2 * len(rows) / 4
