import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import sessions
from tesserae.streaming import flushes

ROWS = "session long, ts timestamp, container long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(flushes.PROVIDER_KEY, None)
    spark.conf.set(flushes.PROVIDER_KEY, flushes.PROVIDER)
    yield spark
    spark.conf.unset(flushes.PROVIDER_KEY) if before is None else spark.conf.set(flushes.PROVIDER_KEY, before)


def at(ms):
    return dt.datetime.fromtimestamp(1_700_000_000, dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def test_stream_and_batch_flush_alike_across_a_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("src", "out", "cp"))
    rows, now = [], 0
    for part in range(4):
        mine = []
        for _ in range(40):
            now += rng.choice([0, 100, 900, 4000])
            # most rows belong to one session; another one comes only at the start, so that a timer must end its window
            mine.append((rng.choice([1, 1, 1, 1, 2, 3]) if part else rng.choice([1, 9]), at(now), len(rows) + len(mine)))
        rows += mine
        odd = [(None, at(now), 1), (1, None, 2), (1, at(now), None)]
        spark.createDataFrame(rng.sample(mine + odd, len(mine) + 3), ROWS).coalesce(1).write.mode("append").parquet(src)
        if part in (1, 3):
            # the stream is stopped after two batches and started anew from its checkpoint
            stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
            q = flushes.flush_stream(stream, 20_000, 7, "1 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            assert q.awaitTermination(240) and q.exception() is None
    made = spark.createDataFrame(rows, ROWS).select("session", F.unix_millis("ts").alias("ts_ms"), "container")
    want = {}
    for r in sessions.flush_windows(made, 20_000, 7).collect():
        want.setdefault((r["session"], r["flush"]), []).append((r["ts_ms"], r["container"]))
    newest = max(t for w in want.values() for t, _ in w)
    got = {(r["session"], r["flush"]): r for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count()
    last = {s: max(f for t, f in want if t == s) for s, _ in want}
    for (s, f), w in want.items():
        w.sort()
        closed = len(w) == 7 or f < last[s] or w[0][0] + 20_000 <= newest - 1000
        assert ((s, f) in got) == closed, (s, f)
        if closed:
            r = got[s, f]
            assert (r["begin_ms"], r["n"], list(r["containers"])) == (w[0][0], len(w), [c for _, c in w])
            assert r["closed_by"] == ("count" if len(w) == 7 else "interval")
    assert set(got) <= set(want) and {r["closed_by"] for r in got.values()} == {"count", "interval"}
    assert (9, last[9]) in got
