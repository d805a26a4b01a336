"""Time series of transfers: resampling, weighted averages, regression, progress, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(samples: DataFrame, step_ms: int) -> DataFrame:
    """samples(client_id, ts_ms, value) on a regular grid: client_id, grid_ms, value as of the grid time, active.

    Each sample holds from the first grid time at or after it up to the next
    sample's; so the grid is made from pairs of neighbours and there is no range
    join. After a client's last sample its value stays and active is false; the
    grid of all clients ends with the last sample of any.
    """
    last = samples.groupBy("client_id", "ts_ms").agg(F.max("value").alias("value"))
    ends = last.agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    w = Window.partitionBy("client_id").orderBy("ts_ms")
    j = last.withColumn("next_ms", F.lead("ts_ms").over(w)).crossJoin(F.broadcast(ends))  # one row
    first = F.ceil((F.col("ts_ms") - F.col("t0")) / step_ms)
    stop = F.coalesce(F.ceil((F.col("next_ms") - F.col("t0")) / step_ms), F.floor((F.col("t1") - F.col("t0")) / step_ms) + 1)
    grid = j.withColumn("first", first).withColumn("stop", stop).where("first < stop").withColumn("g", F.explode(F.sequence("first", F.col("stop") - 1)))
    at = F.col("t0") + F.col("g") * step_ms
    return grid.select("client_id", at.alias("grid_ms"), "value", (F.col("next_ms").isNotNull() | (at <= F.col("ts_ms"))).alias("active"))


#: Half-lives in a block, and blocks to look back on: what is older is below the least double, however large the values.
SPAN, REACH = 16, 134


def ewma_whole(samples: DataFrame, key: str, order: str, value: str, half_life: float, weight: Column | None = None) -> DataFrame:
    """Mean of the samples so far, each weighing 2**(-age / half_life), age in units of ``order``: the decayed sum of values over that of weights (1 without ``weight``), however old the samples.

    Sums run inside blocks of ``SPAN`` half-lives, on top of a carry from the
    sums of earlier blocks; so powers stay small, work is in proportion to the
    rows, and a task holds a key's block. Null values are left out; before the
    first value ewma is null.
    """
    length = SPAN * half_life
    s = samples.withColumn("__block", F.floor(F.col(order) / F.lit(length)))
    up = F.pow(F.lit(2.0), (F.col(order) - F.col("__block") * F.lit(length)) / F.lit(float(half_life)))
    x = F.col(value).cast("double")
    s = s.withColumn("__x", x * up).withColumn("__w", F.when(x.isNotNull(), (F.lit(1.0) if weight is None else weight.cast("double")) * up))
    s = s.withColumn("__at", F.struct(F.col(key).alias("key"), F.col("__block").alias("block")))
    sums = s.groupBy("__at").agg(F.coalesce(F.sum("__x"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("__w"), F.lit(0.0)).alias("w"))
    earlier = Window.partitionBy("__at.key").orderBy("__at.block").rangeBetween(-REACH, -1)
    sums = sums.withColumn("__past", F.collect_list(F.struct(F.col("__at.block").alias("block"), "x", "w")).over(earlier))  # at most REACH items

    def carried(c: str) -> Column:
        half = lambda b: F.pow(F.lit(2.0), (b["block"] - F.col("__at.block")) * F.lit(SPAN / 2))
        return F.aggregate("__past", F.lit(0.0), lambda acc, b: acc + b[c] * half(b) * half(b))  # in halves, as the whole power may be no double

    carry = sums.select("__at", carried("x").alias("__cx"), carried("w").alias("__cw"))
    inside = Window.partitionBy("__at").orderBy(order)
    total = lambda c: F.col(f"__c{c}") + F.coalesce(F.sum(f"__{c}").over(inside), F.lit(0.0))
    out = s.join(carry, "__at").withColumn("__x", total("x")).withColumn("__w", total("w"))
    return out.withColumn("ewma", F.col("__x") / F.nullif("__w", F.lit(0.0))).drop("__at", "__block", "__x", "__w", "__cx", "__cw")


def ewma_by_count(samples: DataFrame, key: str, order: str, value: str, half_life: float, weight: Column | None = None) -> DataFrame:
    """The same, decayed by the weights of later samples instead of by time; ``order`` has no ties within a key."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = samples.withColumn("__n", F.sum(F.lit(1.0) if weight is None else weight.cast("double")).over(so_far))
    return ewma_whole(counted, key, "__n", value, half_life, weight).drop("__n")


def speeds(samples: DataFrame, key: str, order: str, total: str, half_life: float, least: int = 4) -> DataFrame:
    """key, order, n, rate: smoothed speed of a cumulative ``total``, per unit of ``order``; null before the ``least``-th observation.

    An observation is the growth since the one before, at least 0, over the time
    since then; the first grows from 0 over one half-life. Of samples at one time
    only the least counts, as no time passes between them.
    """
    w = Window.partitionBy(key).orderBy(order)
    s = samples.groupBy(key, order).agg(F.min(total).cast("double").alias("total")).withColumn("n", F.row_number().over(w))
    s = s.withColumn("delta", F.greatest(F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0.0)), F.lit(0.0)))
    s = s.withColumn("elapsed", F.coalesce((F.col(order) - F.lag(order).over(w)).cast("double"), F.lit(float(half_life))))
    return ewma_whole(s, key, order, "delta", half_life, F.col("elapsed")).select(key, order, "n", F.when(F.col("n") >= least, F.col("ewma")).alias("rate"))


MOMENTS = ("n", "sw", "sx", "sy", "sxx", "sxy", "syy")


def range_moments(points: DataFrame, key: str, order: str, half_life: float) -> DataFrame:
    """key, block and the weighed moments of the points of each range of (key, order), as if the range's last point were the last.

    Ranges are Spark's own and about equal in size, so that a key with most of the
    points is cut into many; points alike in both stay in one range.
    """
    ranged = points.select(key, order, "x", "y").repartitionByRange(key, order).withColumn("block", F.spark_partition_id())
    age = F.row_number().over(Window.partitionBy(key, "block").orderBy(F.col(order).desc())) - 1
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    sums = (F.count("*"), F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y), F.sum(w * y * y))
    return ranged.withColumn("w", F.pow(F.lit(2.0), -age / F.lit(half_life))).groupBy(key, "block").agg(*(c.alias(m) for c, m in zip(sums, MOMENTS)))


def ew_regression(points: DataFrame, key: str, order: str, half_life: float, at: float) -> DataFrame:
    """Exponentially weighted least squares of y on x, by key, after the last point.

    The k-th point from the end weighs 2**(-k / half_life). Gives n, weight,
    intercept, slope, mean at ``at`` and its standard error; null where the points
    don't determine a line, or the weights leave no degree of freedom. Moments of
    ranges are added up, each decayed by the number of its key's points that follow.
    """
    later = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    parts = range_moments(points, key, order, half_life).withColumn("decay", F.pow(F.lit(2.0), -later / F.lit(half_life)))
    s = parts.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(F.col("decay") * F.col(m)).alias(m) for m in MOMENTS[1:]))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumn("det", F.when(F.abs(det) >= 1e-12, det))
    s = s.withColumn("slope", (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.col("det")).withColumn("intercept", (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / F.col("det"))
    free = F.when(F.col("sw") > 2, F.col("sw") - 2)
    noise = F.greatest((F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")) / free, F.lit(0.0))
    spread = F.greatest(noise * (F.col("sxx") - 2 * F.col("sx") * at + F.col("sw") * at * at) / F.col("det"), F.lit(0.0))
    return s.select(key, "n", F.col("sw").alias("weight"), "intercept", "slope", (F.col("intercept") + F.col("slope") * at).alias("mean_at"), F.when(free.isNotNull(), F.sqrt(spread)).alias("se_at"))


def congestion(samples: DataFrame, ts: str, on_ms: int, off_ms: int, scale: float) -> DataFrame:
    """phase_ms within the cycle, and the bandwidth factor: 1 while off, ``scale`` while on."""
    phase = F.pmod(F.col(ts), F.lit(on_ms + off_ms))
    return samples.withColumn("phase_ms", phase).withColumn("factor", F.when(phase < on_ms, F.lit(scale)).otherwise(F.lit(1.0)))


STAGES = ("validating", "committing", "result")


def latest_stage(events: DataFrame, key: str) -> DataFrame:
    """Per key: the furthest stage of the order validating < committing < result, and the most verified; late events can't move either back."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    return events.groupBy(key).agg(F.max_by("stage", F.when(rank > 0, rank)).alias("stage"), F.coalesce(F.max("verified"), F.lit(0)).alias("verified"), F.count("*").alias("n_events"))


#: Milestones of a shard's upload in order; validating comes before them.
MILESTONES = ("uploading", "syncing", "result")


def credited_progress(events: DataFrame, key: str = "shard_id", order: str = "seq") -> DataFrame:
    """key, stage, total, completed, stored, synced: what events(key, order, stage, verified, total) add up to, by arrival in ``order``.

    Counters of validation only move forward, so a late or repeated frame adds nothing.
    The first milestone of a key ends its validation: what was announced but not
    reported is credited, and later validation frames count for nothing. A milestone
    stands if none further has come; skipped ones are credited: whichever of syncing
    and result comes first counts the shard as stored, once, and a result as synced.
    Frames of other kinds and nulls change nothing; a key that has sent no more than
    those is validating, with zero counts.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, MILESTONES)), F.col("stage")), F.lit(0))
    first = events.where(F.col("stage").isin(*MILESTONES)).groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__first"))
    j = events.join(first, F.col(key).eqNullSafe(F.col("__k")), "left")
    counts = (F.col("stage") == "validating") & (F.col("__first").isNull() | (F.col(order) < F.col("__first")))
    most = lambda c: F.coalesce(F.max(F.when(counts, F.greatest(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    at = j.groupBy(key).agg(most("verified").alias("verified"), most("total").alias("total"), F.max(rank).alias("rank"))
    stage = F.when(F.col("rank") > 0, F.get(F.array(*map(F.lit, MILESTONES)), F.col("rank").cast("int") - 1)).otherwise("validating")
    completed = F.when(F.col("rank") > 0, F.greatest("verified", "total")).otherwise(F.col("verified"))
    return at.select(key, stage.alias("stage"), "total", completed.alias("completed"), (F.col("rank") >= 2).cast("long").alias("stored"), (F.col("rank") == 3).cast("long").alias("synced"))


def upload_rollup(dependencies: DataFrame, progress: DataFrame) -> DataFrame:
    """dependencies(file_id, container_hash, n_bytes, is_external), progress(container_hash, ratio) -> completed and total bytes a file."""
    j = dependencies.join(progress, "container_hash", "left")
    done = F.when(F.col("is_external"), F.col("n_bytes")).otherwise(F.floor(F.col("n_bytes") * F.coalesce("ratio", F.lit(0.0))))
    return j.groupBy("file_id").agg(F.sum(done).alias("completed_bytes"), F.sum("n_bytes").alias("total_bytes"), F.bool_and(done == F.col("n_bytes")).alias("complete"))


def outcome(status: Column, transport: Column, cancelled: Column) -> Column:
    """A status decides before the transport does; a cancelled transfer is cancelled whatever happened."""
    by_status = F.when(status == 429, "rate_limited").when(status >= 500, "server_error").when(status == 404, "not_found")
    return F.when(cancelled, "cancelled").otherwise(F.coalesce(by_status, F.when(transport.isin("timeout", "network"), transport), F.when(status >= 400, "other"), F.lit("ok")))


def rate(amount: Column, over: Column) -> Column:
    return F.coalesce(amount / F.nullif(over, F.lit(0)), F.lit(0.0))


def scenario_summary(samples: DataFrame) -> DataFrame:
    """A row a scenario, from samples(scenario, client_id, ts_ms, bytes, concurrency, retries, rtt_ms, bandwidth).

    Bytes and retries are running totals of a client: their maxima add up over
    clients. Utilisation is the bytes in percent of what the bandwidth (bytes a
    millisecond) allowed from each sample to the client's next one, at most 100;
    the mean round trip is of positive ones. Whole numbers are summed and divided once.
    """
    w = Window.partitionBy("scenario", "client_id").orderBy("ts_ms", "bytes")
    s = samples.withColumn("__could", (F.lead("ts_ms").over(w) - F.col("ts_ms")) * F.col("bandwidth"))
    rtt = F.when(F.col("rtt_ms") > 0, F.col("rtt_ms"))
    by_client = s.groupBy("scenario", "client_id").agg(
        F.max("bytes").alias("b"), F.max("retries").alias("r"), F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"), F.sum("__could").alias("could"),
        F.count("*").alias("n"), F.sum("concurrency").alias("c"), F.sum(rtt).alias("rtt"), F.count(rtt).alias("n_rtt"),
    )
    out = by_client.groupBy("scenario").agg(*(F.sum(c).alias(c) for c in ("b", "r", "could", "n", "c", "rtt", "n_rtt")), (F.max("t1") - F.min("t0")).alias("elapsed_ms"))
    return out.select(
        "scenario", F.col("b").alias("bytes"), "elapsed_ms", F.col("r").alias("retries"), rate(F.col("c"), F.col("n")).alias("mean_concurrency"),
        rate(F.col("rtt"), F.col("n_rtt")).alias("mean_rtt_ms"), F.least(100 * rate(F.col("b"), F.col("could")), F.lit(100.0)).alias("utilisation"),
    )
