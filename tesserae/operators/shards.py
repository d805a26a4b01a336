"""Set operations, retention and compaction over metadata shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.digests import shard_name


def union_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """files(file_hash, flags, verification, sha256): on a tie each optional part comes from whichever side has it, left first; flags are joined."""
    l, r = a.alias("l"), b.alias("r")
    j = l.join(r, F.col("l.file_hash") == F.col("r.file_hash"), "full_outer")
    pick = lambda c: F.coalesce(f"l.{c}", f"r.{c}").alias(c)
    return j.select(pick("file_hash"), F.coalesce("l.flags", F.lit(0)).bitwiseOR(F.coalesce("r.flags", F.lit(0))).alias("flags"), pick("verification"), pick("sha256"))


def union_containers(a: DataFrame, b: DataFrame) -> DataFrame:
    """containers by container_hash; the left copy wins."""
    return a.unionByName(b.join(a.select("container_hash"), "container_hash", "left_anti"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """What b has and a has not."""
    return b.join(a.select(key), key, "left_anti")


def _sum_newest_first(shards: DataFrame, column: str, *by: str) -> DataFrame:
    """shards with upto: the sum of ``column`` over each shard and all newer ones, within ``by`` (not null).

    Creation times are cut into ranges of about as many shards each; running sums
    over the few ranges are added to those inside each, so no task holds them all.
    """
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(shards.approxQuantile("created", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    ranged = shards.withColumn("__range", sum((F.when(F.col("created") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    newer = Window.partitionBy(*by).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = ranged.groupBy(*by, "__range").agg(F.sum(column).alias("__sum")).select(*by, "__range", F.coalesce(F.sum("__sum").over(newer), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__range").orderBy(F.col("created").desc(), "shard_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    few = shards.sparkSession.createDataFrame(before.collect(), before.schema)  # a row a range
    return summed.join(F.broadcast(few), [*by, "__range"]).withColumn("upto", F.col("upto") + F.col("__before")).drop("__range", "__before")


def retained(shards: DataFrame, now: int, buffer: int, cap_bytes: int) -> DataFrame:
    """shards(shard_id, created, expires, size) with state: live, expired (kept until the buffer is over), deleted or pruned.

    Of the live ones the newest stay while their sizes add up to no more than the cap.
    """
    live = F.col("expires") >= now
    summed = _sum_newest_first(shards.withColumn("__live", F.coalesce(live, F.lit(False))), "size", "__live")
    state = F.when(live & (F.col("upto") <= cap_bytes), "live").when(live, "pruned").when(F.col("expires") + buffer <= now, "deleted").otherwise("expired")
    return summed.select("shard_id", "size", state.alias("state"))


def indexed_within(shards: DataFrame, cap: int) -> DataFrame:
    """Newest first, a shard is indexed while the chunks before it are fewer than the cap."""
    summed = _sum_newest_first(shards, "n_chunks")
    return summed.select("shard_id", "n_chunks", (F.col("upto") - F.coalesce("n_chunks", F.lit(0)) < cap).alias("indexed"))


def compaction_groups(shards: DataFrame, by: str, target: int, overhead: int, span: int) -> DataFrame:
    """Shards of each ``by`` in order of creation, merged while the sizes less one overhead each stay within the target.

    Only shards of one stretch of ``span`` units of creation time are merged, so a
    fold has a bounded stretch of them, however many there are in all.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created", "shard_id"])
        groups, g, size = [], 0, None
        for s in pdf["size"].tolist():
            if size is not None and size + s - overhead > target:
                g, size = g + 1, None
            size = s if size is None else size + s - overhead
            groups.append(g)
        return pdf.assign(merge_group=groups)

    kept = shards.select(by, F.floor(F.col("created") / span).alias("stretch"), "shard_id", "created", "size")
    return kept.groupBy(by, "stretch").applyInPandas(fold, f"{by} {kept.schema[by].dataType.simpleString()}, stretch long, shard_id long, created long, size long, merge_group long").drop("created")


def compacted(groups: DataFrame, by: str, overhead: int) -> DataFrame:
    """What a compaction does: kind of each shard of ``compaction_groups`` (obsolete where it was merged, skipped where it stays alone), and the merged ones.

    by, stretch, merge_group, shard_id, state, size; a merged shard has the smallest
    id of its members and their sizes, less one overhead for each after the first.
    """
    key = [by, "stretch", "merge_group"]
    sums = groups.groupBy(*key).agg(F.count("*").alias("n"), F.min("shard_id").alias("first"), (F.sum("size") - (F.count("*") - 1) * overhead).alias("merged"))
    old = groups.join(sums.select(*key, "n"), key).select(*key, "shard_id", F.when(F.col("n") > 1, "obsolete").otherwise("skipped").alias("state"), "size")
    return old.unionByName(sums.where("n > 1").select(*key, F.col("first").alias("shard_id"), F.lit("merged").alias("state"), F.col("merged").alias("size")))


def flushed(report: DataFrame, now: int, valid_for: int) -> DataFrame:
    """The shards that a session sends when it is flushed, with their expiry: those that compaction made and those it left alone."""
    return report.where("state <> 'obsolete'").select("shard_id", "size", F.lit(now + valid_for).cast("long").alias("expires"))


def union_in_memory(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Containers or chunk rows of two shards in memory; the right copy wins."""
    return b.unionByName(a.join(b.select(key), key, "left_anti"))


RECORD = 48


def record_ranges(files: DataFrame, by: str) -> DataFrame:
    """by, file_hash, data_start, data_end, verification_start, verification_end, sha256: where each file's record lies in its shard's section.

    files(by, file_hash, flags, n_segments, sha256), in order of hash; a record is
    a header, an item a segment, as many verification items if bit 31 is set, and
    one more with the digest if bit 30 is; all of ``RECORD`` bytes.
    """
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(1 << bit)) != 0
    n = F.col("n_segments")
    items = 1 + n + F.when(has(31), n).otherwise(0) + has(30).cast("long")
    before = Window.partitionBy(by).orderBy("file_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = files.withColumn("__at", F.coalesce(F.sum(items).over(before), F.lit(0)) * RECORD)
    start = F.col("__at") + RECORD
    end = start + n * RECORD
    return at.select(by, "file_hash", start.alias("data_start"), end.alias("data_end"), F.when(has(31), end).alias("verification_start"), F.when(has(31), end + n * RECORD).alias("verification_end"), F.when(has(30), F.col("sha256")).alias("sha256"))


def minimal_rows(placed: DataFrame, starts: DataFrame, kept: Column | None = None) -> DataFrame:
    """Container chunks as a minimal shard has them: container_hash, chunk_idx, chunk_hash, flags with bit 31 where the chunk starts a file; of the containers that ``kept`` holds for."""
    rows = placed if kept is None else placed.where(kept)
    mark = starts.select("container_hash", "chunk_idx", F.lit(1 << 31).cast("long").alias("flags"))
    return rows.join(mark, ["container_hash", "chunk_idx"], "left").select("container_hash", "chunk_idx", "chunk_hash", F.coalesce("flags", F.lit(0)).alias("flags"))


def with_expiry(shards: DataFrame, now: Column, valid_for: int) -> DataFrame:
    return shards.withColumn("expires", (now + valid_for).cast("long"))


def flag_order(a: Column, b: Column) -> Column:
    """Which of two records of one file has all the other's flags: equal, left, right or neither."""
    return F.when(a == b, "equal").when(a.bitwiseAND(b) == b, "left").when(a.bitwiseAND(b) == a, "right").otherwise("neither")


def valid_shards(names: DataFrame, now: int) -> DataFrame:
    """names(path, expires) of a folder -> shard_hash, expires: names that are a hash, not expired, the latest expiry of each; others are passed over."""
    named = names.withColumn("shard_hash", shard_name("path")).where(F.col("shard_hash").isNotNull() & (F.col("expires") >= now))
    return named.groupBy("shard_hash").agg(F.max("expires").alias("expires"))


def registered(known: DataFrame, arriving: DataFrame) -> DataFrame:
    """Shards to look into: those known and those that arrive, each once: shard_id, key, created, collection, place.

    Collections are those of one key; the one without key is number 0, the others
    follow by key. Within a collection the newest shard comes first.
    """
    columns = ["shard_id", "key", "created"]
    fresh = arriving.select(*columns).dropDuplicates(["shard_id"]).join(known.select("shard_id"), "shard_id", "left_anti")
    rows = known.select(*columns).unionByName(fresh)
    keys = rows.select("key").distinct().withColumn("collection", (F.row_number().over(Window.orderBy(F.col("key").asc_nulls_first())) - F.lit(1)).cast("long"))  # a row a key
    lone = rows.where("key is null").limit(1).count() == 0  # without a collection that has no key the others still begin at 1
    keys = keys.select(F.col("key").alias("__key"), (F.col("collection") + (1 if lone else 0)).alias("collection"))
    newest = Window.partitionBy("key").orderBy(F.col("created").desc(), "shard_id")
    joined = rows.join(F.broadcast(keys), F.col("key").eqNullSafe(F.col("__key")))
    return joined.select("shard_id", "key", "created", "collection", F.row_number().over(newest).cast("long").alias("place"))


def dedup_answers(asked: DataFrame, dedup_rows: DataFrame, shards: DataFrame, now: int, valid_for: int | None) -> DataFrame:
    """asked(chunk_hash) -> chunk_hash, shard_id, size, expires: the shard that the shared index names for a chunk.

    With ``valid_for`` the answer is the shard without its files (size is that of its
    chunk rows) and expires after that time; without, it is the shard as it is. A row
    that names a missing shard has no answer.
    """
    hit = asked.select("chunk_hash").distinct().join(dedup_rows, "chunk_hash").join(shards, "shard_id")
    if valid_for is None:
        return hit.select("chunk_hash", "shard_id", "size", "expires")
    return hit.select("chunk_hash", "shard_id", (F.col("n_chunks") * RECORD).alias("size"), F.lit(now + valid_for).cast("long").alias("expires"))


def delete_shards(shards: DataFrame, file_to_shard: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shards and the file rows that stay when some shards are deleted."""
    return shards.join(ids.select("shard_id"), "shard_id", "left_anti"), file_to_shard.join(ids.select("shard_id"), "shard_id", "left_anti")


def shard_faults(shards: DataFrame, names: DataFrame, files: DataFrame, rows: DataFrame, index: DataFrame) -> DataFrame:
    """shard_id, fault of shards that aren't what they say.

    shards(shard_id, shard_hash, n_files), names(shard_id, name_hash, content_hash),
    files(shard_id, file_hash), rows and index (shard_id, container_hash, chunk_idx,
    chunk_hash). Faults: hash (the stored, the name's and the content's differ),
    files (their count differs), index (the chunk index isn't that of the rows).
    """
    j = shards.join(names, "shard_id", "left")
    agree = (F.col("shard_hash") == F.col("name_hash")) & (F.col("shard_hash") == F.col("content_hash"))
    wrong = j.where(~F.coalesce(agree, F.lit(False))).select("shard_id", F.lit("hash").alias("fault"))
    counted = shards.join(files.groupBy("shard_id").agg(F.count("*").alias("n")), "shard_id", "left").where("n_files <> coalesce(n, 0)").select("shard_id", F.lit("files").alias("fault"))
    place = ["shard_id", "container_hash", "chunk_idx", "chunk_hash"]
    odd = rows.select(*place).unionByName(index.select(*place)).groupBy(*place).count().where("count <> 2").select("shard_id", F.lit("index").alias("fault")).distinct()
    return wrong.unionByName(counted).unionByName(odd)


def orphans(shards: DataFrame, file_to_shard: DataFrame, segments: DataFrame, shard_containers: DataFrame, stored: DataFrame) -> DataFrame:
    """kind, id: shards without an active file and without a container that one uses; stored containers that nothing names."""
    used = segments.join(file_to_shard.select("file_hash").distinct(), "file_hash", "left_semi").select("container_hash").distinct()
    holds_used = shard_containers.join(used, "container_hash", "left_semi").select("shard_id").distinct()
    lone = shards.select("shard_id").join(file_to_shard.select("shard_id"), "shard_id", "left_anti").join(holds_used, "shard_id", "left_anti")
    named = used.unionByName(shard_containers.select("container_hash")).distinct()
    loose = stored.select("container_hash").join(named, "container_hash", "left_anti")
    return lone.select(F.lit("shard").alias("kind"), F.col("shard_id").cast("string").alias("id")).unionByName(loose.select(F.lit("container").alias("kind"), F.col("container_hash").alias("id")))


def violations(segments: DataFrame, stored: DataFrame, shard_containers: DataFrame, dedup_rows: DataFrame, shards: DataFrame) -> DataFrame:
    """kind, id of listed containers that are not stored, segments out of range or of unknown containers, and dedup rows of missing shards."""
    have = stored.select("container_hash", "n_chunks")
    missing = shard_containers.select("container_hash").distinct().join(have, "container_hash", "left_anti").select(F.lit("missing_container").alias("kind"), F.col("container_hash").alias("id"))
    seg = segments.join(have, "container_hash", "left")
    name = F.concat_ws(":", "file_hash", F.col("seg_idx").cast("string"))
    broken = seg.where(F.col("n_chunks").isNull() | (F.col("chunk_end") > F.col("n_chunks"))).select(F.when(F.col("n_chunks").isNull(), "unknown_container").otherwise("range").alias("kind"), name.alias("id"))
    dangling = dedup_rows.join(shards.select("shard_id"), "shard_id", "left_anti").select(F.lit("missing_shard").alias("kind"), F.col("chunk_hash").alias("id"))
    return missing.unionByName(broken).unionByName(dangling)


def delete_tagged(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """objects(id, tag) with deleted: only where a request names the same tag."""
    asked = requests.select("id", "tag").distinct().withColumn("hit", F.lit(True))
    return objects.join(asked, ["id", "tag"], "left").select("id", "tag", F.coalesce("hit", F.lit(False)).alias("deleted"))
