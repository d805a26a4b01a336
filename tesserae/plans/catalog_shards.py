"""Queries over compacted metadata shards. A shard describes 20 documents: their files, the segments of those, the containers these lie in and their chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import compaction
from tesserae.sources.shared import shared_dir, written

from . import relations as rel
from .registry import registered
from .relations import read, sql_with
from .shard_store import ShardStore

OVERHEAD, TARGET, SPAN = 248, 320_000, 50


def shard_relations(spark, sf_dir):
    """The relations of ``ShardStore``, with kind; copies within a shard are one file with all their flags."""
    chunks, named, placed = rel.store(spark, sf_dir)
    segs = written(rel.packing.segments(chunks, placed), "segments")
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("file_hash"))
    shard = F.floor(F.col("file_id") / 20).alias("shard_id")
    bit = lambda every, at: F.floor(F.col("file_id") / every) % 2 * F.lit(1 << at)
    counts = segs.groupBy("file_id").agg(F.count("*").alias("n_segments"))
    files = docs.join(counts, "file_id").groupBy(shard, "file_hash").agg(F.bit_or((bit(1, 31) + bit(2, 30)).cast("long")).alias("flags"), F.max("n_segments").alias("n_segments"))
    segments = segs.join(docs, "file_id").select(shard, "file_hash", "seg_idx", "container_hash", "chunk_start", "chunk_end", "bytes").distinct()
    containers = segments.select("shard_id", "container_hash").distinct().join(named.select("container_hash", "n_chunks"), "container_hash")
    return {
        "shards": rel.synthetic_shards(chunks).select("shard_id", "kind", "created", "expires"),
        "shard_files": written(files, "shard-files"),
        "shard_segments": segments,
        "shard_containers": written(containers, "shard-containers"),
        "shard_chunks": placed.join(containers.select("shard_id", "container_hash"), "container_hash").select("shard_id", "container_hash", "chunk_idx", "chunk_hash", "length"),
    }


# sizes of all unions of neighbouring shards by distinct parts; a group ends where the union and the next shard exceed the target
def _sql(by: str) -> str:
    same = lambda a, b: f"{a}.{by} = {b}.{by} AND {a}.stretch = {b}.stretch"
    return f"""sfiles AS (SELECT doc_id // 20 AS shard_id, sha256(text) AS file_hash, bit_or(doc_id % 2 * 2147483648 + doc_id // 2 % 2 * 1073741824) AS flags, max(n) AS n_segments
        FROM documents JOIN (SELECT file_id AS doc_id, count(*) AS n FROM segments GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
    ssegs AS (SELECT DISTINCT doc_id // 20 AS shard_id, sha256(text) AS file_hash, seg_idx, container_hash, chunk_start, chunk_end, bytes FROM segments s JOIN documents d ON d.doc_id = s.file_id),
    sconts AS (SELECT DISTINCT shard_id, container_hash, n_chunks FROM ssegs JOIN named USING (container_hash)),
    sparts AS (SELECT shard_id, 'f' || file_hash AS part, 48 * (1 + n_segments) + 12 AS bytes FROM sfiles UNION SELECT shard_id, 'v' || file_hash, 48 * n_segments FROM sfiles WHERE flags & 2147483648 <> 0
        UNION SELECT shard_id, 'm' || file_hash, 48 FROM sfiles WHERE flags & 1073741824 <> 0 UNION SELECT shard_id, 'c' || container_hash, 48 * (1 + n_chunks) + 12 + 16 * n_chunks FROM sconts),
    sh AS (SELECT shard_id, {by}, created // {SPAN} AS stretch, row_number() OVER (PARTITION BY {by}, created // {SPAN} ORDER BY created, shard_id) AS rn FROM (SELECT *, 0 AS everything FROM shards)),
    unions AS (SELECT {by}, stretch, i, j, CAST({OVERHEAD} + sum(bytes) AS BIGINT) AS u FROM
        (SELECT DISTINCT a.{by}, a.stretch, a.rn AS i, b.rn AS j, p.part, p.bytes FROM sh a JOIN sh b ON {same("a", "b")} AND b.rn >= a.rn JOIN sh c ON {same("a", "c")} AND c.rn BETWEEN a.rn AND b.rn JOIN sparts p ON p.shard_id = c.shard_id) GROUP BY 1, 2, 3, 4),
    walk AS (SELECT {by}, stretch, rn, CAST(0 AS BIGINT) AS g, rn AS start FROM sh WHERE rn = 1
        UNION ALL SELECT w.{by}, w.stretch, w.rn + 1, CASE WHEN h.u + n.u - {OVERHEAD} > {TARGET} THEN g + 1 ELSE g END, CASE WHEN h.u + n.u - {OVERHEAD} > {TARGET} THEN w.rn + 1 ELSE start END
        FROM walk w JOIN unions h ON {same("h", "w")} AND h.i = w.start AND h.j = w.rn JOIN unions n ON {same("n", "w")} AND n.i = w.rn + 1 AND n.j = w.rn + 1),
    plan AS (SELECT s.{by}, s.stretch, s.shard_id, o.u AS size, w.g AS merge_group, last_value(h.u) OVER g AS merged_size, s.rn, min(s.shard_id) OVER g AS into_, count(*) OVER g AS members
        FROM walk w JOIN sh s ON {same("s", "w")} AND s.rn = w.rn JOIN unions o ON {same("o", "w")} AND o.i = w.rn AND o.j = w.rn JOIN unions h ON {same("h", "w")} AND h.i = w.start AND h.j = w.rn
        WINDOW g AS (PARTITION BY s.{by}, s.stretch, w.g ORDER BY s.rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _plan(made):
    return compaction.merge_plan(made["shards"], compaction.parts(made["shard_files"], made["shard_containers"]), "kind", TARGET, OVERHEAD, SPAN)


@registered(sql_with("SELECT kind, stretch, shard_id, size, merge_group, merged_size FROM plan", "segments", "named", "shards", extra=_sql("kind")))
def compaction_by_union_size(spark, sf_dir):
    return _plan(shard_relations(spark, sf_dir)).drop("place")


@registered(
    sql_with(
        """SELECT 'file' AS relation, into_ AS shard_id, file_hash AS hash, bit_or(flags) AS flags, arg_min(n_segments, rn) AS n, arg_min(shard_id, rn) AS record_from,
        arg_min(shard_id, rn) FILTER (flags & 2147483648 <> 0) AS verification_from, arg_min(shard_id, rn) FILTER (flags & 1073741824 <> 0) AS metadata_from FROM sfiles JOIN plan USING (shard_id) GROUP BY into_, file_hash
    UNION ALL SELECT 'container', into_, container_hash, NULL, arg_min(n_chunks, rn), arg_min(shard_id, rn), NULL, NULL FROM sconts JOIN plan USING (shard_id) GROUP BY into_, container_hash""",
        "segments",
        "named",
        "shards",
        extra=_sql("kind"),
    )
)
def compacted_rows(spark, sf_dir):
    made = shard_relations(spark, sf_dir)
    to = written(compaction.destinations(_plan(made), "kind"), "destinations")
    files = compaction.merged_files(made["shard_files"], to).withColumnsRenamed({"file_hash": "hash", "n_segments": "n"})
    containers = compaction.merged_containers(made["shard_containers"], to).withColumnsRenamed({"container_hash": "hash", "n_chunks": "n"})
    return files.withColumn("relation", F.lit("file")).unionByName(containers.withColumn("relation", F.lit("container")), allowMissingColumns=True)


@registered(
    sql_with(
        """SELECT 'segment' AS relation, into_ AS shard_id, file_hash AS hash, count(DISTINCT seg_idx) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM
        (SELECT DISTINCT into_, file_hash, seg_idx, bytes FROM ssegs JOIN plan USING (shard_id)) GROUP BY into_, file_hash
    UNION ALL SELECT 'chunk', into_, container_hash, count(*), CAST(sum(length) AS BIGINT) FROM (SELECT DISTINCT into_, container_hash FROM sconts JOIN plan USING (shard_id)) JOIN placed USING (container_hash) GROUP BY into_, container_hash
    UNION ALL SELECT DISTINCT 'shard', into_, NULL, members, CASE WHEN members > 1 THEN merged_size END FROM plan""",
        "segments",
        "named",
        "placed",
        "shards",
        extra=_sql("everything"),
    )
)
def compacted_store(spark, sf_dir):
    """Shards added in two batches, merged and swapped in: what a reader then finds."""
    made = shard_relations(spark, sf_dir)
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", OVERHEAD)
    for half in (0, 1):
        store.add({name: df.where(F.col("shard_id") % 2 == half) for name, df in made.items()})
    report = store.compact(TARGET, SPAN)
    total = lambda name, kind, by, size: store.read(name).groupBy("shard_id", F.col(by).alias("hash")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).withColumn("relation", F.lit(kind))
    there = report.groupBy("into").agg(F.count("*").alias("n"), F.max(F.when(F.col("state") == "obsolete", F.col("merged_size"))).alias("bytes"))
    there = store.read("shards").join(there, F.col("shard_id") == F.col("into")).select("shard_id", F.lit(None).cast("string").alias("hash"), "n", "bytes", F.lit("shard").alias("relation"))
    return total("shard_segments", "segment", "file_hash", "bytes").unionByName(total("shard_chunks", "chunk", "container_hash", "length")).unionByName(there)
