"""The registered queries of the engine and the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import bytegroups, digests, hashes
from tesserae.functions.chunking import ChunkSpec
from tesserae.operators import chunks as ch
from tesserae.operators import dedup, edits, intervals, merkle, merkle_partial, metrics, packing, payloads, reconstruct, sessions, shards
from tesserae.sources import store
from tesserae.sources.shared import shared_dir, written

from . import catalog_shards, catalog_store  # noqa: F401
from . import relations as rel
from .registry import ORACLE_SQL, QUERIES, registered  # noqa: F401
from .relations import read, sql_with

METRICS_SQL = """count(*) AS total_chunks, CAST(sum(length) AS BIGINT) AS total_bytes, count(*) FILTER (is_new) AS new_chunks, CAST(coalesce(sum(length) FILTER (is_new), 0) AS BIGINT) AS new_bytes,
    count(*) FILTER (NOT is_new) AS deduped_chunks, CAST(coalesce(sum(length) FILTER (NOT is_new), 0) AS BIGINT) AS deduped_bytes,
    round(coalesce(CAST(coalesce(sum(length) FILTER (NOT is_new), 0) AS DOUBLE) / nullif(sum(length), 0), 0), 6) AS dedup_ratio"""


@registered(sql_with(f"SELECT d.source, {METRICS_SQL} FROM flagged f JOIN documents d ON d.doc_id = f.file_id GROUP BY d.source", "flagged"))
def line_chunk_dedup_report(spark, sf_dir):
    """Chunks and bytes in all, new and deduplicated, by source."""
    docs = read(spark, sf_dir, "documents")
    return dedup.dedup_totals(ch.line_chunks(docs), docs.select(F.col("doc_id").alias("file_id"), "source"), "source")


@registered(sql_with("SELECT chunk_hash, file_id, chunk_idx, length FROM firsts", "firsts"))
def chunk_index_build(spark, sf_dir):
    return dedup.first_locations(rel.line_chunks(spark, sf_dir))


@registered(sql_with("SELECT chunk_hash, count(*) AS n, count(DISTINCT file_id) AS n_files, CAST(sum(length) AS BIGINT) AS bytes FROM chunks GROUP BY 1 ORDER BY n DESC, chunk_hash LIMIT 100", "chunks"))
def chunk_popularity_topk(spark, sf_dir):
    by = rel.line_chunks(spark, sf_dir).groupBy("chunk_hash", "file_id").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return by.groupBy("chunk_hash").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("n"), "chunk_hash").limit(100)


@registered(sql_with("SELECT DISTINCT chunk_hash FROM chunks WHERE chunk_idx = 0 OR right(chunk_hash, 1) = '0'", "chunks"))
def global_dedup_eligible(spark, sf_dir):
    """Chunks that start a file, or whose hash is a multiple of 16."""
    return dedup.eligible_chunks(rel.line_chunks(spark, sf_dir), hashes.dedup_eligible("chunk_hash", 16))


@registered(
    sql_with(
        """SELECT file_id, group_idx, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS bytes FROM (SELECT *, CAST(coalesce(sum(CASE WHEN right(chunk_hash, 1) IN ('0', '4', '8', 'c') THEN 1 ELSE 0 END)
        OVER (PARTITION BY file_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_idx FROM chunks) GROUP BY 1, 2""",
        "chunks",
    )
)
def natural_cut_groups(spark, sf_dir):
    return ch.natural_groups(rel.line_chunks(spark, sf_dir), hashes.natural_cut("chunk_hash"))


@registered(
    sql_with(
        """SELECT file_id, target, min(chunk_idx) AS chunk_start, max(chunk_idx) + 1 AS chunk_end, min(target_idx) AS target_start, CAST(sum(length) AS BIGINT) AS bytes FROM
        (SELECT *, chunk_idx - row_number() OVER (PARTITION BY file_id, target, chunk_idx - target_idx ORDER BY chunk_idx) AS island FROM hit) GROUP BY file_id, target, chunk_idx - target_idx, island""",
        "chunks",
        extra="""known AS (SELECT chunk_hash, file_id AS target, chunk_idx AS target_idx FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY file_id, chunk_idx) AS r FROM chunks WHERE file_id % 2 = 0) WHERE r = 1),
        hit AS (SELECT c.*, k.target, k.target_idx FROM chunks c JOIN known k USING (chunk_hash) WHERE c.file_id % 2 = 1)""",
    )
)
def dedup_runs_vs_index(spark, sf_dir):
    """Files with odd ids against an index of those with even ids."""
    chunks = rel.line_chunks(spark, sf_dir)
    known = dedup.first_locations(chunks.where("file_id % 2 = 0")).select("chunk_hash", F.col("file_id").alias("target"), F.col("chunk_idx").alias("target_idx"))
    return dedup.runs_against_index(chunks.where("file_id % 2 = 1"), known)


@registered(
    sql_with(
        """SELECT file_id, chunk_idx, CASE WHEN chunk_hash IN (SELECT sha256(text) FROM benchmark) THEN 'session' WHEN chunk_hash IN (SELECT chunk_hash FROM chunks WHERE file_id % 3 = 0) THEN 'cache'
        WHEN chunk_hash IN (SELECT sha256(text) FROM conversations) THEN 'remote' END AS layer FROM chunks WHERE file_id % 3 <> 0""",
        "chunks",
    )
)
def dedup_layer_priority(spark, sf_dir):
    chunks = rel.line_chunks(spark, sf_dir)
    whole = lambda t: read(spark, sf_dir, t).select(F.sha2("text", 256).alias("chunk_hash"))
    layers = [("session", whole("benchmark")), ("cache", chunks.where("file_id % 3 = 0")), ("remote", whole("conversations"))]
    return dedup.layered_lookup(chunks.where("file_id % 3 <> 0"), layers).select("file_id", "chunk_idx", "layer")


@registered(sql_with("SELECT grp, bin, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS bytes, min(file_id) AS first_file, max(file_id) AS last_file FROM packed GROUP BY grp, bin", "packed"))
def greedy_bin_packing(spark, sf_dir):
    bins = rel.packed(rel.line_chunks(spark, sf_dir))
    return bins.groupBy("grp", "bin").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("bytes"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


@registered(
    sql_with(
        """SELECT o.file_id, o.chunk_idx, o.length, CAST(s.bin AS BIGINT) AS bin, o.rn - s.rn AS pos FROM ordered o ASOF JOIN starts s ON o.rn >= s.rn""",
        "firsts",
        extra=f"""ordered AS (SELECT *, row_number() OVER w AS rn, CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM firsts WINDOW w AS (ORDER BY file_id, chunk_idx)),
        sums AS (SELECT upto, min(rn) AS rn FROM ordered GROUP BY upto),
        jumps AS MATERIALIZED (SELECT o.rn, least(o.rn + {rel.MAX_CHUNKS}, greatest(o.rn + 1, coalesce(b.rn, o.rn + {rel.MAX_CHUNKS}))) AS next_ FROM ordered o ASOF LEFT JOIN sums b ON b.upto > o.upto - o.length + {rel.MAX_BYTES}),
        starts AS (SELECT CAST(1 AS BIGINT) AS rn, 0 AS bin UNION ALL SELECT j.next_, s.bin + 1 FROM starts s JOIN jumps j ON j.rn = s.rn WHERE j.next_ <= (SELECT max(rn) FROM jumps))""",
    )
)
def whole_source_packing(spark, sf_dir):
    """New chunks of all files packed in one order, as a session packs them, by ranges side by side."""
    new = dedup.first_locations(rel.line_chunks(spark, sf_dir)).withColumn("grp", F.lit(0).cast("long"))
    return packing.pack_ranges(new, rel.MAX_BYTES, rel.MAX_CHUNKS).select("file_id", "chunk_idx", "length", "bin", "pos")


@registered(sql_with("SELECT * FROM placed", "placed"))
def container_chunk_offsets(spark, sf_dir):
    return rel.store(spark, sf_dir)[2]


@registered(sql_with("SELECT * FROM segments", "segments"))
def file_segments(spark, sf_dir):
    return rel.segments(spark, sf_dir)[0]


def _terms(spark, sf_dir):
    segs, placed = rel.segments(spark, sf_dir)
    asked = rel.requests(segs)
    return asked, reconstruct.terms(asked, segs, placed), placed


@registered(sql_with("SELECT * FROM terms", "terms"))
def reconstruct_range_terms(spark, sf_dir):
    return _terms(spark, sf_dir)[1]


@registered(sql_with("SELECT * FROM fetches", "fetches"))
def reconstruct_fetch_ranges(spark, sf_dir):
    _, found, placed = _terms(spark, sf_dir)
    return reconstruct.fetch_ranges(found, placed)


@registered(
    sql_with(
        """SELECT query_id, container_hash, request_idx, 'bytes=' || string_agg(byte_start || '-' || (byte_end - 1), ',' ORDER BY chunk_start) AS byte_ranges FROM
        (SELECT *, (row_number() OVER (PARTITION BY query_id, container_hash ORDER BY chunk_start) - 1) // 2 AS request_idx FROM fetches) GROUP BY 1, 2, 3""",
        "fetches",
    )
)
def reconstruct_multirange(spark, sf_dir):
    _, found, placed = _terms(spark, sf_dir)
    return reconstruct.multirange(reconstruct.fetch_ranges(found, placed), 2)


@registered(sql_with("SELECT query_id, count(*) AS n_fetches, CAST(sum(byte_end - byte_start) AS BIGINT) AS transfer_bytes FROM fetches GROUP BY 1", "fetches"))
def reconstruct_transfer_bytes(spark, sf_dir):
    _, found, placed = _terms(spark, sf_dir)
    return reconstruct.fetch_ranges(found, placed).groupBy("query_id").agg(F.count("*").alias("n_fetches"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("transfer_bytes"))


@registered(
    sql_with("SELECT t.query_id, t.term_idx, t.container_hash, f.chunk_start AS block_start, f.chunk_end AS block_end FROM terms t LEFT JOIN fetches f ON f.query_id = t.query_id AND f.container_hash = t.container_hash AND f.chunk_start <= t.chunk_start AND f.chunk_end >= t.chunk_end", "fetches")
)
def term_to_block_containment(spark, sf_dir):
    _, found, placed = _terms(spark, sf_dir)
    return reconstruct.blocks_of_terms(found, reconstruct.fetch_ranges(found, placed))


@registered(
    sql_with(
        """SELECT file_id, min(s) AS start, max(e) AS end, count(*) AS n_ranges FROM (SELECT *, max(CASE WHEN s > reach OR reach IS NULL THEN s END) OVER (PARTITION BY file_id ORDER BY s) AS isl FROM
        (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT file_id, chunk_idx * 97 % 1000 AS s, chunk_idx * 97 % 1000 + length % 120 AS e FROM chunks))) GROUP BY file_id, isl""",
        "chunks",
    )
)
def interval_union(spark, sf_dir):
    ranges = rel.line_chunks(spark, sf_dir).select("file_id", (F.col("chunk_idx") * 97 % 1000).alias("start"), (F.col("chunk_idx") * 97 % 1000 + F.col("length") % 120).alias("end"))
    return intervals.coalesced(ranges, ["file_id"])


def _file_records(spark, sf_dir):
    """Two shards of file records that share the files with ids divisible by 6; verification and sha256 are there on one side or the other."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    files = docs.groupBy(F.col("h").alias("file_hash")).agg(F.min("doc_id").alias("id"))
    side = lambda m, flag, ver, sha: files.where(F.col("id") % m == 0).select("file_hash", F.lit(flag).cast("long").alias("flags"), F.when(F.lit(ver), F.substring("file_hash", 1, 8)).alias("verification"), F.when(F.lit(sha), F.col("file_hash")).alias("sha256"))
    return side(2, 1 << 31, True, False), side(3, 1 << 30, False, True)


FILES_SQL = """f AS (SELECT sha256(text) AS file_hash, min(doc_id) AS id FROM documents GROUP BY 1)"""


@registered(
    f"""WITH {FILES_SQL} SELECT file_hash, CASE WHEN id % 2 = 0 THEN 2147483648 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1073741824 ELSE 0 END AS flags,
    CASE WHEN id % 2 = 0 THEN substr(file_hash, 1, 8) END AS verification, CASE WHEN id % 3 = 0 THEN file_hash END AS sha256 FROM f WHERE id % 2 = 0 OR id % 3 = 0"""
)
def shard_union_files(spark, sf_dir):
    return shards.union_files(*_file_records(spark, sf_dir))


@registered(f"WITH {FILES_SQL} SELECT file_hash, CAST(1073741824 AS BIGINT) AS flags FROM f WHERE id % 3 = 0 AND id % 2 <> 0")
def shard_difference(spark, sf_dir):
    return shards.difference(*_file_records(spark, sf_dir), "file_hash").select("file_hash", "flags")


@registered(sql_with("SELECT container_hash, n_chunks, CASE WHEN grp % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM named", "named"))
def shard_union_containers(spark, sf_dir):
    named = rel.store(spark, sf_dir)[1]
    left = named.where("grp % 2 = 0").select("container_hash", "n_chunks", F.lit("left").alias("side"))
    return shards.union_containers(left, named.select("container_hash", "n_chunks", F.lit("right").alias("side")))


@registered(
    sql_with(
        """SELECT shard_id, size, CASE WHEN expires >= 60 AND upto <= 40000 THEN 'live' WHEN expires >= 60 THEN 'pruned' WHEN expires + 30 <= 60 THEN 'deleted' ELSE 'expired' END AS state
        FROM (SELECT *, sum(size) OVER (PARTITION BY expires >= 60 ORDER BY created DESC, shard_id ROWS UNBOUNDED PRECEDING) AS upto FROM shards)""",
        "shards",
    )
)
def shard_retention_prune(spark, sf_dir):
    return shards.retained(rel.synthetic_shards(rel.line_chunks(spark, sf_dir)), now=60, buffer=30, cap_bytes=40000)


@registered(sql_with("SELECT shard_id, n_chunks, coalesce(sum(n_chunks) OVER (ORDER BY created DESC, shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3000 AS indexed FROM shards", "shards"))
def shard_index_cap(spark, sf_dir):
    return shards.indexed_within(rel.synthetic_shards(rel.line_chunks(spark, sf_dir)), 3000)


@registered(
    sql_with(
        "SELECT (SELECT count(*) FROM named) AS n_containers, (SELECT count(*) FROM placed) AS n_stored_chunks, (SELECT CAST(sum(bytes_raw) AS BIGINT) FROM named) AS stored_bytes, (SELECT count(DISTINCT file_id) FROM segments) AS n_files, (SELECT count(*) FROM segments) AS n_segments, (SELECT CAST(sum(bytes) AS BIGINT) FROM segments) AS materialized_bytes",
        "segments",
    )
)
def storage_totals(spark, sf_dir):
    chunks, named, placed = rel.store(spark, sf_dir)
    a = named.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_stored_chunks"), F.sum("bytes_raw").alias("stored_bytes"))
    b = packing.segments(chunks, placed).groupBy("file_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_segments"), F.sum("bytes").alias("materialized_bytes"))
    return a.crossJoin(b)  # one row each


def _holes(spark, sf_dir):
    """A store with holes: containers of every third group are gone, files 0 mod 5 and those of every fourth shard are deleted, dedup rows name shards that may be missing."""
    chunks, named, placed = rel.store(spark, sf_dir)
    segs = packing.segments(chunks, placed).select(F.col("file_id").cast("string").alias("file_hash"), "seg_idx", "container_hash", "chunk_start", "chunk_end")
    files = chunks.select("file_id").distinct().where("file_id % 5 <> 0 and floor(file_id / 20) % 4 <> 3").select(F.col("file_id").cast("string").alias("file_hash"), F.floor(F.col("file_id") / 20).alias("shard_id"))
    all_shards = rel.synthetic_shards(chunks).select("shard_id")
    listed = named.where("bin % 4 <> 3").select((F.col("grp") * 13 + F.col("bin")).alias("shard_id"), "container_hash")
    stored = named.where("grp % 3 <> 2").select("container_hash", F.when(F.col("bin") % 5 == 4, F.col("n_chunks") - 1).otherwise(F.col("n_chunks")).alias("n_chunks"))
    rows = placed.where("chunk_idx = 0").select("chunk_hash", (F.conv(F.right("chunk_hash", F.lit(3)), 16, 10).cast("long") % 80).alias("shard_id"))
    return segs, files, all_shards, listed, stored, rows


HOLES = """seg AS (SELECT CAST(file_id AS VARCHAR) AS file_hash, seg_idx, container_hash, chunk_start, chunk_end FROM segments),
    files AS (SELECT DISTINCT CAST(file_id AS VARCHAR) AS file_hash, file_id // 20 AS shard_id FROM chunks WHERE file_id % 5 <> 0 AND file_id // 20 % 4 <> 3),
    listed AS (SELECT grp * 13 + bin AS shard_id, container_hash FROM named WHERE bin % 4 <> 3),
    stored AS (SELECT container_hash, CASE WHEN bin % 5 = 4 THEN n_chunks - 1 ELSE n_chunks END AS n_chunks FROM named WHERE grp % 3 <> 2),
    dedup_rows AS (SELECT chunk_hash, CAST('0x' || right(chunk_hash, 3) AS BIGINT) % 80 AS shard_id FROM placed WHERE chunk_idx = 0),
    used AS (SELECT DISTINCT container_hash FROM seg WHERE file_hash IN (SELECT file_hash FROM files))"""


@registered(
    sql_with(
        """SELECT 'shard' AS kind, CAST(shard_id AS VARCHAR) AS id FROM shards WHERE shard_id NOT IN (SELECT shard_id FROM files) AND shard_id NOT IN (SELECT shard_id FROM listed WHERE container_hash IN (SELECT container_hash FROM used))
        UNION ALL SELECT 'container', container_hash FROM stored WHERE container_hash NOT IN (SELECT container_hash FROM used) AND container_hash NOT IN (SELECT container_hash FROM listed)""",
        "segments",
        "shards",
        extra=HOLES,
    )
)
def reachability_orphans(spark, sf_dir):
    segs, files, all_shards, listed, stored, _ = _holes(spark, sf_dir)
    return shards.orphans(all_shards, files, segs, listed, stored)


@registered(
    sql_with(
        """SELECT DISTINCT 'missing_container' AS kind, container_hash AS id FROM listed WHERE container_hash NOT IN (SELECT container_hash FROM stored)
        UNION ALL SELECT CASE WHEN n_chunks IS NULL THEN 'unknown_container' ELSE 'range' END, file_hash || ':' || seg_idx FROM seg LEFT JOIN stored USING (container_hash) WHERE n_chunks IS NULL OR chunk_end > n_chunks
        UNION ALL SELECT 'missing_shard', chunk_hash FROM dedup_rows WHERE shard_id NOT IN (SELECT shard_id FROM shards)""",
        "segments",
        "shards",
        extra=HOLES,
    )
)
def integrity_violations(spark, sf_dir):
    segs, _, all_shards, listed, stored, rows = _holes(spark, sf_dir)
    return shards.violations(segs, stored, listed, rows, all_shards)


@registered("SELECT CAST(doc_id AS VARCHAR) AS file_hash, doc_id // 20 AS shard_id FROM documents WHERE doc_id % 7 <> 0")
def delete_files(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_hash"), F.floor(F.col("doc_id") / 20).alias("shard_id"), "doc_id")
    return shards.difference(files.where("doc_id % 7 = 0"), files, "file_hash").select("file_hash", "shard_id")


@registered(sql_with("SELECT chunk_hash, shard_id FROM dedup_rows WHERE shard_id NOT BETWEEN 10 AND 19", "segments", "shards", extra=HOLES))
def remove_shard_dedup_entries(spark, sf_dir):
    rows = _holes(spark, sf_dir)[-1]
    return shards.difference(spark.range(10, 20).select(F.col("id").alias("shard_id")), rows, "shard_id").select("chunk_hash", "shard_id")


@registered("SELECT doc_id AS id, 't' || doc_id % 4 AS tag, doc_id % 2 = 0 AND doc_id % 4 = doc_id % 6 AS deleted FROM documents")
def tagged_delete(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    tag = lambda m: F.concat(F.lit("t"), (F.col("id") % m).cast("string"))
    return shards.delete_tagged(docs.select("id", tag(4).alias("tag")), docs.where("id % 2 = 0").select("id", tag(6).alias("tag")))


@registered(
    sql_with(
        """SELECT file_id, min(chunk_idx) FILTER (ok) AS stable_idx FROM (SELECT *, lead(length, 1) OVER w >= 100 AND lead(length, 1) OVER w < 600 AND lead(length, 2) OVER w >= 100 AND lead(length, 2) OVER w < 600 AS ok
        FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY chunk_idx)) GROUP BY 1""",
        "chunks",
    )
)
def stable_chunk_boundary(spark, sf_dir):
    return ch.stable_boundary(rel.line_chunks(spark, sf_dir), 100, 600)


def _edits(spark, sf_dir):
    sizes = rel.line_chunks(spark, sf_dir).groupBy("file_id").agg(F.sum("length").alias("size"))
    k = sizes.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    start = F.col("file_id") * 31 % 500 + F.col("k") * 400
    return k.select("file_id", start.alias("start"), (start + F.col("file_id") * 17 % 450).alias("end"), (F.col("file_id") * 13 % 200).alias("new_length")), sizes


EDITS = """sizes AS (SELECT file_id, CAST(sum(length) AS BIGINT) AS size FROM chunks GROUP BY 1),
    ed AS (SELECT file_id, file_id * 31 % 500 + k * 400 AS s, file_id * 31 % 500 + k * 400 + file_id * 17 % 450 AS e, file_id * 13 % 200 AS new_length FROM sizes, (VALUES (0), (1), (2)) v(k))"""


@registered(
    sql_with(
        """SELECT file_id, bool_and(ok) AS valid, CAST(CASE WHEN bool_and(ok) THEN max(size) + sum(new_length) - sum(e - s) END AS BIGINT) AS new_size FROM
        (SELECT *, s <= e AND e <= size AND s >= coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s, e), 0) AS ok FROM ed JOIN sizes USING (file_id)) GROUP BY 1""",
        "chunks",
        extra=EDITS,
    )
)
def edit_validate_and_size(spark, sf_dir):
    return edits.validated(*_edits(spark, sf_dir))


def _spans(segs):
    before = Window.partitionBy("file_id").orderBy("seg_idx")
    at = F.sum("bytes").over(before)
    return segs.select("file_id", "seg_idx", (at - F.col("bytes")).alias("seg_start"), at.alias("seg_end")).where("seg_start < seg_end")


SPANS = """spans AS (SELECT file_id, seg_idx, u - bytes AS seg_start, u AS seg_end FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY file_id ORDER BY seg_idx) AS BIGINT) AS u FROM segments) WHERE bytes > 0),
    wide AS (SELECT ed.file_id, coalesce(max(seg_start) FILTER (seg_start <= s), s) AS ws, coalesce(min(seg_end) FILTER (seg_end >= e), e) AS we FROM ed JOIN spans USING (file_id) GROUP BY ed.file_id, s, e),
    win AS (SELECT file_id, min(ws) AS start_, max(we) AS end_, count(*) AS n_edits FROM (SELECT *, max(CASE WHEN ws > reach OR reach IS NULL THEN ws END) OVER (PARTITION BY file_id ORDER BY ws) AS isl FROM
        (SELECT *, max(we) OVER (PARTITION BY file_id ORDER BY ws RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide)) GROUP BY file_id, isl)"""


@registered(sql_with("SELECT file_id, start_ AS start, end_ AS end, n_edits FROM win", "segments", extra=EDITS + ", " + SPANS))
def edit_snap_windows(spark, sf_dir):
    return edits.snapped(_edits(spark, sf_dir)[0], _spans(rel.segments(spark, sf_dir)[0]))


@registered(sql_with("SELECT file_id, seg_idx, seg_start, seg_end FROM spans p WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.file_id = p.file_id AND p.seg_start < w.end_ AND w.start_ < p.seg_end)", "segments", extra=EDITS + ", " + SPANS))
def stable_segments(spark, sf_dir):
    spans = _spans(rel.segments(spark, sf_dir)[0])
    return edits.untouched(spans, edits.snapped(_edits(spark, sf_dir)[0], spans))


def _blocks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))


# all bytes of all texts, as rows
BYTES = """hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), by_ AS (SELECT doc_id, i % 4 AS lane, CAST(bit_count(CAST('0x' || substr(h, i * 2 + 1, 2) AS BIGINT)) AS BIGINT) AS bits FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM hx)),
    hist AS (SELECT doc_id, lane, bits, count(*) AS n FROM by_ GROUP BY 1, 2, 3)"""
LANES = """base AS (SELECT doc_id, bits, sum(n) + 1 AS base_n FROM hist GROUP BY 1, 2), tot AS (SELECT doc_id, sum(n) AS base_total FROM hist GROUP BY 1), lan AS (SELECT doc_id, lane, sum(n) AS lane_total FROM hist GROUP BY 1, 2),
    kl AS (SELECT h.doc_id, h.lane, -sum((n / lane_total) * log2(n / lane_total)) AS entropy, CASE WHEN count(*) = 9 THEN sum((n / lane_total) * ln((n / lane_total) / (base_n / base_total))) END AS divergence
    FROM hist h JOIN base USING (doc_id, bits) JOIN tot USING (doc_id) JOIN lan l ON l.doc_id = h.doc_id AND l.lane = h.lane GROUP BY 1, 2)"""


@registered(f"WITH {BYTES} SELECT * FROM hist")
def byte_popcount_histogram(spark, sf_dir):
    return bytegroups.popcount_histogram(_blocks(spark, sf_dir), "doc_id", "data")


@registered(f"WITH {BYTES}, {LANES} SELECT doc_id, lane, round(entropy, 6) AS entropy, round(divergence, 6) AS divergence FROM kl")
def lane_entropy_divergence(spark, sf_dir):
    d = bytegroups.lane_divergence(bytegroups.popcount_histogram(_blocks(spark, sf_dir), "doc_id", "data"), "doc_id")
    return d.select("doc_id", "lane", F.round("entropy", 6).alias("entropy"), F.round("divergence", 6).alias("divergence"))


@registered(f"WITH {BYTES}, {LANES} SELECT doc_id, round(greatest(coalesce(max(divergence), 0), 0), 6) AS max_divergence, greatest(coalesce(max(divergence), 0), 0) > 0.02 AS recommended FROM kl GROUP BY 1")
def byte_planes_recommended(spark, sf_dir):
    d = bytegroups.lane_divergence(bytegroups.popcount_histogram(_blocks(spark, sf_dir), "doc_id", "data"), "doc_id")
    return bytegroups.planes_recommended(d, "doc_id").withColumn("max_divergence", F.round("max_divergence", 6))


@registered(
    """WITH hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, from_hex(string_agg(substr(h, i * 2 + 1, 2), '' ORDER BY i % 4, i)) AS planes FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM hx) GROUP BY 1)
    SELECT doc_id, sha256(coalesce(planes, from_hex(''))) AS planes_sha256, sha256(coalesce(text, '')) AS sha256 FROM documents LEFT JOIN p USING (doc_id)"""
)
def byte_planes_roundtrip(spark, sf_dir):
    """Digests of each text's byte planes, and of what comes back from them."""
    planes = _blocks(spark, sf_dir).withColumn("p", bytegroups.byte_planes("data"))
    return planes.select("doc_id", F.sha2("p", 256).alias("planes_sha256"), F.sha2(bytegroups.from_byte_planes("p"), 256).alias("sha256"))


@registered("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def lz4_roundtrip(spark, sf_dir):
    size = F.octet_length("data")
    packed = _blocks(spark, sf_dir).select("doc_id", size.alias("n"), bytegroups.lz4_frame(bytegroups.byte_planes("data")).alias("z"))
    return packed.select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.sha2(bytegroups.from_byte_planes(bytegroups.lz4_unframe("z", F.col("n"))), 256).alias("sha256"))


@registered(
    sql_with(
        "SELECT container_hash, chunk_idx, CASE WHEN max_divergence > 0.02 THEN 2 ELSE 1 END AS scheme FROM windows LEFT JOIN worst ON worst.doc_id = decided_by",
        "placed",
        extra=f"""windows AS (SELECT container_hash, chunk_idx, first_value(chunk_hash) OVER (PARTITION BY container_hash, chunk_idx // 32 ORDER BY chunk_idx) AS decided_by FROM placed),
        decided AS (SELECT DISTINCT sha256(line) AS doc_id, line AS text FROM (SELECT unnest(l) AS line FROM lines) WHERE sha256(line) IN (SELECT decided_by FROM windows)),
        {BYTES.replace("FROM documents", "FROM decided")}, {LANES}, worst AS (SELECT doc_id, greatest(coalesce(max(divergence), 0), 0) AS max_divergence FROM kl GROUP BY 1)""",
    )
)
def chunk_schemes(spark, sf_dir):
    """The scheme of each container chunk under ``auto``: that of the first of its 32."""
    windows = packing.retest_windows(rel.store(spark, sf_dir)[2]).select("container_hash", "chunk_idx", "decided_by")
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct().select(F.sha2("line", 256).alias("decided_by"), F.encode("line", "utf-8").alias("data"))
    decided = lines.join(windows.select("decided_by").distinct(), "decided_by", "left_semi")
    told = bytegroups.planes_recommended(bytegroups.lane_divergence(bytegroups.popcount_histogram(decided, "decided_by", "data"), "decided_by"), "decided_by")
    return windows.join(told, "decided_by", "left").select("container_hash", "chunk_idx", payloads.chosen_scheme(F.lit("auto"), F.coalesce("recommended", F.lit(False))).alias("scheme"))


@registered(sql_with("SELECT container_hash, chunk_idx, first_value(chunk_hash) OVER (PARTITION BY container_hash, chunk_idx // 32 ORDER BY chunk_idx) AS decided_by FROM placed", "placed"))
def compression_retest_windows(spark, sf_dir):
    return packing.retest_windows(rel.store(spark, sf_dir)[2]).select("container_hash", "chunk_idx", "decided_by")


@registered(
    "WITH RECURSIVE "
    + catalog_store.CONTENT_CUTS
    + f""", piece AS (SELECT file_id, chunk_idx, stop - start AS length, sha256(unhex(substr(hex(encode(text)), 2 * start + 1, 2 * (stop - start)))) AS chunk_hash FROM cut JOIN documents ON doc_id = file_id WHERE chunk_idx >= 0),
    flagged AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY file_id, chunk_idx) = 1 AS is_new FROM piece)
    SELECT source, {METRICS_SQL} FROM flagged JOIN documents ON doc_id = file_id GROUP BY source"""
)
def content_chunk_stats(spark, sf_dir):
    """Content-defined chunks of all texts at a 1 KiB target: counts, bytes and what dedup saves, by source."""
    docs = read(spark, sf_dir, "documents")
    chunks = written(ch.content_chunks(_blocks(spark, sf_dir).withColumnRenamed("doc_id", "file_id"), ChunkSpec(target=1024)), "content-chunks")
    return dedup.dedup_totals(chunks, docs.select(F.col("doc_id").alias("file_id"), "source"), "source")


@registered()
def merkle_file_hash(spark, sf_dir):
    """Container, file and range hash of each document's list of line chunks."""
    return merkle.merkle_hashes(rel.line_chunks(spark, sf_dir))


@registered("SELECT doc_id AS file_id, true AS equal FROM documents")
def merkle_partial_equals_full(spark, sf_dir):
    """File hashes merged from parts of 64 chunks, next to those of whole lists."""
    chunks = rel.line_chunks(spark, sf_dir)
    whole = merkle.merkle_hashes(chunks, ranges=False).select("file_id", F.col("file_hash").alias("h"))
    return whole.join(merkle_partial.merkle_hashes_of_parts(chunks, 64), "file_id", "left").select("file_id", (F.col("h") == F.col("file_hash")).alias("equal"))


def _millis(ts):
    """Of a timestamp without zone, in a session whose zone is UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _samples(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), _millis("ts").alias("ts_ms"), "value", "event_type", "props", "event_id")


SAMPLES = "s AS (SELECT user_id AS client_id, epoch_us(ts) // 1000 AS ts_ms, value, event_type, props, event_id FROM events)"
ASOF = """l AS (SELECT client_id, ts_ms, max(value) AS value FROM s GROUP BY 1, 2), e AS (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1 FROM l), c AS (SELECT client_id, max(ts_ms) AS stop FROM l GROUP BY 1),
    g AS (SELECT unnest(range(t0, t1 + 1, 3600000)) AS grid_ms FROM e),
    r AS (SELECT x.client_id, x.grid_ms, l.value, x.grid_ms <= x.stop AS active FROM (SELECT c.client_id, c.stop, g.grid_ms FROM c, g) x ASOF JOIN l ON l.client_id = x.client_id AND l.ts_ms <= x.grid_ms)"""


@registered(f"WITH {SAMPLES}, {ASOF} SELECT client_id, grid_ms, value, active FROM r")
def timeline_resample_asof(spark, sf_dir):
    return metrics.resample(_samples(spark, sf_dir), 3_600_000)


@registered(f"WITH {SAMPLES}, {ASOF} SELECT grid_ms, count(*) AS n_clients, count(*) FILTER (active) AS n_active, CAST(sum(micros) / 1000000 AS DOUBLE) AS total_value, coalesce(CAST(sum(micros) FILTER (active) AS DOUBLE) / 1000000 / count(*) FILTER (active), 0) AS mean_active FROM (SELECT *, CAST(round(value * 1000000) AS BIGINT) AS micros FROM r) GROUP BY 1")
def timeline_summary(spark, sf_dir):
    """Sums are of whole millionths, so that they don't depend on the order of the rows."""
    r = metrics.resample(_samples(spark, sf_dir), 3_600_000).withColumn("micros", F.round(F.col("value") * 1_000_000).cast("long"))
    on = F.when(F.col("active"), F.col("micros"))
    sums = r.groupBy("grid_ms").agg(F.count("*").alias("n_clients"), F.count(on).alias("n_active"), F.sum("micros").alias("t"), F.sum(on).alias("a"))
    return sums.select("grid_ms", "n_clients", "n_active", (F.col("t") / 1_000_000).alias("total_value"), F.coalesce(F.col("a") / 1_000_000 / F.nullif("n_active", F.lit(0)), F.lit(0.0)).alias("mean_active"))


def _ewma_sql(half_life):
    return f"""WITH {SAMPLES} SELECT x.event_id, round(sum(y.value * pow(2.0, (y.ts_ms - x.ts_ms) / {half_life}.0)) / sum(pow(2.0, (y.ts_ms - x.ts_ms) / {half_life}.0)), 5) AS ewma
    FROM s x LEFT JOIN s y ON y.client_id = x.client_id AND y.ts_ms <= x.ts_ms AND y.value IS NOT NULL GROUP BY 1"""


@registered(_ewma_sql(21_600_000))
def ewma_rate(spark, sf_dir):
    return metrics.ewma_whole(_samples(spark, sf_dir), "client_id", "ts_ms", "value", 21_600_000).select("event_id", F.round("ewma", 5).alias("ewma"))


@registered(_ewma_sql(3_600_000))
def ewma_rate_whole(spark, sf_dir):
    """With a half-life of an hour, of which a client's samples lie many apart."""
    return metrics.ewma_whole(_samples(spark, sf_dir), "client_id", "ts_ms", "value", 3_600_000).select("event_id", F.round("ewma", 5).alias("ewma"))


@registered(
    f"""WITH {SAMPLES}, t AS (SELECT client_id, ts_ms, ts_ms % 86400000 AS total FROM s GROUP BY 1, 2),
    d AS (SELECT *, row_number() OVER w AS n, greatest(total - coalesce(lag(total) OVER w, 0), 0) AS delta, coalesce(ts_ms - lag(ts_ms) OVER w, 21600000) AS elapsed FROM t WINDOW w AS (PARTITION BY client_id ORDER BY ts_ms))
    SELECT x.client_id, x.ts_ms, x.n, CASE WHEN x.n >= 4 THEN round(sum(y.delta * pow(2.0, (y.ts_ms - x.ts_ms) / 21600000.0)) / sum(y.elapsed * pow(2.0, (y.ts_ms - x.ts_ms) / 21600000.0)), 6) END AS rate
    FROM d x JOIN d y ON y.client_id = x.client_id AND y.ts_ms <= x.ts_ms GROUP BY 1, 2, 3"""
)
def client_speeds(spark, sf_dir):
    """Speed of a counter that starts again each day: the time of day."""
    counters = _samples(spark, sf_dir).withColumn("total", F.col("ts_ms") % 86_400_000)
    return metrics.speeds(counters, "client_id", "ts_ms", "total", 21_600_000).select("client_id", "ts_ms", "n", F.round("rate", 6).alias("rate"))


@registered(
    f"""WITH {SAMPLES}, p AS (SELECT client_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y, pow(2.0, -(row_number() OVER (PARTITION BY client_id ORDER BY event_id DESC) - 1) / 20.0) AS w FROM s),
    m AS (SELECT client_id, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM p GROUP BY 1),
    b AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) AS intercept FROM m)
    SELECT client_id, n, round(sw, 5) AS weight, round(intercept, 5) AS intercept, round(slope, 5) AS slope, round(intercept + slope * 10, 5) AS mean_at,
    round(CASE WHEN sw > 2 THEN sqrt(greatest(greatest((syy - intercept * sy - slope * sxy) / (sw - 2), 0) * (sxx - 20 * sx + sw * 100) / (sw * sxx - sx * sx), 0)) END, 5) AS se_at FROM b"""
)
def ew_linear_regression(spark, sf_dir):
    points = _samples(spark, sf_dir).select("client_id", "event_id", F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"))
    fit = metrics.ew_regression(points, "client_id", "event_id", 20, 10.0)
    return fit.select("client_id", "n", *(F.round(c, 5).alias(c) for c in ("weight", "intercept", "slope", "mean_at", "se_at")))


@registered(f"WITH {SAMPLES} SELECT event_id, ts_ms % 10000 AS phase_ms, CASE WHEN ts_ms % 10000 < 4000 THEN 0.25 ELSE 1.0 END::DOUBLE AS factor FROM s")
def congestion_cycle(spark, sf_dir):
    return metrics.congestion(_samples(spark, sf_dir), "ts_ms", 4000, 6000, 0.25).select("event_id", "phase_ms", "factor")


STAGE_SQL = "CASE event_type WHEN 'view' THEN 'validating' WHEN 'click' THEN 'committing' WHEN 'purchase' THEN 'result' END"


SHARD_EVENTS = """ev AS (SELECT event_id // 6 AS shard_id, (event_id * 7) % 11 AS seq, ['validating', 'uploading', 'syncing', 'result', 'unknown', 'validating', 'validating'][event_id * event_id % 7 + 1] AS stage, event_id * 13 % 40 AS verified, event_id * 29 % 60 AS total FROM events)"""


# one event of a shard after the other
@registered(
    f"""WITH RECURSIVE {SHARD_EVENTS},
    q AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS rn, CASE stage WHEN 'uploading' THEN 1 WHEN 'syncing' THEN 2 WHEN 'result' THEN 3 ELSE 0 END AS r FROM ev),
    f AS (SELECT DISTINCT shard_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS t, 0 AS at_, CAST(0 AS BIGINT) AS credited, CAST(0 AS BIGINT) AS stored, CAST(0 AS BIGINT) AS synced FROM ev
        UNION ALL SELECT f.shard_id, q.rn, CASE WHEN q.stage = 'validating' AND at_ = 0 THEN f.v + greatest(q.verified - f.v, 0) ELSE f.v END, CASE WHEN q.stage = 'validating' AND at_ = 0 THEN f.t + greatest(q.total - f.t, 0) ELSE f.t END,
            greatest(at_, q.r), CASE WHEN q.r > 0 AND at_ = 0 THEN greatest(f.t - f.v, 0) ELSE f.credited END, CASE WHEN q.r >= 2 AND at_ < 2 THEN f.stored + 1 ELSE f.stored END, CASE WHEN q.r = 3 AND at_ < 3 THEN f.synced + 1 ELSE f.synced END
        FROM f JOIN q ON q.shard_id = f.shard_id AND q.rn = f.rn + 1)
    SELECT shard_id, ['validating', 'uploading', 'syncing', 'result'][at_ + 1] AS stage, t AS total, v + credited AS completed, stored, synced FROM f QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY rn DESC) = 1"""
)
def shard_upload_progress(spark, sf_dir):
    """Six events a shard, out of order: counters that move forward only, with what skipped stages are credited."""
    e, kinds = F.col("event_id"), ("validating", "uploading", "syncing", "result", "unknown", "validating", "validating")
    stage = F.get(F.array(*map(F.lit, kinds)), (e * e % 7).cast("int"))
    events = read(spark, sf_dir, "events").select(F.floor(e / 6).alias("shard_id"), (e * 7 % 11).alias("seq"), stage.alias("stage"), (e * 13 % 40).alias("verified"), (e * 29 % 60).alias("total"))
    return metrics.credited_progress(events)


@registered(
    f"""WITH e AS (SELECT event_id // 10 AS upload_id, {STAGE_SQL} AS stage, CAST(floor(value) AS BIGINT) AS verified FROM events)
    SELECT upload_id, CASE max(CASE stage WHEN 'validating' THEN 1 WHEN 'committing' THEN 2 WHEN 'result' THEN 3 END) WHEN 1 THEN 'validating' WHEN 2 THEN 'committing' WHEN 3 THEN 'result' END AS stage, coalesce(max(verified), 0) AS verified, count(*) AS n_events FROM e GROUP BY 1"""
)
def shard_event_progress(spark, sf_dir):
    stage = F.create_map(*map(F.lit, ("view", "validating", "click", "committing", "purchase", "result")))[F.col("event_type")]
    ev = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("upload_id"), stage.alias("stage"), F.floor("value").alias("verified"))
    return metrics.latest_stage(ev, "upload_id")


@registered(
    sql_with(
        """SELECT file_id, CAST(sum(done) AS BIGINT) AS completed_bytes, CAST(sum(n) AS BIGINT) AS total_bytes, bool_and(done = n) AS complete FROM
        (SELECT file_id, n, CASE WHEN ext THEN n ELSE CAST(floor(n * coalesce(ratio, 0)) AS BIGINT) END AS done FROM (SELECT file_id, container_hash, CAST(sum(bytes) AS BIGINT) AS n, file_id % 9 = 0 AS ext FROM segments GROUP BY 1, 2)
        LEFT JOIN (SELECT container_hash, bin % 5 / 4.0 AS ratio FROM named WHERE grp % 4 <> 3) USING (container_hash)) GROUP BY 1""",
        "segments",
    )
)
def upload_progress_rollup(spark, sf_dir):
    chunks, named, placed = rel.store(spark, sf_dir)
    deps = packing.segments(chunks, placed).groupBy("file_id", "container_hash").agg(F.sum("bytes").alias("n_bytes")).withColumn("is_external", F.col("file_id") % 9 == 0)
    return metrics.upload_rollup(deps, named.where("grp % 4 <> 3").select("container_hash", (F.col("bin") % 5 / 4.0).alias("ratio")))


@registered(
    """WITH t AS (SELECT event_id // 50 AS transfer_id, value, epoch_us(ts) // 1000 AS ms, event_id % 97 = 0 AS gone, CASE event_id % 11 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 418 END AS status, CASE event_id % 7 WHEN 1 THEN 'timeout' WHEN 2 THEN 'network' END AS transport FROM events)
    SELECT transfer_id, CASE WHEN gone THEN 'cancelled' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' WHEN status = 404 THEN 'not_found' WHEN transport IS NOT NULL THEN transport WHEN status >= 400 THEN 'other' ELSE 'ok' END AS outcome,
    count(*) AS n, coalesce(CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS DOUBLE) / nullif(max(ms) - min(ms), 0) / 1000, 0) AS value_per_s FROM t GROUP BY 1, 2"""
)
def transfer_telemetry(spark, sf_dir):
    k, seven = F.col("event_id") % 11, F.col("event_id") % 7
    status = F.when(k == 1, 429).when(k == 2, 503).when(k == 3, 404).when(k == 4, 418)
    ev = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("transfer_id"), "value", _millis("ts").alias("ms"), metrics.outcome(status, F.when(seven == 1, "timeout").when(seven == 2, "network"), F.col("event_id") % 97 == 0).alias("outcome"))
    whole = F.sum(F.round(F.col("value") * 1_000_000).cast("long"))  # millionths, so that the sum is exact
    return ev.groupBy("transfer_id", "outcome").agg(F.count("*").alias("n"), (metrics.rate(whole, F.max("ms") - F.min("ms")) / 1000).alias("value_per_s"))


RAW = " || ".join(f"substr(chunk_hash, {16 * w + 2 * b + 1}, 2)" for w in range(4) for b in reversed(range(8)))


@registered(sql_with(f"SELECT chunk_hash, substr(chunk_hash, 1, 16) AS truncated, CAST('0x' || right(chunk_hash, 3) AS BIGINT) % 1024 AS low_bits, {RAW} AS raw_hex, chunk_hash AS from_base64 FROM firsts", "firsts"))
def hash_text_forms(spark, sf_dir):
    h = dedup.first_locations(rel.line_chunks(spark, sf_dir)).select("chunk_hash")
    return h.select("chunk_hash", hashes.truncated("chunk_hash").alias("truncated"), hashes.low_bits("chunk_hash", 1024).alias("low_bits"), F.lower(F.hex(hashes.to_raw("chunk_hash"))).alias("raw_hex"), hashes.from_base64(hashes.to_base64("chunk_hash")).alias("from_base64"))


@registered(sql_with("SELECT query_id, 'bytes=' || start_ || '-' || (end_ - 1) AS header, start_ AS parsed_start, end_ AS parsed_end FROM requests", "requests"))
def range_header_forms(spark, sf_dir):
    asked = rel.requests(rel.segments(spark, sf_dir)[0]).withColumn("header", digests.http_range(F.col("start"), F.col("end")))
    return asked.select("query_id", "header", digests.parsed_range("header")["start"].alias("parsed_start"), digests.parsed_range("header")["end"].alias("parsed_end"))


@registered("SELECT page_id, regexp_extract(url, '^(.*)/', 1) AS prefix, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages")
def key_split(spark, sf_dir):
    k = digests.split_key("url")
    return read(spark, sf_dir, "pages").select("page_id", k["prefix"].alias("prefix"), k["hash"].alias("last"))


@registered("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN repeat('ab', 32) ELSE sha256(text) END END AS sha256 FROM documents")
def sha256_policy(spark, sf_dir):
    provided = F.when(F.col("doc_id") % 3 == 0, F.lit("AB" * 32)).when(F.col("doc_id") % 3 == 1, F.lit("not a hash"))
    return read(spark, sf_dir, "documents").select("doc_id", digests.chosen_sha256(F.col("text").cast("binary"), provided, F.col("doc_id") % 5 == 0).alias("sha256"))


@registered("SELECT doc_id, s AS start, least(s + 1000, n) AS end FROM (SELECT doc_id, n, unnest(range(0, n, 1000)) AS s FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents))")
def fixed_range_segments(spark, sf_dir):
    whole = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))
    return intervals.fixed_segments(whole, 1000)


@registered("SELECT upload_id, CASE WHEN max(strlen(line)) > 60 THEN 'frame_too_long' ELSE arg_max(event_type, event_id) END AS type, max(strlen(line)) <= 60 AND arg_max(event_type, event_id) = 'result' AS ok FROM (SELECT event_id // 7 AS upload_id, event_id, event_type, '{\"type\":\"' || event_type || '\",\"k\":\"' || repeat('x', event_id % 40) || '\"}' AS line FROM events) GROUP BY 1")
def upload_outcomes(spark, sf_dir):
    line = F.to_json(F.struct(F.col("event_type").alias("type"), F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int")).alias("k")))
    frames = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 7).alias("upload_id"), F.col("event_id").alias("seq"), line.alias("line"))
    return store.upload_outcomes(frames, 60)


@registered(sql_with("SELECT container_hash, chunk_idx, CAST(length AS BIGINT) AS length, chunk_hash AS sha256 FROM placed", "placed"))
def payload_roundtrip(spark, sf_dir):
    """Sizes and digests of chunks whose containers were encoded and decoded again."""
    placed = rel.store(spark, sf_dir)[2]
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct().select(F.sha2("line", 256).alias("chunk_hash"), F.encode("line", "utf-8").alias("data"))
    back = payloads.decode_containers(payloads.encode_containers(placed.join(lines, "chunk_hash"), payloads.PLANES))
    return back.select("container_hash", "chunk_idx", "length", F.sha2("data", 256).alias("sha256"))


WINDOWS = (
    EDITS
    + """, at_ AS (SELECT *, sum(length) OVER w - length AS byte_start, length >= 100 AND length < 600 AND lead(length) OVER w >= 100 AND lead(length) OVER w < 600 AS settled FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY chunk_idx)),
        st AS (SELECT *, coalesce(min(CASE WHEN settled THEN chunk_idx + 2 END) OVER f, max(chunk_idx) OVER f + 1) AS stop FROM at_ WINDOW f AS (PARTITION BY file_id ORDER BY chunk_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        nx AS (SELECT *, coalesce(lead(stop) OVER (PARTITION BY file_id ORDER BY chunk_idx), chunk_idx + 1) AS next_stop FROM st),
        one AS (SELECT ed.file_id, min(chunk_idx) AS a, max_by(next_stop, chunk_idx) AS b FROM ed JOIN nx ON nx.file_id = ed.file_id AND s < byte_start + length AND byte_start < greatest(e, s + 1) GROUP BY ed.file_id, s, e),
        win AS (SELECT file_id, min(a) AS start_chunk, max(b) AS end_chunk FROM (SELECT *, max(CASE WHEN a > reach OR reach IS NULL THEN a END) OVER (PARTITION BY file_id ORDER BY a) AS isl FROM
        (SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one)) GROUP BY file_id, isl)"""
)


@registered(sql_with("SELECT * FROM win", "chunks", extra=WINDOWS))
def edit_windows_to_recut(spark, sf_dir):
    chunks = ch.running_offsets(rel.line_chunks(spark, sf_dir), "file_id", "chunk_idx", "length")
    return sessions.edit_windows(chunks, _edits(spark, sf_dir)[0].select("file_id", "start", "end"), 100, 600)


@registered(
    sql_with(
        """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS seg_idx, container_hash, chunk_start, chunk_end, bytes FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)""",
        "located",
        extra=WINDOWS
        + """, c AS (SELECT file_id, chunk_idx, length, container_hash, at_, sum(begins) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS sg FROM located WHERE file_id IN (SELECT file_id FROM win)),
        out_ AS (SELECT c.*, (SELECT count(*) FROM win WHERE win.file_id = c.file_id AND win.end_chunk <= c.chunk_idx) AS gap FROM c WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.file_id = c.file_id AND c.chunk_idx >= win.start_chunk AND c.chunk_idx < win.end_chunk)),
        old AS (SELECT file_id, min(chunk_idx) AS pos, min(container_hash) AS container_hash, min(at_) AS chunk_start, max(at_) + 1 AS chunk_end, CAST(sum(length) AS BIGINT) AS bytes FROM out_ GROUP BY file_id, sg, gap),
        fresh AS (SELECT win.file_id, win.start_chunk AS pos, 'new' AS container_hash, win.start_chunk AS chunk_start, win.end_chunk AS chunk_end, CAST(sum(length) AS BIGINT) AS bytes FROM win JOIN chunks c ON c.file_id = win.file_id AND c.chunk_idx >= win.start_chunk AND c.chunk_idx < win.end_chunk GROUP BY ALL)""",
    )
)
def edit_segments_spliced(spark, sf_dir):
    """Segments of edited files: those outside the windows taken over, cut at the windows' chunks, one new segment a window."""
    segs, placed = rel.segments(spark, sf_dir)
    asked = _edits(spark, sf_dir)[0].select("file_id", "start", "end")
    own = segs.join(asked.select("file_id").distinct(), "file_id", "left_semi")
    chunks = written(edits.stored_chunks(own, placed), "stored-chunks")
    windows = written(sessions.edit_windows(chunks, asked, 100, 600), "edit-windows")
    size = chunks.join(windows, "file_id").where("chunk_idx >= start_chunk and chunk_idx < end_chunk").groupBy("file_id", "start_chunk", "end_chunk").agg(F.sum("length").alias("bytes"))
    made = size.select("file_id", "start_chunk", F.lit(0).alias("seg_idx"), F.lit("new").alias("container_hash"), F.col("start_chunk").alias("chunk_start"), F.col("end_chunk").alias("chunk_end"), "bytes")
    return edits.composed(own, placed, windows, made)


@registered()
def keyed_chunk_export(spark, sf_dir):
    """Container chunks with their hashes under a key, in order of the keyed hash."""
    placed = rel.store(spark, sf_dir)[2]
    return placed.select("container_hash", "chunk_idx", digests.keyed("chunk_hash", "ab" * 32).alias("keyed_hash"), "length").orderBy("keyed_hash")


@registered(
    f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY event_id) AS n FROM s)
    SELECT x.event_id, round(sum(y.value * pow(2.0, (y.n - x.n) / 10.0)) / sum(pow(2.0, (y.n - x.n) / 10.0)), 5) AS ewma FROM n x JOIN n y ON y.client_id = x.client_id AND y.n <= x.n GROUP BY 1"""
)
def ewma_by_count(spark, sf_dir):
    """Decayed by the number of later samples; half weight after 10."""
    return metrics.ewma_by_count(_samples(spark, sf_dir), "client_id", "event_id", "value", 10.0).select("event_id", F.round("ewma", 5).alias("ewma"))


# A23, B14-B16


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@registered(ORACLE_SQL["scenario_summary"])
def scenario_summary_csv(spark, sf_dir):
    """The scenario summary written as CSV and read again."""
    summary, path = QUERIES["scenario_summary"](spark, sf_dir), _folder(spark, "summary-csv")
    store.write_csv(summary, path)
    return spark.read.schema(summary.schema).option("header", "true").csv(path)


@registered(ORACLE_SQL["timeline_summary"])
def timeline_documents(spark, sf_dir):
    """The timeline summary as JSON documents, one a line, and read again as such."""
    summary, path = QUERIES["timeline_summary"](spark, sf_dir), _folder(spark, "summary-json")
    store.as_documents(summary.withColumn("__id", F.lit(0)), "__id").select("document").write.text(path)
    return store.json_lines(spark, path, summary.schema)
