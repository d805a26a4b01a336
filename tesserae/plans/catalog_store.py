"""Queries over the store: sessions, lookups, shards, validation and scalar forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import digests, forms
from tesserae.operators import chunks as ch
from tesserae.operators import dedup, edits, lookup, packing, payloads, reads, reconstruct, sessions, shards
from tesserae.operators.intervals import coalesced
from tesserae.sources import store
from tesserae.sources.shared import shared_dir, written
from tesserae.streaming import flushes

from . import relations as rel
from .registry import registered
from .relations import read, sql_with

# C4 greedy, E5, D5

KNOWN_EVEN = """known AS (SELECT chunk_hash, CAST(file_id AS VARCHAR) AS target, chunk_idx AS target_idx FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY file_id, chunk_idx) AS r FROM chunks WHERE file_id % 2 = 0) WHERE r = 1),
    hit AS (SELECT c.file_id, c.chunk_idx, c.length, k.target, k.target_idx FROM chunks c LEFT JOIN known k USING (chunk_hash) WHERE c.file_id % 2 = 1),
    mark AS (SELECT *, CASE WHEN target IS NOT NULL AND lag(target) OVER w = target AND lag(target_idx) OVER w + 1 = target_idx THEN 0 ELSE 1 END AS begins FROM hit WINDOW w AS (PARTITION BY file_id ORDER BY chunk_idx)),
    run AS (SELECT file_id, rn, min(target) AS target, coalesce(min(target_idx), 0) AS a, count(*) AS n, CAST(sum(length) AS BIGINT) AS size FROM (SELECT *, sum(begins) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS rn FROM mark) GROUP BY 1, 2)"""
# a run after the other: the range it joins or begins, the chunks of the last 8 ranges, whether the bar is high
GREEDY = (
    KNOWN_EVEN
    + """, step AS (SELECT file_id, CAST(0 AS HUGEINT) AS rn, CAST(-1 AS BIGINT) AS seg_idx, CAST(NULL AS VARCHAR) AS target, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS bytes, '' AS decision, CAST([] AS BIGINT[]) AS sizes, false AS strict FROM (SELECT DISTINCT file_id FROM run)
    UNION ALL SELECT file_id, rn, CASE WHEN joins THEN seg_idx ELSE seg_idx + 1 END, target, CASE WHEN joins THEN s ELSE a END, CASE WHEN joins THEN e + n ELSE a + n END, CASE WHEN joins THEN bytes + size ELSE size END, decision,
        CASE WHEN joins THEN list_append(sizes[1:len(sizes) - 1], sizes[len(sizes)] + n) ELSE list_append(sizes, n)[greatest(len(sizes) + 1 - 7, 1):len(sizes) + 1] END, strict FROM
        (SELECT file_id, rn, seg_idx, s, e, bytes, n, size, sizes, CASE WHEN rejected THEN NULL ELSE target END AS target, CASE WHEN rejected THEN 0 ELSE a END AS a, CASE WHEN rejected THEN 'prevented' WHEN target IS NULL THEN 'new' ELSE 'known' END AS decision,
            follows OR (was <> '' AND (target IS NULL OR rejected) AND was = CASE WHEN rejected THEN 'prevented' ELSE 'new' END) AS joins, rejected OR high AS strict FROM
            (SELECT *, held AND n < mean AND mean < CASE WHEN high THEN 3.0 ELSE 1.5 END AS rejected FROM
                (SELECT *, CASE WHEN held THEN strict AND mean < 3.0 ELSE strict END AS high FROM
                    (SELECT r.file_id, r.rn, p.seg_idx, p.s, p.e, p.bytes, r.n, r.size, p.sizes, p.strict, r.target, r.a, p.decision AS was, coalesce(p.target = r.target AND p.e = r.a, false) AS follows,
                        r.target IS NOT NULL AND NOT coalesce(p.target = r.target AND p.e = r.a, false) AND len(p.sizes) = 8 AS held, list_sum(p.sizes) / 8.0 AS mean FROM step p JOIN run r ON r.file_id = p.file_id AND r.rn = p.rn + 1)))))"""
)
GREEDY_ROWS = "greedy AS (SELECT file_id, seg_idx, arg_max(target, rn) FILTER (target IS NOT NULL) AS target, max_by(s, rn) AS chunk_start, max_by(e, rn) AS chunk_end, max_by(bytes, rn) AS bytes, max_by(decision, rn) AS decision FROM step WHERE rn > 0 GROUP BY 1, 2)"


def _greedy(spark, sf_dir):
    chunks = rel.line_chunks(spark, sf_dir)
    known = dedup.first_locations(chunks.where("file_id % 2 = 0")).select("chunk_hash", F.col("file_id").cast("string").alias("target"), F.col("chunk_idx").alias("target_idx"))
    return sessions.greedy_segments(chunks.where("file_id % 2 = 1"), written(known, "known"), window=8, limit=3.0)


@registered(sql_with("SELECT * FROM greedy", "chunks", extra=GREEDY + ", " + GREEDY_ROWS))
def greedy_dedup_segments(spark, sf_dir):
    """Odd files as runs of chunks known from even ones, with fragmentation control over 8 ranges."""
    return _greedy(spark, sf_dir)


def _sums(unit, what):
    return f"""CAST(sum({what}) AS BIGINT) AS total_{unit}, CAST(coalesce(sum({what}) FILTER (decision = 'known'), 0) AS BIGINT) AS deduped_{unit}, CAST(coalesce(sum({what}) FILTER (decision <> 'known'), 0) AS BIGINT) AS new_{unit},
        CAST(coalesce(sum({what}) FILTER (decision = 'known' AND CAST(target AS BIGINT) % 4 = 0), 0) AS BIGINT) AS deduped_{unit}_by_global_dedup, CAST(coalesce(sum({what}) FILTER (decision = 'prevented'), 0) AS BIGINT) AS defrag_prevented_dedup_{unit}"""


@registered(
    sql_with(
        f"""SELECT *, container_bytes_uploaded + shard_bytes_uploaded AS total_bytes_uploaded FROM (SELECT file_id, {_sums("bytes", "bytes")}, {_sums("chunks", "chunk_end - chunk_start")},
        CAST(coalesce(sum(bytes) FILTER (decision <> 'known'), 0) AS BIGINT) AS container_bytes_uploaded, 48 * (1 + count(*)) AS shard_bytes_uploaded FROM greedy GROUP BY 1)""",
        "chunks",
        extra=GREEDY + ", " + GREEDY_ROWS,
    )
)
def session_dedup_metrics(spark, sf_dir):
    """All 13 sums; targets with ids 0 mod 4 are those that the shared index named."""
    segs = written(_greedy(spark, sf_dir), "greedy")
    shared = segs.where("cast(target as long) % 4 = 0").select("target").distinct()
    sent = segs.groupBy("file_id").agg(F.coalesce(F.sum(F.when(F.col("decision") != "known", F.col("bytes"))), F.lit(0)).alias("container_bytes"), (48 * (1 + F.count("*"))).alias("shard_bytes"))
    return sessions.session_metrics(segs, shared, sent)


@registered(
    sql_with(
        """SELECT file_id, bin, min(chunk_idx) AS chunk_start, max(chunk_idx) + 1 AS chunk_end, min(pos) AS pos_start, CAST(sum(length) AS BIGINT) AS bytes FROM
        (SELECT *, chunk_idx - row_number() OVER (PARTITION BY file_id, bin, chunk_idx - pos ORDER BY chunk_idx) AS isl FROM near) GROUP BY file_id, bin, chunk_idx - pos, isl""",
        "packed",
        extra=f"""at_ AS (SELECT c.*, c.file_id // {rel.GROUP} AS grp, p.bin AS open FROM chunks c LEFT JOIN packed p USING (file_id, chunk_idx)),
        now_ AS (SELECT *, last_value(open IGNORE NULLS) OVER (PARTITION BY grp ORDER BY file_id, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM at_),
        near AS (SELECT n.file_id, n.chunk_idx, n.length, p.bin, p.pos FROM now_ n JOIN packed p ON p.grp = n.grp AND p.chunk_hash = n.chunk_hash WHERE n.open IS NULL AND p.bin = n.now)""",
    )
)
def open_container_runs(spark, sf_dir):
    """Runs of chunks that are found in the container which is not yet cut."""
    chunks = rel.line_chunks(spark, sf_dir)
    return dedup.local_runs(chunks, written(rel.packed(chunks), "packed"), rel.GROUP)


@registered(
    sql_with(
        "SELECT file_id, chunk_idx, CASE WHEN chunk_hash IN (SELECT chunk_hash FROM loc) THEN 1 WHEN chunk_hash IN (SELECT chunk_hash FROM learnt) THEN 2 END AS pass FROM chunks WHERE file_id % 3 = 2",
        "chunks",
        extra="""loc AS (SELECT DISTINCT chunk_hash FROM chunks WHERE file_id % 3 = 0), sh AS (SELECT DISTINCT chunk_hash, file_id // 20 AS shard_id FROM chunks WHERE file_id % 3 = 1),
        rows_ AS (SELECT chunk_hash, min(shard_id) AS shard_id FROM sh WHERE right(chunk_hash, 1) IN ('0', '1') GROUP BY 1),
        asked AS (SELECT DISTINCT chunk_hash FROM chunks WHERE file_id % 3 = 2 AND (chunk_idx = 0 OR right(chunk_hash, 1) = '0') AND chunk_hash NOT IN (SELECT chunk_hash FROM loc)),
        learnt AS (SELECT DISTINCT chunk_hash FROM sh WHERE shard_id IN (SELECT shard_id FROM rows_ WHERE chunk_hash IN (SELECT chunk_hash FROM asked)))""",
    )
)
def two_pass_dedup(spark, sf_dir):
    """Files 2 mod 3 against a local index (0 mod 3), then with the shards (1 mod 3) that the shared index names for eligible chunks."""
    from tesserae.functions import hashes

    chunks = rel.line_chunks(spark, sf_dir)
    in_shards = chunks.where("file_id % 3 = 1").select("chunk_hash", F.floor(F.col("file_id") / 20).alias("shard_id")).distinct()
    rows = in_shards.where(F.right("chunk_hash", F.lit(1)).isin("0", "1")).groupBy("chunk_hash").agg(F.min("shard_id").alias("shard_id"))
    found, _ = dedup.two_pass(chunks.where("file_id % 3 = 2"), chunks.where("file_id % 3 = 0"), rows, in_shards, hashes.dedup_eligible("chunk_hash", 16))
    return found.select("file_id", "chunk_idx", "pass")


@registered(
    sql_with(
        "SELECT file_id, chunk_idx, CASE WHEN chunk_hash IN (SELECT chunk_hash FROM chunks WHERE file_id % 5 = 0) THEN 'open' WHEN sha256('k1' || chunk_hash) IN (SELECT h FROM k1) THEN 'first' WHEN sha256('k2' || chunk_hash) IN (SELECT h FROM k2) THEN 'second' END AS layer FROM chunks WHERE file_id % 5 = 4",
        "chunks",
        extra="k1 AS (SELECT sha256('k1' || chunk_hash) AS h FROM chunks WHERE file_id % 5 = 1), k2 AS (SELECT sha256('k2' || chunk_hash) AS h FROM chunks WHERE file_id % 5 = 2)",
    )
)
def keyed_collections_lookup(spark, sf_dir):
    """Collections without a key first, then each under its own."""
    chunks = rel.line_chunks(spark, sf_dir)
    under = lambda key: lambda h: F.sha2(F.concat(F.lit(key), h), 256)
    kept = lambda m, key: chunks.where(f"file_id % 5 = {m}").select(under(key)(F.col("chunk_hash")).alias("chunk_hash"))
    layers = [("open", chunks.where("file_id % 5 = 0"), None), ("first", kept(1, "k1"), under("k1")), ("second", kept(2, "k2"), under("k2"))]
    return dedup.keyed_lookup(chunks.where("file_id % 5 = 4"), layers).select("file_id", "chunk_idx", "layer")


# C7, C9, C11, C12, C17, M3

STARTS = "starts AS (SELECT DISTINCT container_hash, chunk_start AS chunk_idx FROM segments WHERE seg_idx = 0)"


@registered(sql_with("SELECT container_hash, chunk_idx, chunk_hash FROM placed JOIN starts USING (container_hash, chunk_idx)", "segments", extra=STARTS))
def file_start_chunks(spark, sf_dir):
    return dedup.file_starts(*rel.segments(spark, sf_dir))


@registered(sql_with("SELECT p.container_hash, p.chunk_idx, p.chunk_hash, CASE WHEN s.chunk_idx IS NULL THEN 0 ELSE 2147483648 END AS flags FROM placed p LEFT JOIN starts s USING (container_hash, chunk_idx) WHERE left(p.container_hash, 1) < '8'", "segments", extra=STARTS))
def minimal_shard_rows(spark, sf_dir):
    segs, placed = rel.segments(spark, sf_dir)
    return shards.minimal_rows(placed, dedup.file_starts(segs, placed), F.left("container_hash", F.lit(1)) < "8")


@registered(sql_with("SELECT container_hash, count(*) AS n_ranges, string_agg(byte_start || '-' || (byte_end - 1), ',' ORDER BY query_id, chunk_start) AS byte_ranges FROM fetches WHERE query_id % 3 <> 0 GROUP BY 1", "fetches"))
def reconstruct_batch(spark, sf_dir):
    """A batch in which every third id is unknown."""
    segs, placed = rel.segments(spark, sf_dir)
    asked = rel.requests(segs)
    found = reconstruct.fetch_ranges(written(reconstruct.terms(asked, segs, placed), "terms"), placed)
    return reconstruct.batch_fetches(asked, segs.where("file_id % 3 <> 0"), found)


DEDUP_ROWS = "rows_ AS (SELECT chunk_hash, CAST('0x' || right(chunk_hash, 3) AS BIGINT) % 80 AS shard_id FROM placed WHERE chunk_idx = 0)"


@registered(sql_with("SELECT chunk_hash, shard_id, n_chunks * 48 AS size, CAST(1600 AS BIGINT) AS expires FROM rows_ JOIN shards USING (shard_id) WHERE chunk_hash IN (SELECT chunk_hash FROM chunks WHERE chunk_idx = 0 OR right(chunk_hash, 1) = '0')", "placed", "shards", extra=DEDUP_ROWS))
def shared_index_answers(spark, sf_dir):
    """The shard that the shared index names for each eligible chunk, without its files, for another 600 seconds."""
    from tesserae.functions import hashes

    chunks, _, placed = rel.store(spark, sf_dir)
    rows = placed.where("chunk_idx = 0").select("chunk_hash", (F.conv(F.right("chunk_hash", F.lit(3)), 16, 10).cast("long") % 80).alias("shard_id"))
    return shards.dedup_answers(dedup.eligible_chunks(chunks, hashes.dedup_eligible("chunk_hash", 16)), rows, rel.synthetic_shards(chunks), now=1000, valid_for=600)


@registered(sql_with("SELECT file_id, shard_id, size FROM (SELECT DISTINCT file_id, file_id // 20 AS shard_id FROM chunks WHERE file_id % 5 <> 0) JOIN shards USING (shard_id) WHERE shard_id % 4 <> 1", "shards"))
def delete_shards(spark, sf_dir):
    """Files and their shards after every fourth shard is deleted; a file without its row is deleted."""
    chunks = rel.line_chunks(spark, sf_dir)
    files = chunks.where("file_id % 5 <> 0").select("file_id", F.floor(F.col("file_id") / 20).alias("shard_id")).distinct()
    every = rel.synthetic_shards(chunks)
    kept, rows = shards.delete_shards(every, files, every.where("shard_id % 4 = 1"))
    return rows.join(kept, "shard_id").select("file_id", "shard_id", "size")


# an insert at a window's end belongs to the next window if one begins there, except at the end of the file
@registered(
    sql_with(
        """SELECT a.file_id, a.s AS start, a.e AS end, coalesce(max(w.ws) FILTER (a.s < a.e OR a.s < w.we OR w.we = size), max(w.ws)) AS window_start FROM a JOIN w ON w.file_id = a.file_id AND w.ws <= a.s AND a.e <= w.we JOIN sizes ON sizes.file_id = a.file_id GROUP BY 1, 2, 3""",
        "chunks",
        extra="""sizes AS (SELECT file_id, CAST(sum(length) AS BIGINT) AS size FROM chunks GROUP BY 1), w AS (SELECT file_id, k * 100 AS ws, least(k * 100 + 100, size) AS we FROM (SELECT file_id, size, unnest(range(0, size // 100 + 1)) AS k FROM sizes) WHERE k * 100 < size),
        a AS (SELECT file_id, s, CASE WHEN file_id % 2 = 0 THEN s ELSE least(s + 40, s // 100 * 100 + 100, size) END AS e FROM (SELECT file_id, size, CASE WHEN file_id % 3 = 0 THEN size ELSE least(file_id % 4 * 50, size) END AS s FROM sizes))""",
    )
)
def edit_window_assignment(spark, sf_dir):
    sizes = rel.line_chunks(spark, sf_dir).groupBy("file_id").agg(F.sum("length").alias("size"))
    windows = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / 100)))).where("k * 100 < size").select("file_id", (F.col("k") * 100).alias("start"), F.least(F.col("k") * 100 + 100, "size").alias("end"))
    asked = sizes.withColumn("start", F.when(F.col("file_id") % 3 == 0, F.col("size")).otherwise(F.least(F.col("file_id") % 4 * 50, F.col("size"))))
    end = F.when(F.col("file_id") % 2 == 0, F.col("start")).otherwise(F.least(F.col("start") + 40, F.floor(F.col("start") / 100) * 100 + 100, F.col("size")))
    return edits.assigned(asked.select("file_id", "start", end.alias("end")), windows, sizes)


@registered(
    sql_with(
        """SELECT file_id, p AS position, min_by(stop + l1 + l2, stop) FILTER (stop >= p AND l1 >= 100 AND l1 < 600 AND l2 >= 100 AND l2 < 600) AS boundary FROM
        (SELECT file_id, sum(length) OVER w AS stop, lead(length, 1) OVER w AS l1, lead(length, 2) OVER w AS l2 FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY chunk_idx)) JOIN (SELECT DISTINCT file_id, file_id * 37 % 1500 AS p FROM chunks) USING (file_id) GROUP BY 1, 2""",
        "chunks",
    )
)
def next_stable_boundary(spark, sf_dir):
    chunks = rel.line_chunks(spark, sf_dir)
    return ch.next_stable_boundary(chunks, chunks.select("file_id", (F.col("file_id") * 37 % 1500).alias("position")).distinct(), 100, 600)


# A9, A11, A13, A28, B5, B9, C20, G1, G4, H19, H38


def _files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    flags = F.when(F.col("doc_id") % 2 == 0, 1 << 31).otherwise(0) + F.when(F.col("doc_id") % 3 == 0, 1 << 30).otherwise(0)
    return docs.select(F.floor(F.col("doc_id") / 20).alias("shard_id"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256).alias("file_hash"), flags.cast("long").alias("flags"), lines.alias("n_segments"), F.sha2("text", 256).alias("sha256"))


@registered(
    """WITH f AS (SELECT doc_id // 20 AS shard_id, sha256(concat_ws(':', CAST(doc_id AS VARCHAR), text)) AS file_hash, doc_id % 2 = 0 AS v, doc_id % 3 = 0 AS x, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n, sha256(text) AS sha256 FROM documents),
    p AS (SELECT *, CAST(coalesce(sum(1 + n + CASE WHEN v THEN n ELSE 0 END + CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY shard_id ORDER BY file_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 48 AS at_ FROM f)
    SELECT shard_id, file_hash, at_ + 48 AS data_start, at_ + 48 + n * 48 AS data_end, CASE WHEN v THEN at_ + 48 + n * 48 END AS verification_start, CASE WHEN v THEN at_ + 48 + n * 96 END AS verification_end, CASE WHEN x THEN sha256 END AS sha256 FROM p"""
)
def file_record_ranges(spark, sf_dir):
    return shards.record_ranges(_files(spark, sf_dir), "shard_id")


@registered("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_record_wins(spark, sf_dir):
    return store.first_of_each(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@registered(
    """SELECT substr(name, 1, 64) AS shard_hash, max(expires) AS expires FROM (SELECT sha256(CAST(doc_id // 2 AS VARCHAR)) || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN 'a.mdb' ELSE '.mdb' END AS name, doc_id * 53 % 211 AS expires FROM documents)
    WHERE regexp_full_match(name, '[0-9a-f]{64}\\.mdb') AND expires >= 60 GROUP BY 1"""
)
def shard_folder_scan(spark, sf_dir):
    """Names of a folder, some of which aren't shards' or have expired."""
    end = F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, "a.mdb").otherwise(".mdb")
    path = F.concat(F.lit("/cache/"), F.sha2(F.floor(F.col("doc_id") / 2).cast("string"), 256), end)
    return shards.valid_shards(read(spark, sf_dir, "documents").select(path.alias("path"), (F.col("doc_id") * 53 % 211).alias("expires")), 60)


@registered(
    sql_with(
        """SELECT shard_id, key, created, CAST(CASE WHEN key IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY key IS NULL ORDER BY key) END AS BIGINT) AS collection, row_number() OVER (PARTITION BY key ORDER BY created DESC, shard_id) AS place
        FROM (SELECT shard_id, created, CASE WHEN kind > 0 THEN 'key' || kind END AS key FROM shards)""",
        "shards",
    )
)
def shard_registration(spark, sf_dir):
    """Shards of even id are known; all arrive, those of id 0 mod 3 twice."""
    every = rel.synthetic_shards(rel.line_chunks(spark, sf_dir)).select("shard_id", F.when(F.col("kind") > 0, F.concat(F.lit("key"), F.col("kind").cast("string"))).alias("key"), "created")
    every = written(every, "shards")
    return shards.registered(every.where("shard_id % 2 = 0"), every.unionByName(every.where("shard_id % 3 = 0")))


@registered(sql_with("SELECT shard_id, size, created + 3600 AS expires FROM shards", "shards"))
def shard_new_expiry(spark, sf_dir):
    return shards.with_expiry(rel.synthetic_shards(rel.line_chunks(spark, sf_dir)), F.col("created"), 3600).select("shard_id", "size", "expires")


COMPACTION = """s AS (SELECT *, created // 25 AS stretch, row_number() OVER (PARTITION BY kind, created // 25 ORDER BY created, shard_id) AS rn FROM shards),
    m AS (SELECT kind, stretch, rn, CAST(0 AS BIGINT) AS g, size AS held FROM s WHERE rn = 1 UNION ALL SELECT s.kind, s.stretch, s.rn, CASE WHEN m.held + s.size - 200 > 30000 THEN m.g + 1 ELSE m.g END,
        CASE WHEN m.held + s.size - 200 > 30000 THEN s.size ELSE m.held + s.size - 200 END FROM m JOIN s ON s.kind = m.kind AND s.stretch = m.stretch AND s.rn = m.rn + 1),
    groups AS (SELECT s.kind, s.stretch, s.shard_id, s.size, m.g AS merge_group FROM m JOIN s USING (kind, stretch, rn)),
    report AS (SELECT kind, stretch, merge_group, shard_id, CASE WHEN count(*) OVER w > 1 THEN 'obsolete' ELSE 'skipped' END AS state, size FROM groups WINDOW w AS (PARTITION BY kind, stretch, merge_group)
        UNION ALL SELECT kind, stretch, merge_group, min(shard_id), 'merged', CAST(sum(size) - (count(*) - 1) * 200 AS BIGINT) FROM groups GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


def _groups(spark, sf_dir):
    return shards.compaction_groups(rel.synthetic_shards(rel.line_chunks(spark, sf_dir)), "kind", target=30000, overhead=200, span=25)


@registered(sql_with("SELECT * FROM groups", "shards", extra=COMPACTION))
def shard_compaction_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@registered(sql_with("SELECT * FROM report", "shards", extra=COMPACTION))
def shard_compaction_report(spark, sf_dir):
    return shards.compacted(written(_groups(spark, sf_dir), "groups"), "kind", 200)


@registered(sql_with("SELECT shard_id, size, CAST(1600 AS BIGINT) AS expires FROM report WHERE state <> 'obsolete'", "shards", extra=COMPACTION))
def session_flush(spark, sf_dir):
    return shards.flushed(shards.compacted(written(_groups(spark, sf_dir), "groups"), "kind", 200), now=1000, valid_for=600)


@registered("SELECT doc_id, CASE WHEN a = b THEN 'equal' WHEN a & b = b THEN 'left' WHEN a & b = a THEN 'right' ELSE 'neither' END AS wider FROM (SELECT doc_id, (doc_id % 4) << 30 AS a, (doc_id // 4 % 4) << 30 AS b FROM documents)")
def flag_supersets(spark, sf_dir):
    bits = lambda c: (c % 4) * (1 << 30)
    return read(spark, sf_dir, "documents").select("doc_id", shards.flag_order(bits(F.col("doc_id")), bits(F.floor(F.col("doc_id") / 4))).alias("wider"))


@registered(sql_with("SELECT container_hash, n_chunks, CASE WHEN grp % 3 = 0 THEN 'right' ELSE 'left' END AS side FROM named", "named"))
def shard_union_in_memory(spark, sf_dir):
    named = rel.store(spark, sf_dir)[1]
    side = lambda df, s: df.select("container_hash", "n_chunks", F.lit(s).alias("side"))
    return shards.union_in_memory(side(named, "left"), side(named.where("grp % 3 = 0"), "right"), "container_hash")


@registered(
    sql_with(
        """SELECT container_hash, 'count' AS fault FROM c WHERE k % 7 = 1 UNION ALL SELECT container_hash, 'chunk' FROM c WHERE k % 7 = 2 UNION ALL SELECT container_hash, 'offset' FROM c WHERE k % 7 = 3 AND n_chunks > 1
        UNION ALL SELECT container_hash, 'size' FROM c WHERE k % 7 = 4""",
        "named",
        extra="c AS (SELECT *, (grp * 13 + bin) % 7 AS k FROM named)",
    )
)
def container_faults(spark, sf_dir):
    """A store in which some containers miss a chunk, hold another one, or have wrong offsets or sizes."""
    _, named, placed = rel.store(spark, sf_dir)
    k = named.select("container_hash", "n_chunks", ((F.col("grp") * 13 + F.col("bin")) % 7).alias("k"))
    said = named.join(k.drop("n_chunks"), "container_hash").select("container_hash", "n_chunks", (F.col("bytes_raw") + (F.col("k") == 4).cast("long")).alias("bytes_raw"))
    rows = placed.join(k, "container_hash")
    last = F.col("chunk_idx") == F.col("n_chunks") - 1
    listed = rows.withColumn("byte_start", F.col("byte_start") - ((F.col("k") == 3) & last & (F.col("chunk_idx") > 0)).cast("long") * F.lit(1)).withColumn("length", F.col("length") + ((F.col("k") == 3) & last & (F.col("chunk_idx") > 0)).cast("long"))
    real = rows.where(~((F.col("k") == 1) & last)).withColumn("chunk_hash", F.when((F.col("k") == 2) & last, F.sha2("chunk_hash", 256)).otherwise(F.col("chunk_hash")))
    real = real.withColumn("length", F.col("length") + ((F.col("k") == 3) & last & (F.col("chunk_idx") > 0)).cast("long"))
    columns = ["container_hash", "chunk_idx", "chunk_hash", "length"]
    return payloads.container_faults(said, listed.select(*columns, "byte_start"), real.select(*columns))


@registered(
    sql_with(
        """SELECT shard_id, 'hash' AS fault FROM shards WHERE shard_id % 7 IN (1, 2) UNION ALL SELECT shard_id, 'files' FROM shards WHERE shard_id % 5 = 3 UNION ALL SELECT DISTINCT file_id // 20, 'index' FROM chunks WHERE chunk_idx = 0 AND file_id // 20 % 11 = 5""",
        "shards",
    )
)
def shard_faults(spark, sf_dir):
    """Shards of which some have another name or content, files that aren't counted, or chunks that the index lacks."""
    chunks = rel.line_chunks(spark, sf_dir).withColumn("shard_id", F.floor(F.col("file_id") / 20))
    files = chunks.select("shard_id", F.col("file_id").cast("string").alias("file_hash")).distinct()
    h = F.sha2(F.col("shard_id").cast("string"), 256)
    every = files.groupBy("shard_id").agg((F.count("*") + F.max((F.col("shard_id") % 5 == 3).cast("long"))).alias("n_files")).withColumn("shard_hash", h)
    other = lambda m: F.when(F.col("shard_id") % 7 == m, F.sha2("shard_hash", 256)).otherwise(F.col("shard_hash"))
    names = every.select("shard_id", other(1).alias("name_hash"), other(2).alias("content_hash"))
    rows = chunks.select("shard_id", F.col("file_id").cast("string").alias("container_hash"), "chunk_idx", "chunk_hash")
    return shards.shard_faults(every, names, files, rows, rows.where("not (chunk_idx = 0 and shard_id % 11 = 5)"))


# scalar forms: H9, H10, H21, H23, H24, H27-H29, H31, H32, H17


@registered(
    """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id || '..' WHEN 1 THEN doc_id || '..' || (doc_id + 10) WHEN 2 THEN doc_id + 5 || '..' || doc_id WHEN 3 THEN 'x..' || doc_id ELSE '' || doc_id END AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN doc_id END AS start, CASE WHEN doc_id % 5 = 1 THEN doc_id + 10 END AS end FROM t"""
)
def dotted_ranges(spark, sf_dir):
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    text = F.when(m == 0, F.concat(i, F.lit(".."))).when(m == 1, F.concat(i, F.lit(".."), (F.col("doc_id") + 10).cast("string"))).when(m == 2, F.concat((F.col("doc_id") + 5).cast("string"), F.lit(".."), i)).when(m == 3, F.concat(F.lit("x.."), i)).otherwise(i)
    r = forms.dotted_range(text)
    return read(spark, sf_dir, "documents").select("doc_id", r["start"].alias("start"), r["end"].alias("end"))


@registered(
    """SELECT doc_id, CASE WHEN full_ THEN NULL ELSE a END AS start, CASE WHEN full_ THEN NULL ELSE b END AS end FROM (SELECT *, a = 0 AND b IS NULL AS full_ FROM
    (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN doc_id ELSE doc_id + 1 END AS a, CASE doc_id // 3 % 3 WHEN 0 THEN NULL WHEN 1 THEN doc_id + 8 ELSE doc_id + 7 END AS b FROM documents))"""
)
def bound_ranges(spark, sf_dir):
    kind = lambda c: F.when(c % 3 == 0, "open").when(c % 3 == 1, "included").otherwise("excluded")
    r = forms.bounds_range(F.col("doc_id"), kind(F.col("doc_id")), F.col("doc_id") + 7, kind(F.floor(F.col("doc_id") / 3)))
    return read(spark, sf_dir, "documents").select("doc_id", r["start"].alias("start"), r["end"].alias("end"))


@registered(
    """WITH t AS (SELECT doc_id, sha256(text) AS h, doc_id * 1000 AS ms, doc_id || '-' || (doc_id + 9) || CASE WHEN doc_id % 2 = 0 THEN ',' || (doc_id + 20) || '-' || (doc_id + 30) ELSE '' END AS r FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, rtrim(translate(to_base64(encode(h || ':' || ms || ':' || r)), '+/', '-_'), '=') AS token, h AS hash, ms AS at_ms, r AS ranges FROM t"""
)
def fetch_tokens(spark, sf_dir):
    """Written and read again."""
    one = lambda a, b: F.struct((F.col("doc_id") + a).alias("start"), (F.col("doc_id") + b).alias("end"))
    ranges = F.when(F.col("doc_id") % 2 == 0, F.array(one(0, 9), one(20, 30))).otherwise(F.array(one(0, 9)))
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", forms.fetch_token(F.sha2("text", 256), F.col("doc_id") * 1000, ranges).alias("token"))
    p = forms.parsed_token("token")
    shown = F.array_join(F.transform(p["ranges"], lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return docs.select("doc_id", "token", p["hash"].alias("hash"), p["at_ms"].alias("at_ms"), shown.alias("ranges"))


@registered(
    """WITH n AS (SELECT doc_id, CAST(n_chars AS BIGINT) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1024 ELSE 1048576 END AS n FROM documents WHERE n_chars IS NOT NULL),
    s AS (SELECT *, CASE WHEN n >= 1000000000 THEN 1000000000 WHEN n >= 1000000 THEN 1000000 WHEN n >= 1000 THEN 1000 ELSE 1 END AS d, CASE WHEN n >= 1073741824 THEN 1073741824 WHEN n >= 1048576 THEN 1048576 WHEN n >= 1024 THEN 1024 ELSE 1 END AS b FROM n)
    SELECT doc_id, CASE WHEN n % d = 0 THEN CAST(n // d AS VARCHAR) ELSE printf('%.3f', n / d) END || CASE d WHEN 1000000000 THEN 'GB' WHEN 1000000 THEN 'MB' WHEN 1000 THEN 'kB' ELSE 'B' END AS shown,
    CASE WHEN n % b = 0 THEN CAST(n // b AS VARCHAR) ELSE printf('%.2f', n / b) END || CASE b WHEN 1073741824 THEN ' GiB' WHEN 1048576 THEN ' MiB' WHEN 1024 THEN ' KiB' ELSE ' bytes' END AS human, n AS bytes, n * 1024 AS kib FROM s"""
)
def size_forms(spark, sf_dir):
    n = F.col("n_chars").cast("long") * F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1000).when(F.col("doc_id") % 4 == 2, 1024).otherwise(1048576)
    docs = read(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", n.cast("long").alias("n"))
    return docs.select("doc_id", forms.shown_size("n").alias("shown"), forms.human_bytes("n").alias("human"), forms.parsed_size(F.concat(F.col("n").cast("string"), F.lit(" B"))).alias("bytes"), forms.parsed_size(F.concat(F.col("n").cast("string"), F.lit("KiB"))).alias("kib"))


@registered("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, CASE doc_id % 5 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 1000 WHEN 2 THEN doc_id * 60000 WHEN 3 THEN doc_id * 3600000 END AS millis FROM documents")
def config_values(spark, sf_dir):
    word = F.when(F.col("doc_id") % 4 == 0, " Yes").when(F.col("doc_id") % 4 == 1, "OFF").when(F.col("doc_id") % 4 == 2, "1").otherwise("maybe")
    unit = F.when(F.col("doc_id") % 5 == 0, "ms").when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, " min").when(F.col("doc_id") % 5 == 3, "h").otherwise("weeks")
    return read(spark, sf_dir, "documents").select("doc_id", forms.parsed_bool(word).alias("flag"), forms.parsed_millis(F.concat(F.col("doc_id").cast("string"), unit)).alias("millis"))


@registered("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS scheme FROM documents")
def scheme_names(spark, sf_dir):
    m = F.col("doc_id") % 6
    name = F.when(m == 0, "None").when(m == 1, "LZ4 ").when(m == 2, "bg4-lz4").when(m < 5, "auto").otherwise("zip")
    return read(spark, sf_dir, "documents").select("doc_id", payloads.chosen_scheme(name, m == 3).alias("scheme"))


@registered(
    """WITH o AS (SELECT doc_id, [0, doc_id % 3, doc_id % 3 + 2] AS a, [0, 4, 9] AS b FROM documents)
    SELECT doc_id, doc_id % 3 > 0 AS rising, doc_id % 3 = 1 AS fits, array_to_string([a[1], a[2], a[3], a[3] + 4, a[3] + 9], ',') AS joined, (doc_id % 5 || ':0,' || (doc_id % 5 + 1) || ':4,' || (doc_id % 5 + 9) || ':9') AS pairs,
    CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS shard_hash FROM o JOIN documents USING (doc_id)"""
)
def offset_forms(spark, sf_dir):
    """Offsets that increase or not, two lists as one, chunk and offset of disjoint ranges, and the hash in a file's name."""
    i = F.col("doc_id")
    zero = F.lit(0).cast("long")
    a, b = F.array(zero, i % 3, i % 3 + 2), F.array(zero, F.lit(4).cast("long"), F.lit(9).cast("long"))
    r = lambda x, y: F.struct((i % 5 + x).alias("start"), (i % 5 + y).alias("end"))
    pairs = F.array_join(F.transform(digests.chunk_offset_pairs(F.array(r(0, 2), r(9, 10)), b), lambda x: F.concat_ws(":", x["chunk"].cast("string"), x["offset"].cast("string"))), ",")
    name = F.concat(F.lit("/s/"), F.sha2("text", 256), F.when(i % 2 == 0, ".mdb").otherwise(".tmp"))
    return read(spark, sf_dir, "documents").select("doc_id", digests.strictly_increasing(a).alias("rising"), digests.strictly_increasing(a, F.lit(3)).alias("fits"), F.array_join(digests.rebased(a, b).cast("array<string>"), ",").alias("joined"), pairs.alias("pairs"), digests.shard_name(name).alias("shard_hash"))


# D11, E8, C15, the bytes of ranges


@registered(
    sql_with(
        """SELECT f.block, CAST(min(r.size) AS BIGINT) AS size FROM (SELECT block, max(e) AS last FROM ranges GROUP BY 1) f LEFT JOIN reach r ON r.block = f.block AND r.place = f.last GROUP BY 1""",
        "terms",
        extra="""given AS (SELECT DISTINCT container_hash || '-' || query_id // 6 AS block, chunk_start AS s, chunk_end AS e FROM terms WHERE query_id % 6 < 5),
        ranges AS (SELECT block, min(s) AS s, max(e) AS e FROM (SELECT *, max(CASE WHEN s > upto OR upto IS NULL THEN s END) OVER (PARTITION BY block ORDER BY s) AS isl FROM
            (SELECT *, max(e) OVER (PARTITION BY block ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM given)) GROUP BY block, isl),
        edges AS (SELECT DISTINCT container_hash || '-' || query_id // 6 AS block, chunk_start AS s, chunk_end AS e, unpacked_length AS size FROM terms WHERE query_id % 6 < 4
            UNION ALL SELECT block, e, nxt, 0 FROM (SELECT block, e, lead(s) OVER (PARTITION BY block ORDER BY s) AS nxt FROM ranges) WHERE e < nxt),
        reach AS (SELECT block, min(s) AS place, CAST(0 AS HUGEINT) AS size FROM ranges GROUP BY 1 UNION SELECT x.block, x.e, r.size + x.size FROM reach r JOIN edges x ON x.block = r.block AND x.s = r.place)""",
    )
)
def block_sizes(spark, sf_dir):
    """Containers as blocks of six requests each: the ranges of five are fetched, the terms of four have to tell the size."""
    segs, placed = rel.segments(spark, sf_dir)
    block = F.concat_ws("-", "container_hash", F.floor(F.col("query_id") / 6).cast("string")).alias("block")
    found = written(reconstruct.terms(rel.requests(segs), segs, placed), "terms").select("query_id", block, F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end"), F.col("unpacked_length").alias("size"))
    ranges = coalesced(found.where("query_id % 6 < 5").select("block", "start", "end"), ["block"])
    return sessions.chain_size(ranges, found.where("query_id % 6 < 4"))


@registered(
    sql_with(
        """SELECT l.grp, l.file_id, l.bytes, l.chunks, max(CASE WHEN s.closed_now AND list_contains(s.out_, l.file_id) THEN s.made - 1 END) AS container FROM left_ l JOIN (SELECT grp, closed_now, out_, made FROM fold UNION ALL SELECT grp, true, open, made + 1 FROM fold f WHERE rn = (SELECT max(rn) FROM fold g WHERE g.grp = f.grp)) s ON s.grp = l.grp GROUP BY 1, 2, 3, 4""",
        "packed",
        extra=f"""left_ AS (SELECT grp, file_id, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS chunks FROM packed GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY file_id) AS rn FROM left_),
        fold AS (SELECT grp, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS open, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS out_, false AS closed_now, CAST(0 AS BIGINT) AS made FROM (SELECT DISTINCT grp FROM q)
            UNION ALL SELECT f.grp, q.rn, CASE WHEN fits THEN list_append(f.open, q.file_id) WHEN f.held >= q.bytes THEN [q.file_id] ELSE f.open END, CASE WHEN fits THEN f.held + q.bytes WHEN f.held >= q.bytes THEN q.bytes ELSE f.held END,
                CASE WHEN fits THEN f.n + q.chunks WHEN f.held >= q.bytes THEN q.chunks ELSE f.n END, CASE WHEN fits THEN CAST([] AS BIGINT[]) WHEN f.held >= q.bytes THEN f.open ELSE [q.file_id] END, NOT fits, CASE WHEN fits THEN f.made ELSE f.made + 1 END
            FROM fold f JOIN q ON q.grp = f.grp AND q.rn = f.rn + 1, LATERAL (SELECT f.held + q.bytes <= {rel.MAX_BYTES} AND f.n + q.chunks <= {rel.MAX_CHUNKS} AS fits))""",
    )
)
def session_leftovers(spark, sf_dir):
    left = rel.packed(rel.line_chunks(spark, sf_dir)).groupBy("grp", "file_id").agg(F.sum("length").alias("bytes"), F.count("*").alias("chunks"))
    return sessions.merged_leftovers(left, "grp", rel.MAX_BYTES, rel.MAX_CHUNKS)


WANTED = "want AS (SELECT query_id, from_hex(substr(h, start_ * 2 + 1, (end_ - start_) * 2)) AS want FROM requests JOIN (SELECT doc_id AS file_id, hex(encode(replace(text, chr(10), ''))) AS h FROM documents) USING (file_id))"


def _rebuilt(spark, sf_dir):
    """Requests and their ranges, rebuilt from container chunks; chunks are lines without their ends."""
    segs, placed = rel.segments(spark, sf_dir)
    asked = rel.requests(segs)
    found = written(reconstruct.terms(asked, segs, placed), "terms")
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct().select(F.sha2("line", 256).alias("chunk_hash"), F.encode("line", "utf-8").alias("data"))
    return asked, reconstruct.file_bytes(asked, found, placed, lines)


@registered(sql_with("SELECT query_id, CAST(octet_length(want) AS BIGINT) AS n_bytes, sha256(want) AS sha256 FROM want", "requests", extra=WANTED))
def reconstruct_bytes(spark, sf_dir):
    """Size and digest of every requested range."""
    return _rebuilt(spark, sf_dir)[1].select("query_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


@registered(sql_with("SELECT query_id, CAST(octet_length(want) AS BIGINT) AS n_bytes, true AS equal FROM want", "requests", extra=WANTED))
def reconstruct_bytes_equal(spark, sf_dir):
    """Every requested range next to the same range cut from its file."""
    asked, got = _rebuilt(spark, sf_dir)
    whole = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode(F.replace("text", F.lit("\n"), F.lit("")), "utf-8").alias("file"))
    want = asked.join(whole, "file_id").select("query_id", F.substring("file", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("want"))
    return want.join(got, "query_id", "left").select("query_id", F.octet_length("want").cast("long").alias("n_bytes"), F.coalesce(F.col("want") == F.col("data"), F.octet_length("want") == 0).alias("equal"))


# D14, E1, E2


@registered(
    """WITH s AS (SELECT event_type AS scenario, user_id AS client_id, epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value * 1000) AS BIGINT) AS bytes, event_id % 16 + 1 AS concurrency, event_id % 5 AS retries, event_id % 40 AS rtt_ms, event_id % 3 AS bandwidth FROM events),
    l AS (SELECT *, (lead(ts_ms) OVER (PARTITION BY scenario, client_id ORDER BY ts_ms, bytes) - ts_ms) * bandwidth AS could FROM s),
    c AS (SELECT scenario, client_id, max(bytes) AS b, max(retries) AS r, min(ts_ms) AS t0, max(ts_ms) AS t1, sum(could) AS could, count(*) AS n, sum(concurrency) AS c, sum(rtt_ms) FILTER (rtt_ms > 0) AS rtt, count(*) FILTER (rtt_ms > 0) AS n_rtt FROM l GROUP BY 1, 2)
    SELECT scenario, CAST(sum(b) AS BIGINT) AS bytes, max(t1) - min(t0) AS elapsed_ms, CAST(sum(r) AS BIGINT) AS retries, sum(c) / sum(n) AS mean_concurrency, coalesce(sum(rtt) / nullif(sum(n_rtt), 0), 0) AS mean_rtt_ms,
    least(100 * coalesce(sum(b) / nullif(sum(could), 0), 0), 100.0) AS utilisation FROM c GROUP BY 1"""
)
def scenario_summary(spark, sf_dir):
    from tesserae.operators import metrics

    i = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return metrics.scenario_summary(
        read(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), F.col("user_id").alias("client_id"), ms.alias("ts_ms"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"), (i % 16 + 1).alias("concurrency"), (i % 5).alias("retries"), (i % 40).alias("rtt_ms"), (i % 3).alias("bandwidth"))
    )


# the gear hash of each place by doubling windows of lagged hashes, then one cut after the other
CONTENT_CUTS = r"""gear AS (SELECT b, (SELECT sum(CAST('0x' || substr(sha256(unhex(printf('%02x', b))), 2 * i + 1, 2) AS UTINYINT)::HUGEINT << (8 * i)) FROM range(8) t(i)) AS g FROM range(256) r(b)),
    bytes AS (SELECT file_id, pos, CAST('0x' || substr(h, 2 * pos - 1, 2) AS UTINYINT) AS b FROM (SELECT doc_id AS file_id, hex(encode(text)) AS h, unnest(range(1, strlen(text) + 1)) AS pos FROM documents WHERE strlen(text) > 0)),
    h1 AS (SELECT file_id, pos, g AS h FROM bytes JOIN gear USING (b)),
    """ + ", ".join(
    f"h{2 * k} AS (SELECT file_id, pos, (h + (coalesce(lag(h, {k}) OVER (PARTITION BY file_id ORDER BY pos), 0) << {k}) % 18446744073709551616) % 18446744073709551616 AS h FROM h{k})" for k in (1, 2, 4, 8, 16, 32)
) + """,
    size AS (SELECT doc_id AS file_id, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE strlen(text) > 0),
    places AS MATERIALIZED (SELECT file_id, n, coalesce(p, []) AS p FROM size LEFT JOIN (SELECT file_id, list(pos ORDER BY pos) AS p FROM h64 WHERE h >> 54 = 0 GROUP BY 1) USING (file_id)),
    cut AS (SELECT file_id, CAST(-1 AS BIGINT) AS chunk_idx, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop FROM size
        UNION ALL SELECT c.file_id, c.chunk_idx + 1, c.stop, CASE WHEN n - c.stop <= 128 THEN n ELSE least(coalesce(list_filter(p, lambda x: x >= c.stop + 128)[1], n), c.stop + 2048, n) END FROM cut c JOIN places USING (file_id) WHERE c.stop < n)"""


@registered("WITH RECURSIVE " + CONTENT_CUTS + " SELECT file_id, chunk_idx, start AS offset, stop - start AS length FROM cut WHERE chunk_idx >= 0")
def cuts_of_blocks(spark, sf_dir):
    """Content-defined cuts of texts that come as blocks of 700 and of 40 bytes."""
    from tesserae.functions.chunking import ChunkSpec

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data")).where("octet_length(data) > 0")
    width = F.when(F.col("file_id") % 2 == 0, 700).otherwise(40)
    blocks = docs.withColumn("w", width).withColumn("offset", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1, F.col("w")))).select("file_id", F.col("offset").cast("long").alias("offset"), F.expr("substring(data, offset + 1, w)").alias("data"))
    return ch.cuts_of_blocks(blocks, ChunkSpec(target=1024))


# I4


FLUSHES = """WITH RECURSIVE q AS (SELECT event_id // 300 AS session, epoch_us(ts) // 1000 AS ts_ms, event_id AS container, row_number() OVER (PARTITION BY event_id // 300 ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
    f AS (SELECT session, ts_ms, container, rn, CAST(0 AS BIGINT) AS flush, ts_ms AS begin, CAST(1 AS BIGINT) AS held FROM q WHERE rn = 1
        UNION ALL SELECT q.session, q.ts_ms, q.container, q.rn, CASE WHEN next THEN f.flush + 1 ELSE f.flush END, CASE WHEN next THEN q.ts_ms ELSE f.begin END, CASE WHEN next THEN 1 ELSE f.held + 1 END
        FROM f JOIN q ON q.session = f.session AND q.rn = f.rn + 1, LATERAL (SELECT q.ts_ms - f.begin >= 7200000 OR f.held = 6 AS next))
    """


@registered(FLUSHES + "SELECT session, ts_ms, container, flush FROM f")
def session_flush_windows(spark, sf_dir):
    made = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 300).alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("container"))
    return sessions.flush_windows(made, 7_200_000, 6)


# a window that is neither full nor followed by another is flushed by its timer, if the watermark has got there
@registered(
    FLUSHES.replace("7200000", "1200000")
    + """SELECT session, flush, begin_ms, n, containers, closed_by FROM (SELECT session, flush, min(ts_ms) AS begin_ms, count(*) AS n, string_agg(container, ',' ORDER BY rn) AS containers, CASE WHEN count(*) = 6 THEN 'count' ELSE 'interval' END AS closed_by,
        flush = max(flush) OVER (PARTITION BY session) AS newest FROM f GROUP BY session, flush) WHERE closed_by = 'count' OR NOT newest OR begin_ms + 1200000 <= (SELECT max(ts_ms) - 10000 FROM f)"""
)
def session_flush_stream(spark, sf_dir):
    """The flushes of the events table, read as a stream to its end."""
    at = f"{shared_dir(spark)}/flushes-{uuid.uuid4().hex}"
    # a pattern, as a stream takes no single file by its name
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    made = events.select(F.floor(F.col("event_id") / 300).alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("container"))
    before = spark.conf.get(flushes.PROVIDER_KEY, None)
    spark.conf.set(flushes.PROVIDER_KEY, flushes.PROVIDER)
    try:
        query = flushes.flush_stream(made, 1_200_000, 6).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(flushes.PROVIDER_KEY) if before is None else spark.conf.set(flushes.PROVIDER_KEY, before)
    query.awaitTermination()
    return spark.read.parquet(f"{at}/rows").withColumn("containers", F.concat_ws(",", F.col("containers").cast("array<string>")))


# A16


@registered(sql_with("SELECT * FROM placed", "placed"))
def container_rows_rebuilt(spark, sf_dir):
    """Every container's chunk rows, from its payload alone."""
    placed = rel.store(spark, sf_dir)[2]
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct().select(F.sha2("line", 256).alias("chunk_hash"), F.encode("line", "utf-8").alias("data"))
    return payloads.rebuilt_rows(payloads.encode_containers(placed.join(lines, "chunk_hash"), payloads.LZ4).select("container_hash", "payload"))


# C1, C2


@registered(
    sql_with(
        "SELECT chunk_hash, min(p.container_hash) AS container_hash, arg_min(p.chunk_idx, (p.container_hash, p.chunk_idx)) AS chunk_idx FROM asked JOIN placed p USING (chunk_hash) GROUP BY chunk_hash",
        "placed",
        extra="asked AS (SELECT chunk_hash FROM chunks WHERE file_id % 3 = 0 UNION SELECT sha256('none ' || doc_id) FROM documents)",
    )
)
def lookup_by_hash(spark, sf_dir):
    """The chunks of a third of the files, and as many unknown hashes as there are files, looked up in the store's index."""
    chunks, _, placed = rel.store(spark, sf_dir)
    path = f"{shared_dir(spark)}/hash-index-{uuid.uuid4().hex}"
    lookup.write_index(placed.select("chunk_hash", "container_hash", "chunk_idx"), path, digits=1)
    unknown = read(spark, sf_dir, "documents").select(F.sha2(F.concat(F.lit("none "), F.col("doc_id")), 256).alias("chunk_hash"))
    asked = chunks.where("file_id % 3 = 0").select("chunk_hash").unionByName(unknown)
    return lookup.lookup(asked, lookup.read_index(spark, path, "chunk_hash string, container_hash string, chunk_idx long"), digits=1)


# A17, A18


@registered(
    sql_with(
        """SELECT query_id, outcome, CASE WHEN outcome = 'ok' THEN n ELSE CASE WHEN outcome = 'empty' THEN 0 END END AS n_chunks, CASE WHEN outcome = 'ok' THEN b ELSE CASE WHEN outcome = 'empty' THEN 0 END END AS bytes, digest AS chunks_sha256
        FROM (SELECT query_id, CASE WHEN held IS NULL THEN 'not_found' WHEN s >= e THEN 'empty' WHEN e > held THEN 'out_of_range' ELSE 'ok' END AS outcome, container_hash, s, e FROM
            (SELECT query_id, a.container_hash, n.n_chunks AS held, coalesce(s, 0) AS s, coalesce(e, n.n_chunks) AS e FROM asked a LEFT JOIN named n USING (container_hash))) q
        LEFT JOIN LATERAL (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS b, sha256(string_agg(chunk_hash, '' ORDER BY chunk_idx)) AS digest FROM placed p WHERE q.outcome = 'ok' AND p.container_hash = q.container_hash AND chunk_idx >= s AND chunk_idx < e) ON true""",
        "placed",
        extra="""asked AS (SELECT container_hash AS query_id, container_hash, CASE WHEN n_chunks % 3 > 0 THEN n_chunks // 3 END AS s, CASE n_chunks % 3 WHEN 1 THEN n_chunks // 2 WHEN 2 THEN n_chunks + n_chunks % 2 END AS e FROM named
            UNION ALL SELECT h, h, 0, 1 FROM (SELECT sha256('none ' || doc_id) AS h FROM documents))""",
    )
)
def container_ranges_read(spark, sf_dir):
    """Whole containers, ranges of them, some empty or too long, and containers that aren't there."""
    _, named, placed = rel.store(spark, sf_dir)
    n = F.col("n_chunks")
    kind = n % 3
    asked = named.select(F.col("container_hash").alias("query_id"), "container_hash", F.when(kind > 0, F.floor(n / 3)).alias("chunk_start"), F.when(kind == 1, F.floor(n / 2)).when(kind == 2, n + n % 2).alias("chunk_end"))
    none = F.sha2(F.concat(F.lit("none "), F.col("doc_id")), 256)
    unknown = read(spark, sf_dir, "documents").select(none.alias("query_id"), none.alias("container_hash"), F.lit(0).cast("long").alias("chunk_start"), F.lit(1).cast("long").alias("chunk_end"))
    return reads.container_reads(asked.unionByName(unknown), named, placed)


@registered(
    sql_with(
        """SELECT query_id, outcome, size, CASE WHEN outcome = 'ok' THEN s END AS start, CASE WHEN outcome = 'ok' THEN least(e, size) END AS end FROM
        (SELECT query_id, size, s, e, CASE WHEN size IS NULL THEN 'not_found' WHEN s >= size OR e < s THEN 'invalid_range' ELSE 'ok' END AS outcome FROM
            (SELECT d.doc_id AS query_id, d.doc_id * 7919 % 3000 AS s, d.doc_id * 7919 % 3000 + d.doc_id * 31 % 5000 - 200 AS e, f.size FROM documents d
                LEFT JOIN (SELECT file_id, CAST(sum(length) AS BIGINT) AS size FROM chunks GROUP BY 1) f ON f.file_id = CASE WHEN d.doc_id % 11 = 0 THEN -1 - d.doc_id ELSE d.doc_id END))""",
        "chunks",
    )
)
def file_ranges_read(spark, sf_dir):
    """Ranges that begin within a file or behind it, end there or behind it, or are turned round; some of files that aren't there."""
    sizes = rel.line_chunks(spark, sf_dir).groupBy("file_id").agg(F.sum("length").alias("size"))
    d = F.col("doc_id")
    start = d * 7919 % 3000
    asked = read(spark, sf_dir, "documents").select(d.alias("query_id"), F.when(d % 11 == 0, -1 - d).otherwise(d).alias("file_id"), start.alias("start"), (start + d * 31 % 5000 - 200).alias("end"))
    return reads.file_reads(asked, sizes)
