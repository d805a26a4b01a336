"""The store's relations, derived from the driver's tables, and the same relations in SQL.

Files are documents, chunks their lines. New chunks are packed in groups of 250
consecutive file ids. Each function has a SQL twin in ``CTES``; ``sql_with``
strings together what a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import chunks as ch
from tesserae.operators import dedup, packing
from tesserae.sources.shared import written

MAX_BYTES, MAX_CHUNKS, GROUP = 65536, 256, 250


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.line_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))


def packed(chunks: DataFrame) -> DataFrame:
    new = dedup.first_locations(chunks).withColumn("grp", F.floor(F.col("file_id") / GROUP))
    return packing.pack(new, MAX_BYTES, MAX_CHUNKS)


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, containers, container chunks. Chunks are packed once; the tables that follow are written and read."""
    chunks = line_chunks(spark, sf_dir)
    bins = written(packed(chunks), "packed")
    named = written(packing.containers(bins), "containers")
    return chunks, named, written(packing.container_chunks(bins, named), "container-chunks")


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, _, placed = store(spark, sf_dir)
    return written(packing.segments(chunks, placed), "segments"), placed


def requests(segs: DataFrame) -> DataFrame:
    sizes = segs.groupBy("file_id").agg(F.sum("bytes").alias("size")).where("size > 0")
    start = F.col("file_id") * 7919 % F.col("size")
    return sizes.select(F.col("file_id").alias("query_id"), "file_id", start.alias("start"), (start + 1 + F.col("file_id") * 104729 % 4096).alias("end"))


def synthetic_shards(chunks: DataFrame) -> DataFrame:
    """A shard for each 20 files: shard_id, kind, created, expires, size, n_chunks."""
    by = chunks.groupBy(F.floor(F.col("file_id") / 20).alias("shard_id")).agg((F.count("*") * 48 + 200).alias("size"), F.count("*").alias("n_chunks"))
    return by.select("shard_id", (F.col("shard_id") % 3).alias("kind"), (F.col("shard_id") * 37 % 101).alias("created"), (F.col("shard_id") * 53 % 211).alias("expires"), "size", "n_chunks")


CTES = {
    "lines": """lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""",
    "chunks": """chunks AS (SELECT doc_id AS file_id, CAST(i AS BIGINT) - 1 AS chunk_idx, sha256(l[i]) AS chunk_hash, CAST(strlen(l[i]) AS BIGINT) AS length FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines))""",
    "firsts": """firsts AS (SELECT chunk_hash, file_id, chunk_idx, length FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY file_id, chunk_idx) AS r FROM chunks) WHERE r = 1)""",
    "flagged": """flagged AS (SELECT c.*, f.chunk_hash IS NOT NULL AS is_new FROM chunks c LEFT JOIN firsts f USING (file_id, chunk_idx))""",
    "queue": f"""queue AS (SELECT *, file_id // {GROUP} AS grp, row_number() OVER (PARTITION BY file_id // {GROUP} ORDER BY file_id, chunk_idx) AS rn FROM firsts)""",
    "bins": f"""bins AS (SELECT grp, rn, CAST(0 AS BIGINT) AS bin, length AS held, CAST(1 AS BIGINT) AS n FROM queue WHERE rn = 1
        UNION ALL SELECT q.grp, q.rn, CASE WHEN b.held + q.length > {MAX_BYTES} OR b.n = {MAX_CHUNKS} THEN b.bin + 1 ELSE b.bin END,
            CASE WHEN b.held + q.length > {MAX_BYTES} OR b.n = {MAX_CHUNKS} THEN q.length ELSE b.held + q.length END,
            CASE WHEN b.held + q.length > {MAX_BYTES} OR b.n = {MAX_CHUNKS} THEN 1 ELSE b.n + 1 END FROM bins b JOIN queue q ON q.grp = b.grp AND q.rn = b.rn + 1)""",
    "packed": """packed AS (SELECT grp, file_id, chunk_idx, chunk_hash, length, bin, n - 1 AS pos FROM queue JOIN bins USING (grp, rn))""",
    "named": """named AS (SELECT sha256(string_agg(chunk_hash, '' ORDER BY pos)) AS container_hash, grp, bin, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS bytes_raw FROM packed GROUP BY grp, bin)""",
    "placed": """placed AS (SELECT container_hash, pos AS chunk_idx, chunk_hash, CAST(sum(length) OVER (PARTITION BY grp, bin ORDER BY pos) AS BIGINT) - length AS byte_start, length FROM packed JOIN named USING (grp, bin))""",
    "located": """located AS (SELECT c.file_id, c.chunk_idx, c.length, p.container_hash, p.chunk_idx AS at_,
        CASE WHEN lag(p.container_hash) OVER w = p.container_hash AND lag(p.chunk_idx) OVER w + 1 = p.chunk_idx THEN 0 ELSE 1 END AS begins FROM chunks c JOIN placed p USING (chunk_hash) WINDOW w AS (PARTITION BY c.file_id ORDER BY c.chunk_idx))""",
    "segments": """segments AS (SELECT file_id, seg_idx, min(container_hash) AS container_hash, min(at_) AS chunk_start, max(at_) + 1 AS chunk_end, CAST(sum(length) AS BIGINT) AS bytes
        FROM (SELECT *, CAST(sum(begins) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS BIGINT) - 1 AS seg_idx FROM located) GROUP BY file_id, seg_idx)""",
    "requests": """requests AS (SELECT file_id AS query_id, file_id, file_id * 7919 % size AS start_, file_id * 7919 % size + 1 + file_id * 104729 % 4096 AS end_ FROM (SELECT file_id, CAST(sum(bytes) AS BIGINT) AS size FROM segments GROUP BY file_id) WHERE size > 0)""",
    "hits": """hits AS (SELECT r.query_id, s.seg_idx, s.container_hash, s.chunk_start, s.chunk_end, r.start_, r.end_, s.seg_start FROM requests r
        JOIN (SELECT *, CAST(sum(bytes) OVER (PARTITION BY file_id ORDER BY seg_idx) AS BIGINT) - bytes AS seg_start FROM segments) s ON s.file_id = r.file_id AND s.seg_start < r.end_ AND r.start_ < s.seg_start + s.bytes)""",
    "parts": """parts AS (SELECT h.*, p.chunk_idx AS c, p.length AS c_len, h.seg_start + p.byte_start - min(p.byte_start) OVER (PARTITION BY h.query_id, h.seg_idx) AS f_start
        FROM hits h JOIN placed p ON p.container_hash = h.container_hash AND p.chunk_idx >= h.chunk_start AND p.chunk_idx < h.chunk_end)""",
    "terms": """terms AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seg_idx) - 1 AS term_idx, container_hash, chunk_start, chunk_end, unpacked_length,
        CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY seg_idx) = 1 THEN greatest(d, 0) ELSE 0 END AS skip
        FROM (SELECT query_id, seg_idx, container_hash, min(c) AS chunk_start, max(c) + 1 AS chunk_end, CAST(sum(c_len) AS BIGINT) AS unpacked_length, max(start_ - f_start) AS d
              FROM parts WHERE f_start + c_len > start_ AND f_start < end_ GROUP BY query_id, seg_idx, container_hash))""",
    "fetches": """fetches AS (SELECT j.query_id, j.container_hash, j.s AS chunk_start, j.e AS chunk_end, a.byte_start, b.byte_start + b.length AS byte_end FROM
        (SELECT query_id, container_hash, isl, min(chunk_start) AS s, max(chunk_end) AS e FROM
            (SELECT *, max(CASE WHEN chunk_start > reach OR reach IS NULL THEN chunk_start END) OVER (PARTITION BY query_id, container_hash ORDER BY chunk_start) AS isl FROM
                (SELECT *, max(chunk_end) OVER (PARTITION BY query_id, container_hash ORDER BY chunk_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM terms)) GROUP BY 1, 2, 3) j
        JOIN placed a ON a.container_hash = j.container_hash AND a.chunk_idx = j.s JOIN placed b ON b.container_hash = j.container_hash AND b.chunk_idx = j.e - 1)""",
    "shards": """shards AS (SELECT shard_id, shard_id % 3 AS kind, shard_id * 37 % 101 AS created, shard_id * 53 % 211 AS expires, n * 48 + 200 AS size, n AS n_chunks FROM (SELECT file_id // 20 AS shard_id, count(*) AS n FROM chunks GROUP BY 1))""",
}
NEEDS = {
    "chunks": ["lines"], "firsts": ["chunks"], "flagged": ["chunks", "firsts"], "queue": ["firsts"], "bins": ["queue"], "packed": ["queue", "bins"], "named": ["packed"], "placed": ["packed", "named"],
    "located": ["chunks", "placed"], "segments": ["located"], "requests": ["segments"], "hits": ["requests", "segments"], "parts": ["hits", "placed"], "terms": ["parts"], "fetches": ["terms", "placed"], "shards": ["chunks"],
}


def sql_with(query: str, *names: str, extra: str = "") -> str:
    """``query`` after the CTEs it needs, in order, and the ones given in ``extra``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join([CTES[n] for n in order] + ([extra] if extra else [])) + "\n" + query
