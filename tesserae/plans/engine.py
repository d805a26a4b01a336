"""The engine's surface: ingest, reconstruct, hash, edit, delete and check a store of files.

Each ingest is a batch with folders of its own in every relation; its row in
``commits`` is written last, and readers take committed batches only. A batch
that dies on its way leaves nothing that is read, and may simply be repeated; two
writers don't disturb each other (what both found to be new is stored twice and
read once).

Chunks are looked up in ``chunk_index``, which each batch adds to by ranges of the
hash; a batch reads only the ranges that its own hashes hit, and keeps of them only
what it asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.chunking import ChunkSpec
from tesserae.operators import chunks as ch
from tesserae.operators import dedup, edits, lookup, merkle, merkle_partial, packing, reads, reconstruct
from tesserae.sources import store as st


INDEXED = "chunk_hash string, container_hash string, chunk_idx long"
INDEX = f"{INDEXED}, {lookup.RANGE} string"


class Engine:
    """A store is a folder of relations; see ``tesserae.sources.store.SCHEMAS``, and ``payload(chunk_hash, data)``."""

    def __init__(self, spark: SparkSession, store: str, spec: ChunkSpec = ChunkSpec(), max_bytes: int = 64 << 20, max_chunks: int = 8192, group_files: int = 250, index_digits: int = lookup.DIGITS):
        self.spark, self.store, self.spec = spark, store.rstrip("/"), spec
        self.max_bytes, self.max_chunks, self.group_files, self.index_digits = max_bytes, max_chunks, group_files, index_digits

    def _stored(self, name: str) -> DataFrame:
        schema = INDEX if name == "chunk_index" else st.SCHEMAS[name] if name in st.SCHEMAS else "chunk_hash string, data binary"
        self.spark.createDataFrame([], INDEXED if name == "chunk_index" else schema).write.mode("ignore").parquet(f"{self.store}/{name}/batch=none" + (f"/{lookup.RANGE}=none" if name == "chunk_index" else ""))
        self.spark.createDataFrame([], "batch string").write.mode("ignore").parquet(f"{self.store}/commits")
        rows = self.spark.read.schema(schema + ", batch string").option("basePath", f"{self.store}/{name}").parquet(f"{self.store}/{name}")
        return rows.join(self.spark.read.schema("batch string").parquet(f"{self.store}/commits"), "batch", "left_semi").drop("batch")

    def _known(self, asked: DataFrame) -> DataFrame:
        """chunk_hash, container_hash, chunk_idx: one place of each asked chunk that the store has."""
        return lookup.lookup(asked, self._stored("chunk_index"), digits=self.index_digits)

    def hash_files(self, files: DataFrame) -> DataFrame:
        """file_id, container_hash, file_hash, range_hash; nothing is stored."""
        return merkle.merkle_hashes(ch.content_chunks(files, self.spec))

    def ingest(self, files: DataFrame, dry_run: bool = False) -> DataFrame:
        """files(file_id, data) -> dedup metrics of each file; unless it is a dry run, what is new is stored.

        Chunks are new if neither the store nor an earlier place of the batch has
        them. New chunks are packed by ranges of ``group_files`` file ids.
        """
        cut = ch.content_chunks(files, self.spec, with_data=True)
        batch = uuid.uuid4().hex
        if not dry_run:
            # the cut is used many times below: stored once, under the batch's own name
            staged = f"{self.store}/staging/{batch}"
            cut.write.parquet(f"{staged}/chunks")
            cut = self.spark.read.parquet(f"{staged}/chunks")
        rows = cut.select("file_id", "chunk_idx", "chunk_hash", "length")
        known = self._known(rows)
        if not dry_run:
            # no more rows than the batch has chunks
            known.write.parquet(f"{staged}/known")
            known = self.spark.read.schema("chunk_hash string, container_hash string, chunk_idx long").parquet(f"{staged}/known")
        flagged = dedup.flag_new(rows).join(known.select("chunk_hash").withColumn("seen", F.lit(True)), "chunk_hash", "left").withColumn("is_new", F.col("is_new") & F.col("seen").isNull()).drop("seen")
        metrics = dedup.dedup_metrics(flagged, "file_id")
        if dry_run:
            return metrics
        st.write(packing.segments(rows, self._store_new(cut, flagged, known, batch)), self.store, "segments", batch)
        hashes = merkle.merkle_hashes(rows).select("file_id", "file_hash")
        st.write(rows.groupBy("file_id").agg(F.sum("length").alias("size")).join(hashes, "file_id").select("file_id", "file_hash", "size"), self.store, "files", batch)
        self._commit(batch)
        return metrics

    def _commit(self, batch: str) -> None:
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.store}/commits")

    def _store_new(self, cut: DataFrame, flagged: DataFrame, known: DataFrame, batch: str) -> DataFrame:
        """Packs and stores the new chunks of a batch; chunk_hash, container_hash, chunk_idx of all its chunks."""
        staged = f"{self.store}/staging/{batch}"
        new = flagged.where("is_new").withColumn("grp", F.floor(F.col("file_id") / self.group_files))
        packing.pack_ranges(new, self.max_bytes, self.max_chunks).write.parquet(f"{staged}/packed")
        bins = self.spark.read.parquet(f"{staged}/packed")
        named = packing.containers(bins)
        placed = packing.container_chunks(bins, named)
        bodies = cut.join(bins.select("file_id", "chunk_idx"), ["file_id", "chunk_idx"], "left_semi").select("chunk_hash", "data")
        bodies.write.parquet(f"{self.store}/payload/batch={batch}")
        st.write(named.select("container_hash", "n_chunks", "bytes_raw"), self.store, "containers", batch)
        st.write(placed, self.store, "container_chunks", batch)
        # this batch's own places, then those of committed batches: what is known is not placed anew
        own = st.read(self.spark, self.store, f"container_chunks/batch={batch}").select("chunk_hash", "container_hash", "chunk_idx")
        lookup.write_index(own, f"{self.store}/chunk_index/batch={batch}", digits=self.index_digits)
        return own.unionByName(known)

    def _read(self, requests: DataFrame, form) -> DataFrame:
        segments, placed = self._stored("segments"), self._stored("container_chunks").dropDuplicates(["container_hash", "chunk_idx"])
        return form(requests, reconstruct.terms(requests, segments, placed), placed, self._stored("payload"))

    def reconstruct(self, requests: DataFrame) -> DataFrame:
        """requests(query_id, file_id, start, end) -> query_id, data; end null reads to the end."""
        return self._read(requests, reconstruct.file_bytes)

    def read_pieces(self, requests: DataFrame) -> DataFrame:
        """The same as query_id, piece_idx, offset, data, for ranges of any length."""
        return self._read(requests, reconstruct.file_pieces)

    def read_outcomes(self, requests: DataFrame) -> DataFrame:
        """query_id, outcome, size, start, end: what ``reconstruct`` and ``read_pieces`` give for requests, told before any byte is read; see ``reads.file_reads``."""
        return reads.file_reads(requests, self._stored("files"))

    def read_containers(self, asked: DataFrame) -> DataFrame:
        """asked(query_id, container_hash, chunk_start, chunk_end) -> whether they exist, and how long the ranges are; see ``reads.container_reads``."""
        return reads.container_reads(asked, self._stored("containers"), self._stored("container_chunks"))

    def containers(self) -> DataFrame:
        """container_hash, n_chunks, bytes_raw of what is stored, each once."""
        return self._stored("containers").dropDuplicates(["container_hash"])

    def splice_stored(self, changes: DataFrame) -> DataFrame:
        """changes(file_id, start, end, data, new_id) of stored files -> new_id, size, bytes_read, bytes_cut, new_bytes of each edited file, stored under new_id.

        Only windows around the edits are read and cut anew; the other segments are taken
        over. A window goes on until cuts are sure to fall where they fell before, so the
        chunks are those of the whole file after the edits. What an edit deletes is not read.
        Edits that overlap or leave their file, and those of files that aren't stored, are refused.
        """
        batch = uuid.uuid4().hex
        staged = f"{self.store}/staging/{batch}"

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{staged}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{staged}/{name}")

        asked = kept(changes.select("file_id", "start", "end", F.octet_length("data").cast("long").alias("new_length"), "data", "new_id"), "edits")
        ids = asked.groupBy("file_id").agg(F.first("new_id").alias("new_id"))
        files = self._stored("files").join(ids, "file_id").select("file_id", "size").distinct()
        verdict = edits.validated(asked, files)
        if ids.count() > verdict.where("valid").count():
            raise ValueError("edits overlap, lie outside their file, or are of files that aren't stored")
        segments = kept(self._stored("segments").join(ids, "file_id", "left_semi").distinct(), "segments")
        placed = self._stored("container_chunks").dropDuplicates(["container_hash", "chunk_idx"])
        chunks = kept(edits.stored_chunks(segments, placed), "old-chunks")
        windows = edits.windows_of_edits(chunks, asked, 2 * self.spec.min_size, self.spec.max_size)
        windows = kept(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
        # the old bytes between the edits of a window, by request
        home = edits.assigned(asked.select("file_id", "start", "end"), windows.select("file_id", "start", "end"), files)
        mine = asked.join(home, ["file_id", "start", "end"]).join(windows.select("file_id", F.col("start").alias("window_start"), F.col("end").alias("window_end"), "window"), ["file_id", "window_start"])
        order = Window.partitionBy("window").orderBy("start", "end")
        between = mine.select("window", "file_id", F.coalesce(F.lag("end").over(order), "window_start").alias("from"), F.col("start").alias("to"), F.row_number().over(order).alias("k"))
        rest = mine.groupBy("window", "file_id").agg(F.max("end").alias("from"), F.max("window_end").alias("to"), (F.count("*") + 1).cast("int").alias("k"))
        requests = between.unionByName(rest).where("from < to").select(F.monotonically_increasing_id().alias("query_id"), "window", "k", "file_id", F.col("from").alias("start"), F.col("to").alias("end"))
        requests = kept(requests, "requests")
        old = self.read_pieces(requests.select("query_id", "file_id", "start", "end")).join(requests.select("query_id", "window", "k"), "query_id")
        old = old.select("window", "k", F.lit(0).alias("new"), "piece_idx", "data")
        new = mine.select("window", F.row_number().over(order).alias("k"), F.lit(1).alias("new"), F.lit(0).cast("long").alias("piece_idx"), "data")
        pieces = kept(old.unionByName(new), "pieces")
        # a window's bytes: a few chunks beside each edit, and the edits' data
        listed = pieces.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("k", "new", "piece_idx", F.hex("data").alias("hex")))).alias("p"))
        bodies = listed.select(F.col("window").alias("file_id"), F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")).alias("data"))
        cut = kept(ch.content_chunks(bodies, self.spec, with_data=True), "chunks")
        rows = cut.select("file_id", "chunk_idx", "chunk_hash", "length")
        known = kept(self._known(rows), "known")
        flagged = dedup.flag_new(rows).join(known.select("chunk_hash").withColumn("seen", F.lit(True)), "chunk_hash", "left").withColumn("is_new", F.col("is_new") & F.col("seen").isNull()).drop("seen")
        places = self._store_new(cut, flagged, known, batch)
        of = windows.select(F.col("window").alias("w"), F.col("file_id").alias("f"), "start_chunk")
        named = lambda df: df.join(of, F.col("file_id") == F.col("w")).drop("file_id", "w").withColumnRenamed("f", "file_id")
        made = kept(named(packing.segments(rows, places)), "made")
        renamed = lambda df: df.join(ids, "file_id").drop("file_id").withColumnRenamed("new_id", "file_id")
        st.write(renamed(edits.composed(segments, placed, windows, made)).select("file_id", "seg_idx", "container_hash", "chunk_start", "chunk_end", "bytes"), self.store, "segments", batch)
        whole = kept(renamed(edits.composed_chunks(chunks, windows, named(rows))), "new-chunks")
        hashes = merkle_partial.merkle_hashes_of_parts(whole)
        sizes = whole.groupBy("file_id").agg(F.sum("length").alias("size"))
        st.write(sizes.join(hashes, "file_id").select("file_id", "file_hash", "size"), self.store, "files", batch)
        self._commit(batch)
        amounts = pieces.groupBy("window").agg(F.sum(F.when(F.col("new") == 0, F.octet_length("data")).otherwise(0)).alias("bytes_read"), F.sum(F.octet_length("data")).alias("bytes_cut"))
        stored = flagged.where("is_new").groupBy(F.col("file_id").alias("window")).agg(F.sum("length").alias("new_bytes"))
        by = windows.join(amounts, "window", "left").join(stored, "window", "left").join(ids, "file_id").groupBy("new_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes_read", "bytes_cut", "new_bytes")))
        return by.join(sizes.withColumnRenamed("file_id", "new_id"), "new_id", "left").select("new_id", F.coalesce("size", F.lit(0)).alias("size"), "bytes_read", "bytes_cut", "new_bytes")

    def splice(self, changes: DataFrame) -> DataFrame:
        """changes(file_id, start, end, data) of stored files -> file_id, data after them, for ``ingest`` under new ids."""
        whole = self._stored("files").join(changes.select("file_id").distinct(), "file_id", "left_semi").select(F.col("file_id").alias("query_id"), "file_id", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
        return edits.spliced(self.reconstruct(whole).withColumnRenamed("query_id", "file_id"), changes)

    def totals(self) -> DataFrame:
        """Files and their bytes, containers and theirs."""
        files = self._stored("files").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("materialized_bytes"))
        return files.crossJoin(self._stored("containers").agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("bytes_raw"), F.lit(0)).alias("stored_bytes")))  # one row each
