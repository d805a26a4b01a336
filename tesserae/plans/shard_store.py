"""Metadata shards as relations under a manifest: shards are added, read, merged and swept.

``manifest`` has a row for each shard that a batch adds, and one for each that a
compaction replaces. The rows of one change are one file, written last: readers see
a change as a whole or not at all, and a job that dies before leaves folders that
nothing reads. Rows of replaced shards stay until ``sweep``, so readers that have
planned on them are not disturbed. Ids are unique among the shards that are added;
a merged shard has the smallest of its members'. One compaction runs at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import compaction

RELATIONS = {
    "shards": "shard_id long, created long, expires long",
    "shard_files": "shard_id long, file_hash string, flags long, n_segments long",
    "shard_segments": "shard_id long, file_hash string, seg_idx long, container_hash string, chunk_start long, chunk_end long, bytes long",
    "shard_containers": "shard_id long, container_hash string, n_chunks long",
    "shard_chunks": "shard_id long, container_hash string, chunk_idx long, chunk_hash string, length long",
}
MANIFEST = "batch string, shard_id long, live boolean"


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, overhead: int = 248):
        self.spark, self.path, self.overhead = spark, path.rstrip("/"), overhead

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(at if name == "manifest" else f"{at}/batch=none")
        if name == "manifest":
            return self.spark.read.schema(schema).parquet(at)
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", at).parquet(at)

    def _manifest(self) -> DataFrame:
        return self._table("manifest", MANIFEST)

    def live(self) -> DataFrame:
        """batch, shard_id of the shards that are there: added and not replaced."""
        return self._manifest().groupBy("batch", "shard_id").agg(F.min("live").alias("live")).where("live").drop("live")

    def read(self, name: str) -> DataFrame:
        """The rows of one relation that belong to shards that are there."""
        return self._table(name, RELATIONS[name]).join(self.live(), ["batch", "shard_id"], "left_semi").drop("batch")

    def _write(self, batch: str, relations: dict[str, DataFrame]) -> None:
        for name, df in relations.items():
            columns = [c.split()[0] for c in RELATIONS[name].split(", ")]
            df.select(*columns).write.parquet(f"{self.path}/{name}/batch={batch}")

    def _swap(self, rows: DataFrame) -> None:
        rows.select("batch", "shard_id", "live").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, relations: dict[str, DataFrame]) -> str:
        """Adds shards: all of ``RELATIONS``; the name of the batch."""
        if missing := set(RELATIONS) - set(relations):
            raise ValueError(f"relations not given: {sorted(missing)}")
        batch = uuid.uuid4().hex
        self._manifest()
        self._write(batch, relations)
        shards = self.spark.read.schema(RELATIONS["shards"]).parquet(f"{self.path}/shards/batch={batch}")
        self._swap(shards.select(F.lit(batch).alias("batch"), "shard_id", F.lit(True).alias("live")))
        return batch

    def compact(self, target: int, span: int) -> DataFrame:
        """Merges shards (see ``compaction.merge_plan``) and swaps them in; shard_id, into, state, merged_size of all that were there.

        Shards that stay alone are not written anew. A merged shard was created when its
        newest member was and expires when its first one does.
        """
        batch = uuid.uuid4().hex
        to = self._staged(batch, target, span)
        self._swap(self._changes(batch, to))
        return to.select("shard_id", "into", "state", "merged_size")

    def _staged(self, batch: str, target: int, span: int) -> DataFrame:
        """Writes the merged shards of a compaction under a batch that nothing reads yet."""
        shards, files, containers = (self.read(n) for n in ("shards", "shard_files", "shard_containers"))
        plan = compaction.merge_plan(shards.withColumn("__all", F.lit(0)), compaction.parts(files, containers), "__all", target, self.overhead, span)
        at = f"{self.path}/plans/{batch}"
        compaction.destinations(plan, "__all").write.parquet(at)
        to = self.spark.read.parquet(at)
        merging = to.where("state = 'obsolete'")
        new_files, new_containers = compaction.merged_files(files, merging), compaction.merged_containers(containers, merging)
        self._write(
            batch,
            {
                "shards": shards.join(merging, "shard_id").groupBy("into").agg(F.max("created").alias("created"), F.min("expires").alias("expires")).withColumnRenamed("into", "shard_id"),
                "shard_files": new_files,
                "shard_segments": compaction.taken_over(self.read("shard_segments"), new_files, "file_hash"),
                "shard_containers": new_containers,
                "shard_chunks": compaction.taken_over(self.read("shard_chunks"), new_containers, "container_hash"),
            },
        )
        return to

    def _changes(self, batch: str, to: DataFrame) -> DataFrame:
        gone = to.where("state = 'obsolete'")
        old = self.live().join(gone.select("shard_id"), "shard_id").select("batch", "shard_id", F.lit(False).alias("live"))
        return old.unionByName(gone.select(F.lit(batch).alias("batch"), F.col("into").alias("shard_id"), F.lit(True).alias("live")).distinct())

    def sweep(self) -> list[str]:
        """Deletes the folders of batches all of whose shards are replaced; their names. To be run when no reader uses them."""
        there = self.live().select("batch").distinct()
        dead = [r["batch"] for r in self._manifest().select("batch").distinct().join(there, "batch", "left_anti").collect()]  # a row a batch
        for name in RELATIONS:
            for batch in dead:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return dead
