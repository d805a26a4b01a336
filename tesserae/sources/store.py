"""Reading and writing the store's relations, and other inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.digests import shard_name

SCHEMAS = {
    "chunks": "file_id long, chunk_idx long, chunk_hash string, length long",
    "containers": "container_hash string, n_chunks long, bytes_raw long",
    "container_chunks": "container_hash string, chunk_idx long, chunk_hash string, byte_start long, length long",
    "segments": "file_id long, seg_idx long, container_hash string, chunk_start long, chunk_end long, bytes long",
    "files": "file_id long, file_hash string, size long",
    "shards": "shard_id long, created long, expires long, size long, n_chunks long",
}
SORTED_BY = {"chunks": "chunk_hash", "containers": "container_hash", "container_chunks": "container_hash", "segments": "file_id", "files": "file_id", "shards": "created"}


def write(df: DataFrame, store: str, name: str, batch: str | None = None) -> None:
    """One relation, or a batch of it, sorted by its key within ranges of it, so that lookups by key skip files and row groups by their statistics."""
    key = SORTED_BY[name]
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("append").parquet(f"{store}/{name}" + (f"/batch={batch}" if batch else ""))


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name.split("/")[0]]).parquet(f"{store}/{name}")


def files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, length, data of whole files; listing alone if data isn't selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.col("length"), F.col("content").alias("data"))


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """shard_hash, path, size of the files in a folder whose name is a hash; others are left out."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.withColumn("shard_hash", shard_name("path")).where("shard_hash is not null")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON documents, one a line; fields that a document hasn't got are null, and a line that is no document is a row of nulls."""
    return spark.read.schema(schema).json(path)


def upload_outcomes(events: DataFrame, max_frame: int = 1 << 20) -> DataFrame:
    """events(upload_id, seq, line) of JSON frames -> upload_id, type, ok.

    The last frame decides and must be of type result or error; a frame over the
    limit makes the upload an error.
    """
    typed = events.withColumn("type", F.get_json_object("line", "$.type")).withColumn("over", F.octet_length("line") > max_frame)
    last = typed.groupBy("upload_id").agg(F.max_by("type", "seq").alias("type"), F.max("over").alias("over"))
    return last.select("upload_id", F.when(F.col("over"), "frame_too_long").otherwise(F.coalesce("type", F.lit("none"))).alias("type"), (~F.col("over") & (F.col("type") == "result")).alias("ok"))


def first_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first record of each key wins."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("__r = 1").drop("__r")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """One JSON document a row, null fields kept."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("document"))
