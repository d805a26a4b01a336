"""What the operators here share: written tables in the cluster's shared folder, and text readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources import shared
from tesserae.sources.shared import discard, scratch, shared_dir  # noqa: F401

#: Rows and bytes of the batches that Python functions take while a table is written: texts and
#: sketches are long, and each batch is held by the executor, by its worker and once more on the way back.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to a new shared table and reads it: cuts lineage, survives lost executors."""
    with shared.session_settings(df.sparkSession, BATCH):
        return shared.written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
