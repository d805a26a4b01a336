"""The corpus pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.

Defined results, for any rows: an empty table stays empty through all stages; a
null or blank text is rejected by the first stage; a row with a null id is kept
or dropped by its text in the first two stages, is never a near copy, and is
mixed and encoded like any other; rows that share an id are judged each by its
own text in every stage; of a row that is there twice the second stage keeps one.
Further columns are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import exact_dedup, jaccard_join, mixing, quality, sentence_pieces
from tesserae.llm.shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier (operator 7) draws; texts without tokens go."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 9): the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (operator 4): five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.drop_near_copies(docs, n=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources (operator 6): rows that are not drawn go, rows drawn several times repeat."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with the end id and the decoded text's digest (operator 2), a row for each row."""
    import public_tokenizers

    made = sentence_pieces.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.digests(made)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentence pieces", encode),
]

#: Hashed models, seeded draws and the library's segmentation are not to be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
