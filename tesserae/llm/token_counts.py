"""Operator 1: token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null counts as empty; a
byte-level vocabulary tells every other difference, so nothing else is folded)
together with the SHA-256 of the tokenizer file. Stored counts are joined by
that key; only distinct texts that are missing are encoded, once each, and
appended to the cache. Equal texts are folded before the first shuffle, so a
text that a third of the rows share is one row per task.

Defined results: null and empty text have 0 tokens; repeated rows each get a
row; an empty table gives an empty result; other columns are ignored. Texts of
any length and kind are counted, long runs of white space too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: tiktoken's engine keeps a step back for each character of a run of white space, and its stack is bounded.
_LONG_SPACE = re.compile(r"\s{10000}")
CACHE_SCHEMA = "tokenizer_digest binary, text_digest binary, n_tokens long"


def file_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


@lru_cache(maxsize=4)
def _byte_encoder(path: str):
    """The vocabulary of a byte-level BPE .json in tiktoken's engine, and its added tokens.

    Same pieces, merge order and pre-tokenisation as the file describes, at
    about five times the speed; tests hold the ids against the tokenizers
    library over every code point.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    # printable bytes stand for themselves; the others are numbered from code point 256 up
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), set(added)


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    encoder, added = _byte_encoder(path)

    def count(text: str) -> int:
        if _LONG_SPACE.search(text):
            return len(_library(path).encode(text, add_special_tokens=False).ids)
        # as the library does by default, an added token's string in a text is that token
        return len(encoder.encode(text, allowed_special=added) if any(a in text for a in added) else encoder.encode_ordinary(text))

    return lambda texts: list(map(count, texts))


def open_cache(spark: SparkSession, path: str) -> str:
    """Makes an empty cache at ``path`` unless there is one."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    return path


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, text_digest of each row; appends new counts to the cache."""
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    open_cache(spark, cache_path)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == F.lit(version))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.binary()), b.column("text_digest"), pa.array(count(texts), pa.int64())], names=["tokenizer_digest", "text_digest", "n_tokens"])

    misses = keyed.groupBy("text_digest").agg(F.first("text").alias("text")).join(stored().select("text_digest"), "text_digest", "left_anti")
    misses.select("text_digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # runs that append at the same time may store a count twice: one row per digest, so that the join below keeps the rows
    counts = written(stored().groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest").join(counts, "text_digest", "left").select("doc_id", "n_bytes", "n_tokens", "text_digest")
