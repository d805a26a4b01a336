import pytest
from pyspark.sql import functions as F

from tesserae.functions import forms
from tesserae.operators import payloads, reconstruct, shards


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", f("t").alias("x")).orderBy("i").collect()]


def test_ranges_that_are_none(spark):
    assert values(spark, ["3..9", "3..", "9..3", "..", "a..b", "3-9", "99999999999999999999..", None, "7..7"], forms.dotted_range) == [(3, 9), (3, None), None, None, None, None, None, None, (7, 7)]


def test_bounds(spark):
    df = spark.createDataFrame([(0, "open", 0, "open"), (5, "included", 5, "included"), (5, "excluded", 9, "open"), (0, "open", 4, "excluded")], "a long, ak string, b long, bk string")
    r = forms.bounds_range(F.col("a"), F.col("ak"), F.col("b"), F.col("bk"))
    assert [x["r"] and tuple(x["r"]) for x in df.select(r.alias("r")).collect()] == [None, (5, 6), (6, None), (0, 4)]
    with pytest.raises(Exception, match="a range from 7 to 3"):
        spark.createDataFrame([(7, 3)], "a long, b long").select(forms.bounds_range(F.col("a"), F.lit("included"), F.col("b"), F.lit("excluded"))).collect()


def test_sizes_times_and_words(spark):
    assert values(spark, ["1.5 MiB", "2kb", "7", "0.5b", "x", "", "3 weeks", "1PiB", "1.2.3"], forms.parsed_size) == [1572864, 2000, 7, 1, None, None, None, 1 << 50, None]
    assert values(spark, ["250ms", "20", "5 m", "2h", "1d", "soon", "-3s"], forms.parsed_millis) == [250, 20_000, 300_000, 7_200_000, 86_400_000, None, None]
    assert values(spark, ["TRUE", " off", "2"], forms.parsed_bool) == [True, False, None]
    df = spark.createDataFrame([(0,), (999,), (1000,), (1500,), (1024,), (1536,), (1 << 40,)], "n long")
    assert [r["x"] for r in df.select(forms.shown_size("n").alias("x")).collect()] == ["0B", "999B", "1kB", "1.500kB", "1.024kB", "1.536kB", "1.100TB"]
    assert [r["x"] for r in df.select(forms.human_bytes("n").alias("x")).collect()] == ["0 bytes", "999 bytes", "1000 bytes", "1.46 KiB", "1 KiB", "1.50 KiB", "1 TiB"]


def test_tokens_that_are_none(spark):
    assert values(spark, ["", "????", "YWJj", None], forms.parsed_token) == [None] * 4


def test_a_term_without_a_block_is_an_error_where_that_is_asked(spark):
    found = spark.createDataFrame([(1, 0, "c", 0, 3), (1, 1, "c", 5, 7)], "query_id long, term_idx long, container_hash string, chunk_start long, chunk_end long")
    blocks = spark.createDataFrame([(1, "c", 0, 4)], "query_id long, container_hash string, chunk_start long, chunk_end long")
    assert sorted((r["term_idx"], r["block_start"]) for r in reconstruct.blocks_of_terms(found, blocks).collect()) == [(0, 0), (1, None)]
    with pytest.raises(Exception, match="no block for term 1 of 1"):
        reconstruct.blocks_of_terms(found, blocks, strict=True).collect()


def test_lengths_beyond_a_chunk_are_refused():
    for field in (slice(1, 4), slice(5, 8)):
        blob = bytearray(payloads._encode(b"abc", 0))
        blob[field] = b"\xff\xff\xff"
        with pytest.raises(ValueError, match="no valid chunk"):
            list(payloads._decode(bytes(blob)))


def test_shards_register_once_and_by_key(spark):
    known = spark.createDataFrame([(1, "k2", 5), (2, "k1", 9)], "shard_id long, key string, created long")
    more = spark.createDataFrame([(2, "k1", 9), (3, "k1", 10), (3, "k1", 10)], "shard_id long, key string, created long")
    assert sorted((r["shard_id"], r["collection"], r["place"]) for r in shards.registered(known, more).collect()) == [(1, 2, 1), (2, 1, 2), (3, 1, 1)]
    open_ = spark.createDataFrame([(7, None, 1)], "shard_id long, key string, created long")
    assert sorted((r["shard_id"], r["collection"]) for r in shards.registered(known, open_).collect()) == [(1, 2), (2, 1), (7, 0)]
