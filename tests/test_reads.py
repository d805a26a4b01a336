from tesserae.operators import reads
from tesserae.plans.engine import Engine


def test_outcomes_of_file_reads(spark):
    files = spark.createDataFrame([(1, 10), (2, 0), (2, 0), (3, 5)], "file_id long, size long")
    asked = [("a", 1, 0, 4), ("b", 1, 9, 99), ("c", 1, 10, 12), ("d", 1, 4, 3), ("e", 1, -1, 3), ("f", 2, None, None), ("g", 2, 0, None), ("h", 9, None, None), ("i", None, 0, 1), ("j", 3, None, 2), ("k", 3, 2, None), ("l", 3, 2, 2)]
    got = {r[0]: tuple(r)[1:] for r in reads.file_reads(spark.createDataFrame(asked, "query_id string, file_id long, start long, end long"), files).collect()}
    bad = lambda size: ("invalid_range", size, None, None)
    none = ("not_found", None, None, None)
    assert got == {"a": ("ok", 10, 0, 4), "b": ("ok", 10, 9, 10), "c": bad(10), "d": bad(10), "e": bad(10), "f": ("ok", 0, 0, 0), "g": bad(0), "h": none, "i": none, "j": ("ok", 5, 0, 2), "k": ("ok", 5, 2, 5), "l": ("ok", 5, 2, 2)}


def test_outcomes_of_container_reads(spark):
    containers = spark.createDataFrame([("c", 3), ("c", 3)], "container_hash string, n_chunks long")
    placed = spark.createDataFrame([("c", i, f"h{i}", 10 + i) for i in (2, 0, 1, 1)], "container_hash string, chunk_idx long, chunk_hash string, length long")
    asked = [("w", "c", None, None), ("r", "c", 1, 3), ("e", "c", 2, 2), ("o", "c", 1, 4), ("m", "c", -1, 2), ("p", "c", 1, None), ("n", "x", 0, 1), ("z", None, None, None)]
    schema = "query_id string, container_hash string, chunk_start long, chunk_end long"
    got = {r[0]: tuple(r)[1:4] for r in reads.container_reads(spark.createDataFrame(asked, schema), containers, placed).collect()}
    none = (None, None)
    assert got == {"w": ("ok", 3, 33), "r": ("ok", 2, 23), "e": ("empty", 0, 0), "o": ("out_of_range", *none), "m": ("out_of_range", *none), "p": ("out_of_range", *none), "n": ("not_found", *none), "z": ("not_found", *none)}
    assert reads.container_reads(spark.createDataFrame([], schema), containers, placed).count() == 0


def test_engine_tells_what_reads_give(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.ingest(spark.createDataFrame([(1, bytearray(b"abc" * 50))], "file_id long, data binary"))
    asked = spark.createDataFrame([(1, 1, 100, 400), (2, 1, 150, 160), (3, 8, 0, 1)], "query_id long, file_id long, start long, end long")
    assert {r[0]: tuple(r)[1:] for r in engine.read_outcomes(asked).collect()} == {1: ("ok", 150, 100, 150), 2: ("invalid_range", 150, None, None), 3: ("not_found", None, None, None)}
    held = engine.containers().collect()
    assert len(held) == 1 and held[0]["bytes_raw"] == 150
    whole = spark.createDataFrame([(1, held[0]["container_hash"], None, None), (2, "none", 0, 1)], "query_id long, container_hash string, chunk_start long, chunk_end long")
    assert {r["query_id"]: (r["outcome"], r["bytes"]) for r in engine.read_containers(whole).collect()} == {1: ("ok", 150), 2: ("not_found", None)}
