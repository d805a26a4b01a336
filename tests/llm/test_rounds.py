"""The Jaccard join in rounds: the same links, and little of what it writes and shuffles stays."""

import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import jaccard_join
from tesserae.sources import shared

from . import brute, fixtures


def crowd(n):
    """Texts that share a passage, some of them near copies of each other."""
    rng = random.Random(7)
    passage = fixtures.text(1, 60)
    rows = []
    for i in range(n):
        own = fixtures.text(100 + i - i % 3 if rng.random() < 0.4 else 100 + i, 30)
        rows.append((i, f"{passage} {own} end{i}" if i % 5 else f"{passage} {own}"))
    return rows


def test_rounds_of_signing_make_all_signatures_once():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 2, 5, 9, 9, 30, 31, 200, 210, 1500])
    first = np.concatenate([[0], np.cumsum(size)])
    h = rng.integers(1 << 63, size=int(first[-1]), dtype=np.uint64)
    bands = jaccard_join.Bands(4, 5, 5, 2)
    bands.upto(int(size.max()))
    band = np.searchsorted(np.asarray(bands.tops), size)
    whole = sorted(zip(*(x.tolist() for x in jaccard_join.signatures(h, first, bands))))
    counts = dict(zip(*(x.tolist() for x in np.unique(band, return_counts=True))))
    for at_once in (100, 2_000, 10**9):
        rounds = jaccard_join.signing_rounds(counts, bands, at_once)
        made = [x for only in rounds for x in zip(*(x.tolist() for x in jaccard_join.signatures(h, first, bands, only)))]
        assert sorted(made) == whole and (len(rounds) == 1) == (at_once == 10**9)


def test_links_do_not_depend_on_rounds(spark):
    rows = crowd(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, c) for i, _, c in brute.components(rows, 5, 4, 5))
    assert len({c for _, c in want}) < len(want)
    for large, at_once in ((8_000, 150), (6, 1_500)):
        got = jaccard_join.link_components(docs, 5, 4, 5, block=4, large=large, at_once=at_once)
        assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == want


def test_tables_and_shuffle_files_go(spark):
    before = len(shared._MADE)
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(crowd(30), "doc_id long, text string"))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in shared._MADE[before:]]
    assert set(left) <= {"near-copies", "ids-of-several-texts"} and 0 < kept.count() < 30

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    old = shuffle_files()
    table = shared.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert len(table.collect()) == 7 and not shuffle_files() - old
    shared.discard(table)
