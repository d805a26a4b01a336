"""Each stage of the corpus pipeline against a plain version, on its own input."""

import collections
import hashlib

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import jaccard_join, mixing, quality

from ..conftest import SF
from . import brute, fixtures

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs_of(docs)

    kept = STAGE["quality classifier"](spark, docs, SF).cache()
    rows = docs_of(kept)
    assert kept.columns == docs.columns and set(rows) <= set(before)
    ids = {r[0] for r in rows}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in ids for i in clean) > 0.97 * len(clean) and sum(i in ids for i, x in labels.items() if x[0] == 0) < 0.2 * sum(x[0] == 0 for x in labels.values())

    exact = STAGE["exact dedup"](spark, kept, SF).cache()
    last = {}
    for r in rows:
        key = r[1].translate(brute.LOW)
        last[key] = max(last.get(key, r), r, key=lambda x: x[0])
    rows = docs_of(exact)
    assert sorted(rows) == sorted(last.values())

    near = STAGE["n-gram Jaccard join"](spark, exact, SF).cache()
    keep = {i for i, _, c in brute.components([(r[0], r[1]) for r in rows], 5, 4, 5) if i == c}
    assert sorted(docs_of(near)) == sorted(r for r in rows if r[0] in keep)

    mixed = STAGE["mixing sources"](spark, near, SF).cache()
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_documents(near).collect()}
    assert collections.Counter(docs_of(mixed)) == collections.Counter({r: times[r[0]] for r in docs_of(near) if times[r[0]]})

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] for r in before}
    done = STAGE["sentence pieces"](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in done) == collections.Counter(r[0] for r in docs_of(mixed))
    for r in done:
        want = sp.encode(text[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, done))


def test_stages_on_awkward_rows(spark):
    for df in (fixtures.frame(spark), fixtures.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "sentence pieces" or out.columns == df.columns
            n = out.count()
            assert n <= 3 * df.count() and (df.count() > 0 or n == 0)
            if df.count():
                # what has to be left of these rows
                left = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
                if name == "exact dedup":
                    assert left == collections.Counter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 111]) - collections.Counter([1, 6, 10])
                elif name == "n-gram Jaccard join":
                    comp = {i: c for i, _, c in brute.components([(r["doc_id"], r["text"]) for r in df.collect()], 5, 4, 5)}
                    assert left == collections.Counter(r["doc_id"] for r in df.collect() if comp[r["doc_id"]] == r["doc_id"])
                elif name == "sentence pieces":
                    assert left == collections.Counter(r["doc_id"] for r in df.collect())
                elif name == "quality classifier":
                    assert set(left) & {6, 7, 8} == set()  # without tokens


def test_the_mix_repeats_rows_not_ids(spark):
    rows = [(1, "one two", "a"), (1, "three four five", "b"), (None, "six", "a"), (None, "seven", "b"), (2, None, "a"), (1, "one two", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(tuple(r) for r in mixing.mixed_rows(df).collect())
    taken = collections.Counter()
    for t, n in got.items():
        assert t in rows and n <= 3 * rows.count(t)
        taken[t[2]] += n * len((t[1] or "").split())
    assert 6 <= taken["a"] <= 9 and 1 <= taken["b"] <= 6


def test_weights_do_not_depend_on_other_columns(spark):
    df = fixtures.frame(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    a = {(r["doc_id"], r["gumbel_key"]) for r in quality.classify(df, labels).collect()}
    b = {(r["doc_id"], r["gumbel_key"]) for r in quality.classify(df.select("text", "doc_id").orderBy(F.rand(3)), labels).collect()}
    assert a == b


def test_near_copies_are_judged_by_text_not_by_id(spark):
    a, b, c = fixtures.text(1, 120), fixtures.text(2, 120), fixtures.text(3, 120)
    near = lambda t: t + " tail"
    rows = [(3, a, "x"), (5, near(a), "y"), (5, b, "z"), (5, b, "z"), (7, near(b), "w"), (None, near(a), "n"), (None, a, "n"), (None, None, "n"), (9, c, "x"), (2, near(c), "x"), (9, near(c) + " more", "q"), (11, None, "e"), (12, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __extra string")
    kept = {tuple(r) for r in jaccard_join.drop_near_copies(docs).collect()}
    # of each group one text stays: of the ids that have one text, the smallest
    assert {r for r in rows if r[0] is None or r[0] in (11, 12)} | {rows[0], (2, near(c), "x")} <= kept
    assert len(kept & {(5, b, "z"), (7, near(b), "w")}) == 1 and len(kept) == 8
    # without repeated ids nothing changes
    assert sorted(r["doc_id"] for r in jaccard_join.drop_near_copies(docs.where("doc_id <> 5 and doc_id is not null")).collect()) == [2, 3, 7, 11, 12]
