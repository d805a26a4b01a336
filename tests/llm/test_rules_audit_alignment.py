import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesserae.llm import alignment, filter_audit, quality_rules, queries, text_stats

from ..conftest import SF
from ..oracle import assert_same, connection
from . import fixtures
from .brute import WORD

LABELS = "doc_id long, quality int, toxic int"

# 11


def plain_counts(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def plain_base(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_rule_counts_equal_plain_ones(spark, which):
    df = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else fixtures.frame(spark)
    judged = quality_rules.judge(df, quality_rules.DecisionList())
    assert judged.columns[: len(df.columns)] == df.columns
    got = judged.collect()
    assert len(got) == df.count()
    for r in got:
        want = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == plain_base(want) and r["kept"] == (not r["base_failed"])


def test_rule_counts_of_random_texts():
    import pyarrow as pa

    from tesserae.llm.words import slices

    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "b", "é", "中", " ", "  ", "\n", "\r\n", "\t", "a b a", "#", "|x"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    parts = [text_stats.quality_counts(d, o, text_stats._class(quality_rules.SYMBOLS)) for _, _, d, o in slices(pa.array(texts))]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = list(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in names)))
    assert got == [plain_counts(t) for t in texts]
    assert np.concatenate([p["n_distinct_words"] for p in parts]).tolist() == [len(set(WORD.findall(t))) for t in texts]


def test_rules_are_recovered_and_pruned():
    rng = np.random.default_rng(1)
    n = 6000
    rows = {c: rng.integers(100, 1000, n) for c in quality_rules.COUNTS}
    rows["n_symbols"] = (rows["n_words"] * rng.random(n)).astype(int)
    rows["n_dup_lines"] = (rows["n_lines"] * rng.random(n)).astype(int)
    v = quality_rules.attributes(rows)
    truth = (v["symbols a word"] > 0.8) | ((v["share of repeated lines"] > 0.5) & (v["words"] <= 400))
    # one of a hundred labels is wrong
    bad = truth ^ (rng.random(n) < 0.01)
    rules = quality_rules.learned(rows, bad, rng.random(n) < 2 / 3)
    caught = np.any([r.covers(v) for r in rules.rules], axis=0)
    assert (caught == truth).mean() > 0.985 and (caught & ~truth).sum() / (~truth).sum() < 0.01
    # what each rule is about, and no more
    first = {c.attribute for c in rules.rules[0].conditions}
    assert first <= {"symbols a word", "share of repeated lines", "words"} and "keep the rest" in rules.describe()


def test_emitted_expression_equals_the_list(spark):
    rules = quality_rules.DecisionList([
        quality_rules.Rule((quality_rules.Condition("symbols a word", True, 0.02), quality_rules.Condition("words", False, 300.0)), 1, 0),
        quality_rules.Rule((quality_rules.Condition("share of distinct words", False, 0.6),), 1, 0),
    ])
    got = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), rules).toPandas()
    rows = {c: got[c].to_numpy() for c in quality_rules.COUNTS}
    caught = np.any([r.covers(quality_rules.attributes(rows)) for r in rules.rules], axis=0)
    assert (got["kept"].to_numpy() == ~(got["base_failed"].to_numpy() | caught)).all() and caught.any()


def test_rules_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    mine = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(2)) == 0
    rules = quality_rules.learn(docs, labels.where(mine))
    got = quality_rules.judge(docs.select("doc_id", "text"), rules).join(labels.where(~mine), "doc_id").where("not base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    by = {r["quality"]: r for r in got}
    assert by[0]["kept"] <= 0.1 * by[0]["n"] and by[1]["kept"] >= 0.98 * by[1]["n"]


def test_rules_on_awkward_tables(spark):
    docs, none = fixtures.frame(spark), spark.createDataFrame([], LABELS)
    assert quality_rules.learn(docs, none).rules == []
    odd = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 0, 0), (12, None, 0), (99999, 0, 0)], LABELS)
    assert quality_rules.learn(docs, odd).rules == []
    assert quality_rules.judge(fixtures.empty(spark), quality_rules.learn(fixtures.empty(spark), none)).count() == 0
    with pytest.raises(ValueError):
        quality_rules.judge(docs.withColumn("kept", F.lit(1)), quality_rules.DecisionList())


# 12


def plain_audit(docs, labels):
    """(part, order, step) -> the seven counts, one order after the other."""
    good, toxic = ({d for d, *q in labels if d is not None and q[i] == 1} for i in (0, 1))
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    rows = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and smallest[t] < d}
        rows.append((part or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in df.collect()}


def test_audit_equals_its_sql(spark):
    assert_same(queries.QUERIES["op12_filter_audit"](spark, SF), connection(SF), queries.ORACLE_SQL["op12_filter_audit"])


def test_audit_of_awkward_rows(spark):
    docs = fixtures.frame(spark).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise("x|y").alias("lang"), "node", "cell")
    docs = docs.unionByName(docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("good", F.lit(1)).withColumn("bits", F.lit(1))
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 1), (100, 0, None), (12, None, 1), (77777, 1, 1)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert audited(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert audited(filter_audit.audit(docs, spark.createDataFrame([], LABELS))) == plain_audit(rows, [])


def test_audit_blocks_add_up(spark):
    rows = spark.range(5000).select(F.concat(F.lit("p"), F.col("id") % 37).alias("part"), (F.xxhash64("id") % 32).cast("int").alias("bits"), (F.col("id") % 3 == 0).alias("good"), (F.col("id") % 5 == 0).alias("toxic")).withColumn("bits", F.abs("bits"))
    key = lambda df: sorted(map(tuple, df.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        small = key(filter_audit.step_counts(rows, block_rows=130))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == key(filter_audit.step_counts(rows)) and len(small) == 37 * 80


# 13


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    a_bytes = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return a, sp, a_bytes, b_bytes


def plain_alignment(rows, tokenizers):
    tok, sp, a_bytes, b_bytes = tokenizers
    texts, count = [], collections.Counter()
    for d, t in rows:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        data = (" " + (t or "")).encode()
        if b"".join(map(a_bytes, a)) != data or b"".join(map(b_bytes, b)) != data:
            a = b = []
        # which token of each side each byte belongs to
        of_a = [k for k, i in enumerate(a) for _ in a_bytes(i)]
        of_b = [k for k, i in enumerate(b) for _ in b_bytes(i)]
        links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(of_a, of_b))]
        groups, cur = [], ([], [])
        for p, (x, y) in enumerate(zip(of_a, of_b)):
            last_a, last_b = p + 1 == len(of_a) or of_a[p + 1] != x, p + 1 == len(of_b) or of_b[p + 1] != y
            if last_a:
                cur[0].append(str(a[x]))
            if last_b:
                cur[1].append(str(b[y]))
            if last_a and last_b:
                groups.append("|".join(",".join(c) for c in cur))
                cur = ([], [])
        count.update(links)
        texts.append((d, len(a), len(b), links, groups))
    best = collections.defaultdict(int)
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    return sorted((-1 if d is None else d, a, b, len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, x, g in texts)


def aligned(df, **more):
    out = alignment.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), **more)
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_alignment_equals_a_plain_one(spark, tokenizers, which):
    df = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else fixtures.frame(spark)
    assert aligned(df) == plain_alignment([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], tokenizers)


def test_alignment_of_random_texts(spark, tokenizers):
    rng = random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "中", "😀", "　", " ", "\x85", "\x1c", "<|endoftext|>", "<s>", "<0x0A>", "1", "23", "'s", "\x00", "​", "Zx9+", "the ", "and "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(1500)]
    rows += [(None, "no id"), (7, "a ▁ mark"), (7, "twice"), (7, "twice"), (5001, " " * 12_000), (5002, "a" + "\n" * 12_000 + " b"), (5003, "x" * 30_000), (5004, "word " * 20_000)]
    got = aligned(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_alignment(rows, tokenizers)
    assert [x for x, y in zip(got, want) if x != y] == [] and len(got) == len(want)


def test_rare_pairs_are_joined_too(spark, tokenizers):
    """With few pairs broadcast most links take the other way."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    tokens = alignment.tokenised(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    made = alignment.written(alignment.linked(tokens), "test-aligned")
    pairs = alignment.written(alignment.pair_counts(made), "test-pairs")
    sums = lambda most: sorted(map(tuple, alignment.link_sums(made, pairs, most).collect()))
    assert sums(20) == sums(10**9) == sums(1000)
    assert pairs.where(f"count * 20 >= {pairs.agg(F.sum('count')).first()[0]}").count() <= 20


def test_alignment_gives_groups_and_links(spark):
    out = alignment.align(spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), with_groups=True).orderBy("doc_id").collect()
    assert out[0]["groups"].count(";") + 1 == out[0]["n_groups"] == 2 and len(out[0]["links"]) == out[0]["n_links"]
    assert (out[1]["n_a"], out[1]["groups"], out[1]["groups_sha256"]) == (0, "", "")
    assert alignment.align(fixtures.empty(spark), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_repeated_words_are_aligned_once(spark):
    df = spark.createDataFrame([(i, " ".join(["word", "another"] * 50)) for i in range(200)], "doc_id long, text string").coalesce(1)
    tokens = alignment.tokenised(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert tokens.select(F.sum(F.size("docs")), F.sum(F.size("chunks"))).first() == (200, 2)
    assert alignment.linked(tokens).agg(F.min("n_groups"), F.max("n_groups")).first() == (100, 100)


def test_units_of_different_words_are_aligned_once(spark, tokenizers):
    """400 words made of the same parts: each part is aligned once, and no end within a unit is one of both sides."""
    parts = ["the", "and", "time", "year", "people", "way", "day", "man", "thing", "woman", "life", "child", "world", "school", "state", "family", "student", "group", "country", "problem"]
    text = " ".join(f"{x}-{y}" for x in parts for y in parts)
    df = spark.createDataFrame([(i, text if i % 2 else text[::-1]) for i in range(6)], "doc_id long, text string").coalesce(1)
    tokens = alignment.tokenised(df.where("doc_id % 2 = 1"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert tokens.select(F.sum(F.size("chunks"))).first()[0] == 400
    units = tokens.select(F.inline("units"))
    assert units.count() <= 60 and units.where(F.size(F.array_intersect("a_ends", "b_ends")) != 1).count() == 0
    assert aligned(df) == plain_alignment([(r["doc_id"], r["text"]) for r in df.collect()], tokenizers)


def test_chunks_are_numbered_anew_when_the_table_is_full():
    paths, texts = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), ["one two, three", "a ▁ mark", None, "three  four\n five-six one", ""]
    small, fresh = alignment.TokenTable(*paths, max_chunks=2), lambda: alignment.TokenTable(*paths)
    plain = lambda made: [x.to_pylist() for x in (*made[0], made[1], *made[2])]
    assert [plain(small.arrays(texts)) for _ in range(3)] == [plain(fresh().arrays(texts))] * 3
    assert plain(small.arrays(["a ▁ mark"]))[:3] == [[0], [0], [[]]]
