"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, filter_audit, jaccard_join, mixing, neighbours, preferences, quality, quality_rules, secrets, sentence_pieces, sharding, token_counts
from .shared import shared_dir, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.digests(sentence_pieces.encode_decode(docs, _tokenizer("piece_bpe_32k.model")))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preferences.format_conversations(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("pair_id", "segment", "part", "n_turns", "text", spans.alias("mask_spans"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "kept")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scans": op8_secret_scans,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op3_preference_pairs": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
             f AS (SELECT conv_id, row_number() OVER w - 1 AS k, lead(conv_id) OVER w AS nxt, lag(conv_id) OVER w AS lst FROM t WHERE pos = 0 WINDOW w AS (PARTITION BY role, text ORDER BY conv_id)),
             p AS (SELECT conv_id, CASE WHEN k % 2 = 0 THEN conv_id ELSE lst END AS pair_id, k % 2 AS side, k % 2 = 0 AND nxt IS NULL AS alone FROM f),
             a AS (SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same, bool_or(alone) AS alone FROM t JOIN p USING (conv_id) GROUP BY 1, 2),
             x AS (SELECT pair_id, CASE WHEN bool_or(alone) THEN max(pos) ELSE coalesce(min(pos) FILTER (NOT same), max(pos) + 1) END AS prefix FROM a GROUP BY 1),
             s AS (SELECT pair_id, CASE WHEN pos < prefix THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS segment, pos // 64 AS part, pos, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, length(text) AS len
                   FROM t JOIN p USING (conv_id) JOIN x USING (pair_id) WHERE NOT (pos < prefix AND side = 1)),
             o AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, segment, part ORDER BY pos) - length(shown) + 13 + length(role) AS begin FROM s)
        SELECT pair_id, segment, part, count(*) AS n_turns, string_agg(shown, '' ORDER BY pos) AS text,
               coalesce(string_agg(CAST(begin AS BIGINT) || ':' || CAST(begin + len + 10 AS BIGINT), ',' ORDER BY pos) FILTER (role = 'assistant' AND segment <> 'prompt'), '') AS mask_spans
        FROM o GROUP BY 1, 2, 3""",
    # every pair of documents that share a shingle, and the closure of their links
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
             v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT doc_id AS d, doc_id AS o FROM n UNION SELECT r.d, v.b FROM r JOIN v ON v.a = r.o),
             c AS (SELECT d, min(o) AS c FROM r GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.d = w.doc_id""",
    # A-Z alone are folded; DuckDB's translate does the same
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
    # bits of each row, rows by part, bits and labels, and the steps of the 120 orders over those
    "op12_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
             m AS (SELECT doc_id AS d, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
             b AS (SELECT part, (len(l) < 100)::INT + 2 * (100 * len(list_distinct(l)) < 80 * len(l))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
                          + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
                   FROM w LEFT JOIN m ON d = doc_id),
             c AS (SELECT part, bits, good, toxic, count(*) AS n FROM b GROUP BY ALL),
             v(i) AS (VALUES (0), (1), (2), (3), (4)),
             o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS p FROM v p JOIN v q ON q.i <> p.i JOIN v r ON r.i NOT IN (p.i, q.i) JOIN v s ON s.i NOT IN (p.i, q.i, r.i) JOIN v t ON t.i NOT IN (p.i, q.i, r.i, s.i)),
             x AS (SELECT array_to_string(list_transform(p, lambda i: chr(65 + i)), '') AS filter_order, CAST(step AS INT) AS step, 1 << p[step] AS f, coalesce(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
             y AS (SELECT part, filter_order, step, f,
                          coalesce(sum(n) FILTER (bits & (before | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & f > 0 AND bits & before = 0), 0)::BIGINT AS removed,
                          coalesce(sum(n) FILTER (bits & f > 0 AND bits & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = f), 0)::BIGINT AS unique_fails,
                          coalesce(sum(n) FILTER (bits & f > 0 AND bits & before = 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bits & f > 0 AND bits & before = 0 AND toxic), 0)::BIGINT AS toxic_lost
                   FROM c CROSS JOIN x GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM y""",
}
