"""Registered queries of the training-data operators, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, embed_dedup, exact_dedup, hard_negatives, minhash, mixing, packing, quality, repeats, secret_scan,
               sharding, token_count, toxicity)
from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[F.size(secret_scan.of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
                        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held = mixing.dealt(read_table(spark, sf_dir, "documents"))
    return held.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "shards")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read_table(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("class_id").alias("component_id"), "kept", "class_size")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10)
    return hard_negatives.mine(rows, rows["vec_id"] % 100 == 0, moved)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(read_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.mark_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT a.i AS ai, a.vec_id AS anchor_id, b.i AS bi, b.vec_id AS id, a.label = b.label AS alike,
                 CAST(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) AS BIGINT) AS score
          FROM v a JOIN v b ON a.i <> b.i AND len(a.q) = len(b.q)
          WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT ai, anchor_id, bi, id AS positive_id, score AS positive_score FROM s WHERE alike
          QUALIFY row_number() OVER (PARTITION BY ai ORDER BY score DESC, id, bi) <= 5),
        n AS (
          SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.ai, p.bi ORDER BY s.score DESC, s.id, s.bi) AS rank
          FROM p JOIN s ON s.ai = p.ai AND NOT s.alike
          WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 10""",
    "op12_collocations": f"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_NORM}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        lines AS (SELECT row_number() OVER () AS p, lang, [x for x in string_split_regex(piece, '[ \\t]+') if x <> ''] AS w FROM pieces),
        words AS (SELECT p, lang, unnest(w) AS x1, generate_subscripts(w, 1) AS i FROM lines),
        runs AS (
          SELECT lang, x1, lead(x1, 1) OVER q AS x2, lead(x1, 2) OVER q AS x3, lead(x1, 3) OVER q AS x4 FROM words
          WINDOW q AS (PARTITION BY p ORDER BY i)),
        grams AS (
          SELECT lang, 1 AS k, x1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
          UNION ALL SELECT lang, 2, x1 || ' ' || x2, count(*) FROM runs WHERE x2 IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 3, x1 || ' ' || x2 || ' ' || x3, count(*) FROM runs WHERE x3 IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 4, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4, count(*) FROM runs WHERE x4 IS NOT NULL GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
        cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 30),
        split AS MATERIALIZED (
          SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
          FROM cand, (VALUES (1), (2), (3)) AS ks(c) WHERE c < k),
        parts AS MATERIALIZED (SELECT lang, phrase, f FROM grams WHERE f >= 30),
        heads AS MATERIALIZED (
          SELECT s.*, l.f AS l FROM split s JOIN parts l ON l.lang = s.lang AND l.phrase = s.head),
        cuts AS (
          SELECT s.lang, s.phrase, s.a, c, l, r.f AS r, (2000000::HUGEINT * s.a) // (l + r.f) AS score
          FROM heads s JOIN parts r ON r.lang = s.lang AND r.phrase = s.rest),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_ AS (
          SELECT lang, a, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, k - n + 2)]) AS phrase
          FROM cand, (VALUES (2), (3)) AS sizes(n) WHERE n < k),
        cover AS (SELECT lang, phrase, max(a) AS cover FROM inner_ GROUP BY lang, phrase),
        kept AS (
          SELECT lowest.* FROM lowest LEFT JOIN cover USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 80 * a)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_suffix_dedup": """
        WITH d AS (
          SELECT row_number() OVER () AS i, doc_id, octet_length(encode(coalesce(text, ''))) AS n, encode(coalesce(text, '')) AS b
          FROM documents),
        windows AS MATERIALIZED (
          SELECT i, doc_id, p, md5(b[p + 1:p + 50]) AS w
          FROM (SELECT i, doc_id, b, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
        firsts AS MATERIALIZED (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT i, p FROM windows JOIN firsts USING (w) WHERE first < doc_id),
        marks AS (SELECT i, p, CASE WHEN p - lag(p) OVER (PARTITION BY i ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone),
        numbered AS (SELECT i, p, sum(fresh) OVER (PARTITION BY i ORDER BY p) AS s FROM marks),
        spans AS (SELECT i, s, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY i, s),
        pieces AS (
          SELECT i, s.a, s.b, d.b[coalesce(lag(s.b) OVER q, 0) + 1:s.a] AS before,
                 CASE WHEN lead(s.a) OVER q IS NULL THEN d.b[s.b + 1:] ELSE ''::BLOB END AS after
          FROM spans s JOIN d USING (i) WINDOW q AS (PARTITION BY i ORDER BY s.a)),
        kept AS (
          SELECT i, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
                 sha256(unhex(string_agg(hex(before) || hex(after), '' ORDER BY a))) AS kept_sha256
          FROM pieces GROUP BY i)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               coalesce(kept_sha256, sha256(b)) AS kept_sha256
        FROM d LEFT JOIN kept USING (i)""",
}
