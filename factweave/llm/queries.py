"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest, jaccard, linededup, mixing, pieces, quality, reshard, rules, warc
from .common import scratch, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"), F.col("doc_id"), carry=["doc_id"])
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


#: The layout before: a source's documents lie together in one of so many shards.
OLD_SHARDS, NEW_SHARDS = 16, 16


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = reshard.reshard_to_files(table(spark, sf_dir, "documents"), old, OLD_SHARDS, NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), percent=90, size=3)


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_sentencepiece, op4_chat_formatting, op5_line_dedup, op6_resharding, op7_fingerprints, op8_ngram_jaccard, op9_rule_ledger, op10_warc)
}

SQL: dict[str, str] = {}

SQL["op2_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS lim, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM w
), c AS (SELECT *, lim * rest_weight <= rest * weight AS clamped FROM f),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN lim ELSE
    (SELECT rest / rest_weight FROM c WHERE NOT clamped ORDER BY lim / weight, rank LIMIT 1) * weight END AS target FROM c
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(round(p.target - p.whole * p.source_size) AS BIGINT) AS extra,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('20260:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - start)) AS BIGINT) AS taken FROM r
"""

SQL["op9_rule_ledger"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS s(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS BIGINT) AS n_upper_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND 2 * n_upper_words > n_words THEN 32 ELSE 0 END AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM b
"""

SQL["op10_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s FROM p),
y AS (
  SELECT *, list_transform([1, 11, 21, 31], lambda k: CAST('0x' || s[k:k+9] AS BIGINT)) AS parts, max(page_id) OVER (PARTITION BY s, payload_bytes) AS first_id FROM x
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(flatten(list_transform(parts, lambda n: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda b: (n >> b) & 31))),
    lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM y
"""

SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT r, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (
  SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r
  JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r AND 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) GROUP BY a.r, b.r
), e AS (
  SELECT a, b FROM x JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * common >= 90 * (na.n + nb.n - common)
), l AS (
  SELECT da.doc_id AS a, db.doc_id AS b FROM e JOIN d da ON da.r = e.a JOIN d db ON db.r = e.b
), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON r.id = b.a
), c AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id FROM d LEFT JOIN n USING (r) JOIN c ON c.id = d.doc_id
"""

#: Holds for tables without tool calls; with them, SQL lacks the schema checks and the levels.
SQL["op4_chat_formatting"] = r"""
SELECT conv_id, turn, role, turn AS anchor_turn, CAST(0 AS INTEGER) AS level, CAST(0 AS INTEGER) AS call_index, 'message' AS status,
  CAST(NULL AS VARCHAR[]) AS errors, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
