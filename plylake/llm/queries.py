"""The queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plylake.llm import (
    bpe, collocations, exact_dedup, imatch, language_id, mixing, near_dedup, prefix_trie, secret_scan, substring_dedup,
    token_shards, url_rules, vector_dedup,
)
from plylake.llm.common import table

RANKS, WORDS, END = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", 2
#: The rules of the URL query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.whole_repeats(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    def of_kind(kind: int) -> Column:
        # a lambda of two parameters would be given the span's place in the list as the second
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2("base_line", 256).alias("base_sha256"), F.col("line").alias("spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_exact_dedup, op3_mix, op4_url_rules, op5_substring_dedup, op6_secret_scan, op7_near_dedup,
        op8_token_shards, op9_language_id, op10_imatch, op11_collocations, op12_vector_dedup,
        op13_prefix_trie,
    )
}

ORACLES = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op3_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || doc_id) AS dice
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0.0) AS free,
         sum(source_size) OVER () * 1.5::DOUBLE AS want, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (want - capped) / free AS level FROM o WHERE (want - capped) / free * w <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(w * level, cap) AS target, w * level >= cap AS clamped FROM s, l),
p AS (
  SELECT d.*, source_size, target, clamped, CASE WHEN clamped THEN 2 WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY dice, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN NOT clamped AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p""",
    "op4_url_rules": r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS verdict
  FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM spots, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1 AND f >= 100),
parts AS (
  SELECT lang, phrase, f, unnest(range(1, k)) AS cut, ws FROM cand),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, cut, l.f AS l, r.f AS r, n,
         ((1000::HUGEINT * p.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts p
  JOIN grams l ON l.lang = p.lang AND l.phrase = array_to_string(p.ws[1:cut], ' ')
  JOIN grams r ON r.lang = p.lang AND r.phrase = array_to_string(p.ws[cut + 1:], ' ')
  JOIN totals t ON t.lang = p.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT c.lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS around
  FROM cand c, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(2, 5)) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE around IS NULL OR around < a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op12_vector_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
         AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id""",
}
