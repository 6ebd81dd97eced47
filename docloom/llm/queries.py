"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe_codec import digest_documents
from docloom.llm.common import read_table
from docloom.llm.decontaminate import find_leaks
from docloom.llm.language_id import fit_language, identify_documents
from docloom.llm.quality_classifier import fit_quality, score_documents
from docloom.llm.quality_rules import fit_rules, judge_documents
from docloom.llm.sharding import MULTIPLIER, assign_shards
from docloom.llm.simhash_dedup import near_duplicates
from docloom.llm.suffix_dedup import remove_repeats
from docloom.llm.token_count import count_documents
from docloom.llm.url_lists import URL, captures_of, judge_captures, lists_of


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the place; clean documents have no row."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("row")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge_documents(docs, fit_rules(docs, read_table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify_documents(docs, fit_language(docs))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge_captures(captures_of(pages), lists_of(pages))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 40)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE jumps AS (
  SELECT doc_id, (CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k::HUGEINT END)::UHUGEINT AS state, -1::BIGINT AS shard, -1::BIGINT AS grown, 0::BIGINT AS nxt
  FROM (SELECT DISTINCT doc_id, coalesce(doc_id, 0) AS k FROM documents)
  UNION ALL
  SELECT doc_id, moved, CASE WHEN nxt < 40 THEN nxt ELSE shard END, nxt,
    floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((moved // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS moved FROM jumps WHERE nxt <= 40)
), last AS (SELECT doc_id, shard, grown FROM jumps WHERE nxt > 40),
crc_byte AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS c FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_byte),
sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]))) AS text_crc32
  FROM documents, crc_table)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, l.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY l.shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot, l.grown::INTEGER AS grown_shard
FROM sized s JOIN last l ON s.doc_id IS NOT DISTINCT FROM l.doc_id
"""

URL_PATTERN = URL.replace("'", "''")
OP7_SQL = rf"""
WITH named AS (
  SELECT page_id, url, DATE '2020-01-01' + (('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 6))::BIGINT % 1461)::INTEGER AS fetched,
    lower(regexp_extract(url, '{URL_PATTERN}', 1)) AS host, regexp_extract(url, '{URL_PATTERN}', 2) AS path FROM pages),
captures AS (SELECT DISTINCT * FROM named),
names AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS segment FROM named WHERE host <> ''),
patterns AS (
  SELECT 'host' AS kind, host AS pattern, 3 AS share FROM names
  UNION SELECT 'prefix', host || '/' || segment, 10 FROM names WHERE segment <> ''
  UNION SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 2 FROM names WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
drawn AS (SELECT *, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS n, ('0x' || substr(md5(pattern), 7, 6))::BIGINT AS k FROM patterns),
spans AS (
  SELECT kind, pattern, k % 700 AS since, CASE WHEN k % 5 < 4 THEN k % 700 + 1 + k % 400 END AS until FROM drawn WHERE n % share = 0
  UNION ALL SELECT kind, pattern, k % 700 + 401 + k % 300, NULL FROM drawn WHERE n % share = 0 AND k % 5 < 2),
hits AS (
  SELECT c.page_id, c.url, c.fetched, s.kind FROM captures c JOIN spans s ON c.host <> '' AND c.fetched - DATE '2020-01-01' >= s.since AND (s.until IS NULL OR c.fetched - DATE '2020-01-01' < s.until)
   AND CASE s.kind WHEN 'host' THEN c.host = s.pattern WHEN 'domain' THEN c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
       ELSE c.host || c.path = s.pattern OR starts_with(c.host || c.path, s.pattern || '/') END),
found AS (SELECT page_id, url, fetched, count(*) AS n_matches, string_agg(DISTINCT kind || 's', ',' ORDER BY kind || 's') AS lists FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, f.n_matches IS NOT NULL AS blocked, coalesce(f.n_matches, 0)::BIGINT AS n_matches, coalesce(f.lists, '') AS lists
FROM captures c LEFT JOIN found f ON c.page_id IS NOT DISTINCT FROM f.page_id AND c.url IS NOT DISTINCT FROM f.url AND c.fetched = f.fetched
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_token_count": op3_token_count,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_dedup": op10_simhash_dedup,
}
ORACLES: dict[str, str] = {"op6_sharding": OP6_SQL, "op7_url_filter": OP7_SQL}
