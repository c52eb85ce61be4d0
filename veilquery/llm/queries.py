"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilquery.llm import decontaminate, fingerprints, license_scan, packing, passage_dedup, quality, simhash_dedup, suffix_dedup, suffix_tree_lm, url_filter
from veilquery.llm.common import table

#: The rules of the URL query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.report(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_quality_classifier, op4_document_fingerprints, op5_suffix_array_dedup, op6_url_filters, op7_lm_scoring, op8_license_scans, op9_substring_dedup, op10_best_fit_packing)}

SQL = {
    "op5_suffix_array_dedup": r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, o, substr(h, 2 * o + 1, 2 * (2048 + 399)) AS p FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 399)::BIGINT, 2048)) AS o FROM texts)),
wins AS (SELECT r, o + i AS i, md5(substr(p, 2 * i + 1, 800)) AS k FROM (SELECT r, o, p, unnest(range(0, least(2048, length(p) // 2 - 399)::BIGINT)) AS i FROM blocks)),
twice AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1),
marks AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM wins SEMI JOIN twice USING (k)),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marks) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a::BIGINT + 1, 2 * (coalesce(b, length(h) // 2) - a)::BIGINT), '' ORDER BY a, b) AS h FROM gaps JOIN texts USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY r)
SELECT doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)
""",
    "op2_benchmark_decontamination": r"""
WITH texts AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
hits AS (
  SELECT DISTINCT t.id, t.i, t.n, win.id AS item
  FROM (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM texts, lens WHERE len(w) >= n)) t JOIN win ON win.n = t.n AND win.span = t.span),
words AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item::VARCHAR))), ',') AS names FROM hits GROUP BY id)
SELECT t.id AS doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t.w) AS contaminated
FROM texts t LEFT JOIN words USING (id) LEFT JOIN named USING (id)
""",
    "op6_url_filters": r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts)
SELECT c.page_id, c.host, c.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, coalesce(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
FROM cut c LEFT JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
GROUP BY c.page_id, c.host, c.path
""",
}
