"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import best_fit, decontamination, language_id, merkle, packing, periodic, quality_classifier, quality_rules, sharding, simhash, tokens, url_filter, warc
from chronotext.llm.common import spread
from chronotext.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the url query: host, path, action.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), places AS (SELECT DISTINCT host, path FROM parts
), best AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(action, length(rule_host || rule_path)) AS action
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_body")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_warc(spark, path))


OP10_SQL = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, max(page_id) AS original FROM heads WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, heads.payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NULL OR original = page_id THEN NULL ELSE original END AS refers_to
FROM heads LEFT JOIN firsts ON heads.payload_digest = firsts.payload_digest
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.whole_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 1024, best_fit.patterns)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars"]
    docs = spread(table(spark, sf_dir, "documents").select(*fields, "text"))
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs.withColumn("tampered", merkle.leaf(*fields, cut)), [*fields, "text"], group="source", order="doc_id", keep=["tampered"])
    found = found.withColumn("folded_root", merkle.folded("tampered", "proof"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
      lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), heads AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    (list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1) = 1 AS tamper
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, source, i, n, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN tamper THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS tampered
  FROM heads
), nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, n, i // 3
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, n, i // 3
), numbered AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1
), sides AS (
  SELECT source, level, i, coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1
), top_sides AS (
  SELECT level, i, coalesce(string_agg(digest, '') OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1
), climb AS (
  SELECT doc_id, source, leaf, 0 AS level, i, n, tampered AS d, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, c.source, leaf, c.level + 1, c.i // 3, (c.n + 2) // 3, sha256(l || d || r), proof || l || r
  FROM climb c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.i = s.i WHERE c.n > 1
), climb_top AS (
  SELECT doc_id, leaf, subroot, 0 AS level, b.i AS i, (SELECT count(*) FROM numbered) AS n, d, proof
  FROM climb c JOIN numbered b ON c.source IS NOT DISTINCT FROM b.source WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, c.level + 1, c.i // 3, (c.n + 2) // 3, sha256(l || d || r), proof || l || r
  FROM climb_top c JOIN top_sides s ON c.level = s.level AND c.i = s.i WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, d AS folded_root,
  d = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM climb_top WHERE n = 1
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = periodic.words_array("text")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    made = F.when((h % 10 == 0) & (n > 0), F.array_join(periodic.with_period(words, a, p), " ")).otherwise(F.col("text"))
    found = periodic.find_runs(docs.select("doc_id", made.alias("text"))).withColumn("best", periodic.strongest("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.spelled("runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_benchmark_decontamination, op4_packing, op5_sharding, op6_quality_rules, op7_language_id, op8_simhash_near_dedup, op9_token_counts, op10_warc_revisits, op11_best_fit_packing, op12_merkle_manifest, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op10_warc_revisits": OP10_SQL, "op12_merkle_manifest": OP12_SQL}
