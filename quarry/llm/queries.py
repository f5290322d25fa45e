"""The registered queries ``op1_`` to ``op13_`` and ``pipeline``, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (backtrack_bpe, byte_bpe, filter_audit, html_extract, lattice, license_scan, ngram_join, packing, quality_classifier, quality_rules,
                        token_counts, url_filters, whitening)
from quarry.llm.common import table

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKEN_LIMIT = 512


# -- op1: the pages are the captures; fetch days and dated list entries are derived from the pages' ids, hosts and urls.

def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Hosts come on and off three lists, the domains above them on and off a fourth and on it again, and some addresses on a fifth, on days drawn from their hashes."""
    n = lambda c, start: F.conv(F.substring(F.md5(c), start, 3), 16, 10).cast("int")
    day = lambda e: F.date_add(F.lit("2024-01-01").cast("date"), e.cast("int"))
    address = url_filters.address_of(F.col("url"))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("value")).filter("value != ''").distinct()
    picked = hosts.select("value", n(F.col("value"), 1).alias("a"), n(F.col("value"), 4).alias("b")).withColumn(
        "list", F.element_at(F.array(F.lit("malware"), F.lit("adult"), F.lit("spam")), F.col("a") % 3 + 1)).filter(F.col("a") % 4 < 2)
    added = picked.select("list", F.lit("domain").alias("kind"), "value", F.lit("add").alias("action"), day(F.col("b") % 300).alias("day"))
    removed = picked.filter(F.col("b") % 2 == 0).select("list", F.lit("domain").alias("kind"), "value", F.lit("remove").alias("action"), day(F.col("b") % 300 + 60).alias("day"))
    urls = pages.select(address.alias("value")).distinct().filter(n(F.col("value"), 1) % 16 == 0).select(
        F.lit("takedown").alias("list"), F.lit("url").alias("kind"), F.when(n(F.col("value"), 7) % 2 == 0, F.concat(F.lit("HTTPS://"), F.col("value"), F.lit("#top"))).otherwise(F.col("value")).alias("value"), F.lit("add").alias("action"), day(n(F.col("value"), 4) % 366).alias("day"))
    above = hosts.select(F.regexp_extract("value", r"^[^.]+\.(.+)$", 1).alias("value")).filter("value != ''").distinct()
    above = above.select("value", n(F.col("value"), 1).alias("a"), n(F.col("value"), 4).alias("b")).filter(F.col("a") % 3 < 2)
    steps = F.filter(F.array(*[F.struct(F.lit(act).alias("action"), (F.col("b") % 200 + later).alias("on"), ok.alias("ok")) for act, later, ok in (
        ("add", 0, F.lit(True)), ("remove", 60, F.col("b") % 2 == 0), ("add", 90, F.col("b") % 4 == 0))]), lambda x: x["ok"])
    above = above.select(F.concat(F.lit("."), F.upper("value")).alias("value"), F.explode(steps).alias("s")).select(
        F.lit("network").alias("list"), F.lit("domain").alias("kind"), "value", "s.action", day(F.col("s.on")).alias("day"))
    return added.unionByName(removed).unionByName(urls).unionByName(above)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the lists that its host, a domain above it or its address was on when it was fetched."""
    pages = captures(spark, sf_dir)
    return url_filters.filter_captures(pages, list_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((((page_id * 37) % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched,
         rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)', 1)), '.') AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)', 2) AS rest
  FROM pages),
h AS (SELECT DISTINCT host AS value, CAST('0x' || substr(md5(host), 1, 3) AS INTEGER) AS a, CAST('0x' || substr(md5(host), 4, 3) AS INTEGER) AS b FROM c WHERE host != ''),
d AS (
  SELECT ['malware', 'adult', 'spam'][a % 3 + 1] AS list, value, DATE '2024-01-01' + b % 300 AS from_day,
         CASE WHEN b % 2 = 0 THEN DATE '2024-01-01' + (b % 300 + 60) END AS to_day
  FROM h WHERE a % 4 < 2),
p AS (SELECT value, CAST('0x' || substr(md5(value), 1, 3) AS INTEGER) AS a, CAST('0x' || substr(md5(value), 4, 3) AS INTEGER) AS b
      FROM (SELECT DISTINCT regexp_extract(value, '^[^.]+\.(.+)$', 1) AS value FROM h) WHERE value != ''),
dp AS (
  SELECT * FROM d
  UNION ALL SELECT 'network', value, DATE '2024-01-01' + b % 200, CASE WHEN b % 2 = 0 THEN DATE '2024-01-01' + (b % 200 + 60) END FROM p WHERE a % 3 < 2
  UNION ALL SELECT 'network', value, DATE '2024-01-01' + (b % 200 + 90), NULL FROM p WHERE a % 3 < 2 AND b % 4 = 0),
u AS (
  SELECT DISTINCT host || rest AS value, DATE '2024-01-01' + CAST('0x' || substr(md5(host || rest), 4, 3) AS INTEGER) % 366 AS from_day
  FROM c WHERE CAST('0x' || substr(md5(host || rest), 1, 3) AS INTEGER) % 16 = 0),
hits AS (
  SELECT c.url, c.fetched, d.list FROM c JOIN dp d ON (c.host = d.value OR ends_with(c.host, '.' || d.value))
    AND c.fetched >= d.from_day AND (d.to_day IS NULL OR c.fetched < d.to_day)
  UNION
  SELECT c.url, c.fetched, 'takedown' FROM c JOIN u ON c.host || c.rest = u.value AND c.fetched >= u.from_day WHERE c.host != ''),
f AS (SELECT url, fetched, string_agg(list, ',' ORDER BY list) AS lists FROM hits GROUP BY url, fetched)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(f.lists, '') AS lists, f.lists IS NOT NULL AS blocked
FROM c LEFT JOIN f ON c.url = f.url AND c.fetched = f.fetched
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), JSON_VOCABULARY, public_tokenizers.PATTERN)


def op3_lattice_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id != b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u, min(v) AS least FROM r GROUP BY u),
n AS (SELECT u, count(DISTINCT v) AS n FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), RANK_VOCABULARY, public_tokenizers.PATTERN, digests_only=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), JSON_VOCABULARY, public_tokenizers.PATTERN, TOKEN_LIMIT)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_documents(docs, license_scan.train(docs))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM f, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN cov ON d.rid = cov.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT rid, lang, source, base_failed, unnest(['chars_word', 'symbols', 'repeated_lines', 'repeated_words']) AS ratio,
         unnest([coalesce(word_chars * 100 // nullif(n_words, 0), 0), coalesce(n_symbols * 1000 // nullif(n_words, 0), 0),
                 coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0), coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)]) AS v
  FROM b),
k AS (SELECT lang, source, ratio, v - v % (1::BIGINT << greatest(length(bin(v)) - 5, 0)) AS key FROM v WHERE NOT base_failed),
lv AS (
  SELECT 3 AS level, lang, source, ratio, key FROM k UNION ALL SELECT 2, lang, NULL, ratio, key FROM k UNION ALL SELECT 1, NULL, NULL, ratio, key FROM k),
s AS (
  SELECT level, lang, source, ratio, count(*) AS n, quantile_disc(key, 0.1) AS q10, quantile_disc(key, 0.5) AS q50, quantile_disc(key, 0.9) AS q90, quantile_disc(key, 0.99) AS q99
  FROM lv GROUP BY ALL),
t AS (
  SELECT o.lang, o.source, o.ratio,
         CASE WHEN o.n >= 100 THEN o.q10 WHEN l.n >= 100 THEN l.q10 ELSE c.q10 END AS q10,
         CASE WHEN o.n >= 100 THEN o.q50 WHEN l.n >= 100 THEN l.q50 ELSE c.q50 END AS q50,
         CASE WHEN o.n >= 100 THEN o.q90 WHEN l.n >= 100 THEN l.q90 ELSE c.q90 END AS q90,
         CASE WHEN o.n >= 100 THEN o.q99 WHEN l.n >= 100 THEN l.q99 ELSE c.q99 END AS q99
  FROM s o JOIN s l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio JOIN s c ON c.level = 1 AND c.ratio = o.ratio
  WHERE o.level = 3),
lim AS (
  SELECT lang, source, ratio, q50 + quarters * (top - q50) // 4 + (1::BIGINT << greatest(length(bin(top)) - 5, 0)) AS hi,
         CASE WHEN ratio = 'chars_word' THEN q50 - 4 * (q50 - q10) - (1::BIGINT << greatest(length(bin(q50)) - 5, 0)) ELSE 0 END AS lo
  FROM (SELECT *, CASE WHEN ratio IN ('chars_word', 'symbols') THEN q90 ELSE q99 END AS top, CASE WHEN ratio IN ('chars_word', 'symbols') THEN 16 ELSE 5 END AS quarters FROM t)),
bad AS (
  SELECT DISTINCT rid FROM v JOIN lim t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.ratio = t.ratio
  WHERE v.v > hi OR v.v < lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad ON b.rid = bad.rid
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack_bpe.encode_documents(table(spark, sf_dir, "documents"), JSON_VOCABULARY, public_tokenizers.PATTERN, digests_only=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
b AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS bits
  FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM b LEFT JOIN l ON b.doc_id = l.doc_id GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS own
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, own[step] AS own, list_sum(own[1:step - 1])::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN bits & (own | coalesce(before, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN bits & own != 0 AND bits & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN bits & own != 0 AND bits & coalesce(before, 0) != 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN bits & own != 0 AND bits & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN bits & own != 0 AND bits & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_packing, op3_lattice_duplicates, op4_byte_bpe, op5_token_counts, op6_license_scan, op7_html_extraction,
    op8_quality_rules, op9_quality_classifier, op10_ngram_jaccard, op11_embedding_whitening, op12_backtracking_bpe, op13_filter_audit)}

#: The others are tested against brute force: they need tokenizers, learned models or html parsing, or are too slow in SQL on whole tables.
ORACLES = {"op1_url_filters": OP1_SQL, "op3_lattice_duplicates": OP3_SQL, "op8_quality_rules": OP8_SQL, "op13_filter_audit": OP13_SQL}
