"""Queries: L1 vector top-k, HTML text, web-result filtering and aggregation, size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import HTML_DROP_ELEMENTS, HTML_ENTITIES, PAGE_TEXT_LIMIT, html_to_text
from quarry.operators.inference import limit_status
from quarry.operators.pages import aggregate_pages, apply_choice, filter_results, page_title
from quarry.operators.search import choose_pivots, l1_search, pivot_distances
from quarry.plans import register
from quarry.session import write_table
from quarry.sources.tables import Tables


# ------------------------------------------------------------------ SCH-1 / SCH-2 vectors
def vector_corpus(embeddings: DataFrame) -> DataFrame:
    """Vector rows rendered from ``embeddings``: instance = label, 4 vectors per file."""
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("instance_id"),
        F.concat(F.lit("vec/"), F.floor(F.col("vec_id") / 4).cast("string")).alias("filename"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("elem_name"),
        F.lit("").alias("parent_name"), F.lit("function").alias("elem_type"),
        F.lit(0).cast("long").alias("split_idx"), "label", "embedding")


def centroid_queries(embeddings: DataFrame) -> DataFrame:
    """One query per instance: the element-wise mean of its vectors.

    ``posexplode`` + ``groupBy(label, pos)`` aggregates map-side, so a label
    holding a third of all vectors is combined per task before the shuffle;
    the per-label array has one entry per dimension.
    """
    e = embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg("x").alias("a"))
    q = m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("_l"))
    return q.select(F.col("label").cast("long").alias("query_id"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("instance_id"),
                    F.transform("_l", lambda s: s["a"]).alias("qvec"))


def _vector(spark, sf_dir, dedup_by_file):
    emb = Tables(spark, sf_dir).embeddings
    corpus = vector_corpus(emb)
    r = l1_search(corpus, centroid_queries(emb), k=5, dedup_by_file=dedup_by_file)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "filename", "distance")


def vector_l1_topk(spark, sf_dir):
    return _vector(spark, sf_dir, False)


def vector_l1_dedup(spark, sf_dir):
    return _vector(spark, sf_dir, True)


PIVOTS = 8


def vector_l1_pruned(spark, sf_dir):
    """The same top rows from a corpus that stores distances to pivots: rows out of reach are never compared."""
    emb = Tables(spark, sf_dir).embeddings
    corpus = vector_corpus(emb)
    pivots = choose_pivots(corpus, PIVOTS)
    stored = write_table(corpus.withColumn("pivot_distances", pivot_distances("embedding", pivots)), "pivot_corpus")
    r = l1_search(stored, centroid_queries(emb), k=5, dedup_by_file=False, pivots=pivots)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "filename", "distance")


def _vector_sql(by_file: bool) -> str:
    key = "filename" if by_file else "filename, elem_name, parent_name, elem_type, split_idx"
    return f"""
WITH corpus AS (
  SELECT vec_id AS id, label, 'vec/' || CAST(vec_id // 4 AS VARCHAR) AS filename, 'v' || CAST(vec_id AS VARCHAR) AS elem_name,
         '' AS parent_name, 'function' AS elem_type, CAST(0 AS BIGINT) AS split_idx, embedding
  FROM embeddings WHERE len(embedding) > 0),
ex AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
cent AS (SELECT label, list(a ORDER BY pos) AS qvec FROM (SELECT label, pos, avg(x) AS a FROM ex GROUP BY label, pos) GROUP BY label),
sc AS (
  SELECT CAST(c.label AS BIGINT) AS query_id, c.id, c.filename, c.elem_name, c.parent_name, c.elem_type, c.split_idx,
         round(list_sum(list_transform(range(len(c.embedding)), lambda i: abs(CAST(c.embedding[i + 1] AS DOUBLE) - q.qvec[i + 1]))), 6) AS distance
  FROM corpus c JOIN cent q USING (label)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM sc QUALIFY r <= 15),
dd AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id, {key} ORDER BY r) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM dd)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, filename, distance FROM rk WHERE rank <= 5
"""


register("vector_l1_topk", _vector_sql(False))(vector_l1_topk)
register("vector_l1_dedup", _vector_sql(True))(vector_l1_dedup)
register("vector_l1_pruned", _vector_sql(False))(vector_l1_pruned)


# ------------------------------------------------------------------ TXT-9 / TXT-10
def html_text(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    t = html_to_text(F.col("html"), PAGE_TEXT_LIMIT)
    return p.select("page_id", F.length(t).cast("long").alias("text_len"), F.md5(t).alias("text_md5"))


def html_to_text_sql(expr: str, limit: int | None = PAGE_TEXT_LIMIT) -> str:
    # a body without its end tag reaches to the end of the page
    t = f"regexp_extract({expr}, '(?is)<body\\b[^>]*>(.*)', 1)"
    t = f"regexp_replace({t}, '(?is)^(.*)</body\\s*>.*$', '\\1')"
    t = f"regexp_replace({t}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for el in HTML_DROP_ELEMENTS:
        t = f"regexp_replace({t}, '(?is)<{el}\\b[^>]*>.*?(?:</{el}\\s*>|\\z)', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for ent, ch in HTML_ENTITIES:
        t = f"replace({t}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return t if limit is None else f"substring({t}, 1, {limit})"


register("html_text", f"""
SELECT page_id, CAST(length(t) AS BIGINT) AS text_len, md5(t) AS text_md5
FROM (SELECT page_id, {html_to_text_sql('html')} AS t FROM pages)
""")(html_text)


# ------------------------------------------------------------------ FLT-4 / FLT-5 / SCH-17 / SCH-20
GROUP_SIZE = 10  # results per rendered query


def page_results(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and items rendered from ``pages``.

    Query ``q`` has the pages ``10q .. 10q+9`` as its results (a search
    returns a bounded list); every fifth page is moved to an excluded host;
    the query's repo is named after the site of its last result.
    """
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    r = pages.select(
        "page_id",
        F.floor(F.col("page_id") / GROUP_SIZE).cast("long").alias("query_id"),
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", r"://[^/]+", "://github.com")).otherwise(F.col("url")).alias("url"),
        F.regexp_extract(host, r"([^.]+)\.example\.", 1).alias("site"),
        page_title("html").alias("title"),
        html_to_text(F.col("html")).alias("description"),
        "html",
    )
    w = Window.partitionBy("query_id").orderBy("page_id")
    r = r.withColumn("result_idx", (F.row_number().over(w) - 1).cast("long"))
    items = r.groupBy("query_id").agg(F.concat(F.lit("org/"), F.max_by("site", "page_id")).alias("repo"))
    return r.drop("site"), items


def self_reference_filter(spark, sf_dir):
    results, items = page_results(Tables(spark, sf_dir).pages)
    kept = filter_results(results, items)
    return kept.select("query_id", "result_idx", "page_id")


CHOICE_SCHEMA_LIST = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType()))])
CHOICE_SCHEMA_INT = T.StructType([T.StructField("indices", T.IntegerType())])


def parse_indices(payload) -> "F.Column":
    """``{"indices": [..]}`` or ``{"indices": n}`` -> array<int> (RSP-5, RSP-6)."""
    as_list = F.from_json(payload, CHOICE_SCHEMA_LIST)["indices"]
    as_int = F.from_json(payload, CHOICE_SCHEMA_INT)["indices"]
    return F.coalesce(as_list, F.when(as_int.isNotNull(), F.array(as_int)))


def page_aggregate(spark, sf_dir):
    results, items = page_results(Tables(spark, sf_dir).pages)
    kept = filter_results(results, items)
    n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    # the choice arrives as a JSON reply: last and first result, or only the last
    payload = F.when(F.col("n") % 2 == 0, F.format_string('{"indices": [%d, 0]}', F.col("n") - 1)) \
               .otherwise(F.format_string('{"indices": %d}', F.col("n") - 1))
    choices = n.select("query_id", parse_indices(payload).alias("indices"))
    chosen = apply_choice(kept, choices)
    agg = aggregate_pages(chosen, items, limit=PAGE_TEXT_LIMIT)
    return agg.select("query_id", "n_parts", F.length("block").cast("long").alias("text_len"), F.md5("block").alias("text_md5"))


_PAGES_SQL = f"""
res0 AS (
  SELECT page_id, CAST(floor(page_id / {GROUP_SIZE}) AS BIGINT) AS query_id,
         CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '://[^/]+', '://github.com') ELSE url END AS url,
         regexp_extract(regexp_extract(url, '://([^/]+)', 1), '([^.]+)\\.example\\.', 1) AS site,
         regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
         {html_to_text_sql('html', None)} AS description, html
  FROM pages),
items AS (SELECT query_id, 'org/' || arg_max(site, page_id) AS repo FROM res0 GROUP BY query_id),
kept0 AS (
  SELECT r.* FROM res0 r JOIN items i USING (query_id)
  WHERE NOT contains(lower(concat_ws(' ', r.title, r.description, r.url)), lower(string_split(i.repo, '/')[-1]))
    AND NOT contains(r.url, '/github.com')),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS BIGINT) AS result_idx FROM kept0)"""

register("self_reference_filter", f"""
WITH {_PAGES_SQL}
SELECT query_id, result_idx, page_id FROM kept
""")(self_reference_filter)

register("page_aggregate", f"""
WITH {_PAGES_SQL},
n AS (SELECT query_id, count(*) AS n FROM kept GROUP BY query_id),
picks AS (
  SELECT query_id, n - 1 AS result_idx, 0 AS pick_ord FROM n WHERE n > 2
  UNION ALL SELECT query_id, 0, 1 FROM n WHERE n > 2 AND n % 2 = 0),
chosen AS (
  SELECT k.*, CAST(k.result_idx AS INTEGER) AS pick_ord FROM kept k JOIN n USING (query_id) WHERE n.n <= 2
  UNION ALL SELECT k.*, p.pick_ord FROM kept k JOIN n USING (query_id) JOIN picks p ON p.query_id = k.query_id AND p.result_idx = k.result_idx WHERE n.n > 2),
blocks AS (
  SELECT query_id, pick_ord, '---' || chr(10) || 'URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || 'Description:' || chr(10)
         || description || chr(10) || 'Extracted Page Content:' || chr(10) || chr(10) || {html_to_text_sql('html')} || chr(10) || '---' AS block
  FROM chosen),
agg AS (SELECT query_id, string_agg(block, chr(10) ORDER BY pick_ord) AS block, CAST(count(*) AS BIGINT) AS n_parts FROM blocks GROUP BY query_id)
SELECT a.query_id, a.n_parts, CAST(length(a.block) AS BIGINT) AS text_len, md5(a.block) AS text_md5
FROM agg a JOIN items i USING (query_id)
WHERE NOT contains(lower(a.block), lower(string_split(i.repo, '/')[-1]))
""")(page_aggregate)


# ------------------------------------------------------------------ FLT-6 size limits
def size_limits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.documents.select(F.lit("embed").alias("kind"), F.col("doc_id").alias("key"),
                              F.length("text").cast("long").alias("n_chars"))
    # prompt = turns joined by newlines; its length needs no string assembly
    conv = t.conversations.groupBy("conv_id").agg(
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).cast("long").alias("n_chars"))
    conv = conv.select(F.lit("prompt").alias("kind"), F.col("conv_id").alias("key"), "n_chars")
    both = docs.unionByName(conv)
    return both.withColumn("status", limit_status(F.col("kind"), F.col("n_chars")))


register("size_limits", """
SELECT 'embed' AS kind, doc_id AS key, CAST(length(text) AS BIGINT) AS n_chars,
       CASE WHEN length(text) <= 5000 THEN 'ok' ELSE 'token_limit' END AS status FROM documents
UNION ALL
SELECT 'prompt', conv_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT),
       CASE WHEN sum(length(text)) + count(*) - 1 <= 96000 THEN 'ok' ELSE 'token_limit' END FROM conversations GROUP BY conv_id
""")(size_limits)


# ------------------------------------------------------------------ PRM-2, PRM-5, PRM-6
from quarry.operators.render import NO_FILES_TEXT, file_for_prompt  # noqa: E402
from quarry.operators.pages import ordered_text  # noqa: E402
from quarry.plans.fixtures import doc_filename  # noqa: E402

FILES_PER_RETRIEVAL = 3


def retrieved_files(documents: DataFrame) -> DataFrame:
    """Retrieved files: 3 documents per instance, each with one or two half-open line ranges."""
    m = F.col("doc_id") % 4
    r1 = F.struct((m + 1).cast("int").alias("start"), (m + 4).cast("int").alias("end"))
    r2 = F.struct((m + 6).cast("int").alias("start"), (m + 8).cast("int").alias("end"))
    ranges = F.when(F.col("doc_id") % 2 == 0, F.array(r1, r2)).otherwise(F.array(r1))
    return documents.select(F.floor(F.col("doc_id") / FILES_PER_RETRIEVAL).cast("long").alias("instance_id"), "doc_id",
                            doc_filename().alias("path"), F.col("text").alias("content"), ranges.alias("ranges"))


def file_render(spark, sf_dir):
    f = retrieved_files(Tables(spark, sf_dir).documents)
    f = f.withColumn("block", file_for_prompt(F.col("path"), F.col("content"), F.col("ranges"), "FILE_AND_LINES"))
    t = ordered_text(f, "instance_id", "doc_id", "block")
    t = t.withColumn("block", F.coalesce(F.col("block"), F.lit(NO_FILES_TEXT)))
    return t.select("instance_id", "n_parts", F.length("block").cast("long").alias("text_len"), F.md5("block").alias("text_md5"))


def _num_sql(num: str, width: str) -> str:
    return (f"(CASE WHEN length(CAST({num} AS VARCHAR)) >= {width} THEN CAST({num} AS VARCHAR) "
            f"ELSE lpad(CAST({num} AS VARCHAR), CAST({width} AS INTEGER), ' ') END)")


def _section_sql(s: str, e: str) -> str:
    body = (f"array_to_string(list_transform(list_slice(ls, {s}, {e} - 1), lambda x, i: "
            f"{_num_sql(f'i + {s} - 1', f'length(CAST({e} AS VARCHAR))')} || ' |' || x), chr(10))")
    return (f"'Here is a portion of ' || path || ' from line ' || CAST({s} AS VARCHAR) || ' to ' || CAST({e} - 1 AS VARCHAR) "
            f"|| ':' || chr(10) || '```py' || chr(10) || {body} || chr(10) || '```'")


register("file_render", f"""
WITH f AS (
  SELECT CAST(floor(doc_id / {FILES_PER_RETRIEVAL}) AS BIGINT) AS instance_id, doc_id, string_split(text, chr(10)) AS ls,
         source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
           || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS path,
         doc_id % 4 AS m FROM documents),
b AS (
  SELECT instance_id, doc_id,
         chr(10) || '-----' || chr(10) || 'Here is the full content of ' || path || ':' || chr(10)
         || array_to_string(list_transform(ls, lambda x, i: {_num_sql('i', 'length(CAST(len(ls) + 1 AS VARCHAR))')} || ' |' || x), chr(10))
         || chr(10) || '-----' || chr(10)
         || chr(10) || '-----' || chr(10)
         || CASE WHEN doc_id % 2 = 0 THEN {_section_sql('m + 1', 'm + 4')} || chr(10) || '-----' || chr(10) || {_section_sql('m + 6', 'm + 8')}
                 ELSE {_section_sql('m + 1', 'm + 4')} END
         || chr(10) || '-----' || chr(10) AS block
  FROM f),
t AS (SELECT instance_id, string_agg(block, chr(10) ORDER BY doc_id) AS block, CAST(count(*) AS BIGINT) AS n_parts FROM b GROUP BY instance_id)
SELECT instance_id, n_parts, CAST(length(block) AS BIGINT) AS text_len, md5(block) AS text_md5 FROM t
""")(file_render)
