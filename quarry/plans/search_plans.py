"""Queries over the content table: chunking, tagging, index, BM25, L1, filters."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import adler32_bucket
from quarry.functions.text import exact_only, raw_elem_type
from quarry.operators.chunking import fixed_chunks
from quarry.operators.index import build_text_index, corpus_stats
from quarry.operators.search import bm25_search, l1_search
from quarry.plans import register
from quarry.plans.fixtures import CAP, CONTENT_ROWS_SQL, chunk_offsets_sql, content_rows, tokens_sql
from quarry.sources.tables import Tables

N_SHARDS = 8
_PUNCT_SQL = string.punctuation.replace("'", "''")
_SPACES_SQL = " " * len(string.punctuation)


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_rows(Tables(spark, sf_dir).colocated("documents"))


# ------------------------------------------------------------------ TXT-1a / TXT-1c
def chunk_fixed(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    ch = fixed_chunks(docs, "text", CAP)
    return ch.select("doc_id", "split_idx", F.length("text").cast("long").alias("chunk_len"),
                     F.md5("text").alias("chunk_md5"))


register("chunk_fixed", f"""
SELECT doc_id, CAST(split_idx AS BIGINT) AS split_idx, CAST(length(c) AS BIGINT) AS chunk_len, md5(c) AS chunk_md5
FROM (SELECT doc_id, split_idx, substring(text, split_idx + 1, {CAP}) AS c
      FROM (SELECT doc_id, text, unnest({chunk_offsets_sql('length(text)')}) AS split_idx
            FROM documents WHERE length(text) > 0))
""")(chunk_fixed)


# ------------------------------------------------------------------ TXT-2 / TXT-3
def tag_exact_only(spark, sf_dir):
    c = _content(spark, sf_dir)
    return c.select("id", "filename", "elem_type", "display_level",
                    exact_only("filename", "elem_name", "display_level").cast("long").alias("exact_only"),
                    raw_elem_type("filename").alias("raw_elem_type"))


register("tag_exact_only", f"""
WITH {CONTENT_ROWS_SQL}
SELECT id, filename, elem_type, display_level,
       CAST((filename LIKE '%test%' OR elem_name LIKE '%test%' OR filename LIKE '%example%'
             OR elem_name LIKE '%example%' OR display_level = 'full') AS BIGINT) AS exact_only,
       CASE WHEN suffix(filename, '.py') THEN 'module' WHEN contains(filename, 'README') THEN 'readme' ELSE 'other' END AS raw_elem_type
FROM content_rows
""")(tag_exact_only)


# ------------------------------------------------------------------ TXT-5 / TXT-6
_TOKS_SQL = f"""
toks AS (
  SELECT id, instance_id, list_concat({tokens_sql('filename')}, {tokens_sql('content')}) AS t FROM content_rows
),
lens AS (SELECT id, instance_id, CAST(len(t) AS BIGINT) AS dl FROM toks),
post AS (
  SELECT id, instance_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT id, instance_id, unnest(t) AS term FROM toks) GROUP BY id, instance_id, term
)"""


def postings(spark, sf_dir):
    idx = build_text_index(_content(spark, sf_dir), colocated_by="doc_id")
    return idx.terms().select("id", "term", "tf", "dl")


register("postings", f"""
WITH {CONTENT_ROWS_SQL},
{_TOKS_SQL}
SELECT p.id, p.term, p.tf, l.dl FROM post p JOIN lens l USING (id)
""")(postings)


# ------------------------------------------------------------------ SCH-4 statistics
def _adler_bucket_sql(expr: str, n: int) -> str:
    # ASCII keys: adler32 low word = 1 + byte sum (mod 65521); n divides 65536
    return (f"CAST(((1 + list_sum(list_transform(string_split({expr}, ''), lambda ch: ascii(ch)))) % 65521) % {n} AS BIGINT)")


def _with_shard(c: DataFrame) -> DataFrame:
    return c.withColumn("shard", adler32_bucket("instance_id", N_SHARDS))


def corpus_stats_q(spark, sf_dir):
    idx = build_text_index(_with_shard(_content(spark, sf_dir)), scope_cols=("instance_id", "shard"), colocated_by="doc_id")
    whole = corpus_stats(idx).select(F.lit("corpus").alias("scope"), F.lit(-1).cast("long").alias("shard"), "n_rows", "total_len")
    per = corpus_stats(idx, ["shard"]).select(F.lit("shard").alias("scope"), "shard", "n_rows", "total_len")
    return whole.unionByName(per)


register("corpus_stats", f"""
WITH {CONTENT_ROWS_SQL},
{_TOKS_SQL},
sh AS (SELECT *, {_adler_bucket_sql('instance_id', N_SHARDS)} AS shard FROM lens)
SELECT 'corpus' AS scope, CAST(-1 AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(dl) AS BIGINT) AS total_len FROM sh
UNION ALL
SELECT 'shard' AS scope, shard, CAST(count(*) AS BIGINT), CAST(sum(dl) AS BIGINT) FROM sh GROUP BY shard
""")(corpus_stats_q)


# ------------------------------------------------------------------ SCH-3..SCH-7 BM25
def _bench_queries(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("query_id"), "text")


def _bm25_out(r: DataFrame) -> DataFrame:
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "doc_id", "filename",
                    "elem_type", "split_idx", "distance")


def bm25_topk(spark, sf_dir):
    c = _content(spark, sf_dir)
    idx = build_text_index(c, colocated_by="doc_id").materialize()
    return _bm25_out(bm25_search(idx, c, _bench_queries(spark, sf_dir), k=5, per_instance=False))


def bm25_topk_shard_stats(spark, sf_dir):
    c = _with_shard(_content(spark, sf_dir))
    idx = build_text_index(c, scope_cols=("instance_id", "shard"), colocated_by="doc_id").materialize()
    return _bm25_out(bm25_search(idx, c, _bench_queries(spark, sf_dir), k=5, per_instance=False,
                                 stats_scope=("shard",)))


def search_filters(spark, sf_dir):
    c = _content(spark, sf_dir)
    idx = build_text_index(c, colocated_by="doc_id").materialize()
    return _bm25_out(bm25_search(idx, c, _bench_queries(spark, sf_dir), k=3, per_instance=False,
                                 elem_type="code", in_dirs=["src1", "src2/en"]))


def _bm25_sql(k: int, scope: str = "corpus", where: str = "TRUE", dirs: str | None = None, over_fetch: int = 3) -> str:
    shard_cols = scope == "shard"
    skey = "shard" if shard_cols else "0"
    in_dirs = """
    AND (NOT EXISTS (SELECT 1 FROM dirs d WHERE d.query_id = sc.query_id)
         OR EXISTS (SELECT 1 FROM dirs d JOIN content_rows c ON starts_with(lower(c.filename), lower(d.dir)) WHERE d.query_id = sc.query_id AND c.id = sc.id))""" if dirs else ""
    return f"""
WITH {f"dirs AS ({dirs})," if dirs else ""}{CONTENT_ROWS_SQL},
{_TOKS_SQL},
lens2 AS (SELECT *, {(_adler_bucket_sql('instance_id', N_SHARDS) if shard_cols else '0')} AS skey FROM lens),
post2 AS (SELECT p.*, l.dl, l.skey FROM post p JOIN lens2 l USING (id)),
stats AS (SELECT skey, count(*) AS n_rows, sum(dl) / count(*) AS avgdl FROM lens2 GROUP BY skey),
q AS (SELECT item_id AS query_id, text FROM benchmark),
qt AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, unnest({tokens_sql(f"translate(text, '{_PUNCT_SQL}', '{_SPACES_SQL}')")}) AS term FROM q)
  GROUP BY query_id, term
),
nt AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
dfr AS (SELECT skey, term, count(*) AS df FROM post2 WHERE term IN (SELECT term FROM qt) GROUP BY skey, term),
sc AS (
  SELECT qt.query_id, p.id,
         sum(qt.qtf * (CASE WHEN ln((s.n_rows - d.df + 0.5) / (d.df + 0.5)) <= 0 THEN 1e-6
                            ELSE ln((s.n_rows - d.df + 0.5) / (d.df + 0.5)) END)
             * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.avgdl))) AS s,
         count(*) AS m
  FROM qt JOIN post2 p USING (term) JOIN dfr d ON d.term = p.term AND d.skey = p.skey JOIN stats s ON s.skey = p.skey
  GROUP BY qt.query_id, p.id
),
hits AS (
  SELECT sc.query_id, sc.id, round(-sc.s, 6) AS distance FROM sc JOIN nt USING (query_id)
  WHERE sc.m = nt.n_terms AND sc.id IN (SELECT id FROM content_rows WHERE {where}){in_dirs}
),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM hits QUALIFY r <= {over_fetch * k}),
j AS (SELECT top.*, c.doc_id, c.filename, c.elem_name, c.parent_name, c.elem_type, c.split_idx FROM top JOIN content_rows c USING (id)),
dd AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, filename, elem_name, parent_name, elem_type, split_idx ORDER BY r) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM dd)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, doc_id, filename, elem_type, split_idx, distance FROM rk WHERE rank <= {k}
"""


register("bm25_topk", _bm25_sql(5))(bm25_topk)
register("bm25_topk_shard_stats", _bm25_sql(5, scope="shard"))(bm25_topk_shard_stats)
register("search_filters", _bm25_sql(
    3, where="elem_type NOT IN ('readme', 'other') AND filename NOT ILIKE '%tests%' "
             "AND (filename ILIKE 'src1%' OR filename ILIKE 'src2/en%')"))(search_filters)


# ------------------------------------------------------------------ FLT-2 / JN-3: directories of each query
def query_dirs(benchmark: DataFrame) -> DataFrame:
    """``(query_id, dir)``: two directories for most queries, one of them in capitals; every fourth query names none."""
    i = F.col("item_id")
    src = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    d = F.array(F.concat(src(i), F.lit("/")), F.concat(F.upper(src(i * 7 + 1)), F.lit("/"), F.when(i % 2 == 0, F.lit("en")).otherwise(F.lit(""))))
    return benchmark.where(i % 4 != 3).select(i.alias("query_id"), F.explode(d).alias("dir"))


def search_in_dirs(spark, sf_dir):
    c = _content(spark, sf_dir)
    idx = build_text_index(c, colocated_by="doc_id").materialize()
    return _bm25_out(bm25_search(idx, c, _bench_queries(spark, sf_dir), k=5, per_instance=False, in_dirs=query_dirs(Tables(spark, sf_dir).benchmark)))


_QUERY_DIRS_SQL = """SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) || '/' AS dir FROM benchmark WHERE item_id % 4 != 3
  UNION ALL SELECT item_id, 'SRC' || CAST((item_id * 7 + 1) % 20 AS VARCHAR) || CASE WHEN item_id % 2 = 0 THEN '/en' ELSE '/' END FROM benchmark WHERE item_id % 4 != 3"""
register("search_in_dirs", _bm25_sql(5, dirs=_QUERY_DIRS_SQL))(search_in_dirs)


# ------------------------------------------------------------------ PRM-4 / AGG-9
def result_text_blocks(ranked: DataFrame) -> DataFrame:
    """Ordered "Result Index" blocks per query; a query without results gets '' (PRM-4)."""
    from quarry.operators.pages import ordered_text
    b = ranked.withColumn("block", F.concat(
        F.lit("---\nResult Index: "), (F.col("rank") - 1).cast("string"), F.lit("\nFilename: "), F.col("filename"),
        F.lit("\nSearch Result:\n"), F.col("content"), F.lit("\n---")))
    return ordered_text(b, "query_id", "rank", "block")


def context_prompt(spark, sf_dir):
    c = _content(spark, sf_dir)
    idx = build_text_index(c, colocated_by="doc_id").materialize()
    q = _bench_queries(spark, sf_dir)
    hits = bm25_search(idx, c, q, k=5, per_instance=False)
    t = result_text_blocks(hits)
    out = q.select("query_id").join(t, "query_id", "left")
    text = F.coalesce(F.col("block"), F.lit(""))
    return out.select("query_id", F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"),
                      F.length(text).cast("long").alias("text_len"), F.md5(text).alias("text_md5"))


register("context_prompt", f"""
WITH r AS ({_bm25_sql(5)}),
b AS (SELECT r.query_id, r.rank, '---' || chr(10) || 'Result Index: ' || CAST(r.rank - 1 AS VARCHAR) || chr(10) || 'Filename: ' || r.filename
             || chr(10) || 'Search Result:' || chr(10) || substring(d.text, r.split_idx + 1, {CAP}) || chr(10) || '---' AS block
      FROM r JOIN documents d USING (doc_id)),
t AS (SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS block, count(*) AS n FROM b GROUP BY query_id)
SELECT q.item_id AS query_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_parts, CAST(length(coalesce(t.block, '')) AS BIGINT) AS text_len,
       md5(coalesce(t.block, '')) AS text_md5
FROM benchmark q LEFT JOIN t ON t.query_id = q.item_id
""")(context_prompt)


# ------------------------------------------------------------------ SCH-19, JN-3, AGG-11
NARROW_DIRS = ["src1", "src2/en"]   # first choice: relevant directories
KEEP_FILES = 2                      # second choice: files kept per query


def narrow_results(ranked: DataFrame, file_choice: DataFrame) -> DataFrame:
    """Staged narrowing (SCH-19): distinct files in first-seen rank order, keep the
    chosen ones (``file_choice(query_id, file_rank)``), results restricted to them (JN-3)."""
    first = ranked.groupBy("query_id", "filename").agg(F.min("rank").alias("_first"))
    w = Window.partitionBy("query_id").orderBy("_first")
    files = first.withColumn("file_rank", F.row_number().over(w).cast("long"))
    chosen = files.join(file_choice, ["query_id", "file_rank"], "left_semi")
    return ranked.join(chosen.select("query_id", "filename", "file_rank"), ["query_id", "filename"])


def narrowing(spark, sf_dir):
    c = _content(spark, sf_dir)
    idx = build_text_index(c, colocated_by="doc_id").materialize()
    q = _bench_queries(spark, sf_dir)
    ranked = bm25_search(idx, c, q, k=5, per_instance=False, in_dirs=NARROW_DIRS)
    choice = q.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(KEEP_FILES).cast("long"))).alias("file_rank"))
    r = narrow_results(ranked, choice)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "file_rank", "filename", "split_idx")


register("narrowing", f"""
WITH r AS ({_bm25_sql(5, where="filename ILIKE 'src1%' OR filename ILIKE 'src2/en%'")}),
f AS (SELECT query_id, filename, min(rank) AS fr FROM r GROUP BY query_id, filename),
fr AS (SELECT query_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY fr) AS file_rank FROM f)
SELECT r.query_id, r.rank, CAST(fr.file_rank AS BIGINT) AS file_rank, r.filename, r.split_idx
FROM r JOIN fr USING (query_id, filename) WHERE fr.file_rank <= {KEEP_FILES}
""")(narrowing)
