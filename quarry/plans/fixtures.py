"""Rendered inputs built from the driver tables, in Spark and in SQL.

The driver tables hold no source trees, diffs or model replies, so several
operators need inputs *rendered* from them (FIXTURES.md §C).  Each renderer
exists twice: as a DataFrame transform (feeds the Spark operator) and as a
SQL fragment (feeds the DuckDB oracle, which states the expected rows
directly from the base table and never mirrors a parser).

Rendering rules are plain arithmetic on keys; they decide *shape*
(file name, element type, level), never which rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunking import DEFAULT_CAPACITY, OVERLAP_DIVISOR, fixed_chunks

CAP = DEFAULT_CAPACITY
STEP = CAP - CAP // OVERLAP_DIVISOR


# ---------------------------------------------------------------- content rows (documents)
def doc_filename(d: DataFrame | None = None) -> Column:
    ext = (F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt"))
    tests = F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("")
    return F.concat(F.col("source"), F.lit("/"), tests, F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)


def doc_elem_type() -> Column:
    m = F.col("doc_id") % 5
    return (F.when(m == 0, "module").when(m == 1, "function").when(m == 2, "class")
            .when(m == 3, "readme").otherwise("other"))


def content_rows(documents: DataFrame, capacity: int = CAP) -> DataFrame:
    """Content table (A3 schema + doc_id) rendered from ``documents``.

    instance = source; one file per document; element type and display
    level(s) by key arithmetic; documents with ``doc_id % 4 = 0`` are stored
    at two levels so the de-dup key (which ignores the level) collapses them.
    """
    m4 = F.col("doc_id") % 4
    levels = (F.when(m4 == 0, F.array(F.lit("minimal"), F.lit("moderate")))
              .when(m4 == 1, F.array(F.lit("moderate")))
              .when(m4 == 2, F.array(F.lit("full")))
              .otherwise(F.array(F.lit(""))))
    base = documents.select(
        "doc_id",
        F.col("source").alias("instance_id"),
        doc_filename().alias("filename"),
        doc_elem_type().alias("elem_type"),
        levels.alias("_levels"),
        F.col("text").alias("content"),
    )
    named = base.withColumn(
        "elem_name",
        F.when(F.col("elem_type").isin("function", "class"),
               F.concat(F.when(F.col("doc_id") % 11 == 0, "example_").otherwise("elem_"), F.col("doc_id").cast("string")))
        .otherwise(F.col("filename")),
    ).withColumn("parent_name", F.lit(""))
    lv = named.select("*", F.posexplode("_levels").alias("level_no", "display_level")).drop("_levels")
    ch = fixed_chunks(lv, "content", capacity)
    return ch.withColumn(
        "id", ((F.col("doc_id") * 2 + F.col("level_no")) * 100000 + F.col("split_idx")).cast("long")
    ).select("id", "doc_id", "instance_id", "filename", "elem_name", "parent_name", "elem_type",
             "display_level", "split_idx", "content")


def chunk_offsets_sql(len_expr: str, cap: int = CAP) -> str:
    step = cap - cap // OVERLAP_DIVISOR
    return (f"range(0, (CASE WHEN {len_expr} > {cap} THEN CAST(ceil(({len_expr} - {cap}) / {float(step)}) AS BIGINT) "
            f"ELSE 0 END) * {step} + 1, {step})")


CONTENT_ROWS_SQL = f"""
content_docs AS (
  SELECT doc_id, source AS instance_id, text,
         source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
           || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS filename,
         CASE doc_id % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'function' WHEN 2 THEN 'class' WHEN 3 THEN 'readme' ELSE 'other' END AS elem_type,
         CASE doc_id % 4 WHEN 0 THEN ['minimal', 'moderate'] WHEN 1 THEN ['moderate'] WHEN 2 THEN ['full'] ELSE [''] END AS levels
  FROM documents WHERE length(text) > 0
),
content_named AS (
  SELECT *, CASE WHEN elem_type IN ('function', 'class')
                 THEN (CASE WHEN doc_id % 11 = 0 THEN 'example_' ELSE 'elem_' END) || CAST(doc_id AS VARCHAR)
                 ELSE filename END AS elem_name,
         '' AS parent_name
  FROM content_docs
),
content_levels AS (
  SELECT * EXCLUDE (levels), levels[level_no + 1] AS display_level
  FROM (SELECT *, unnest(range(len(levels))) AS level_no FROM content_named)
),
content_rows AS (
  SELECT CAST(((doc_id * 2 + level_no) * 100000 + split_idx) AS BIGINT) AS id, doc_id, instance_id, filename, elem_name,
         parent_name, elem_type, display_level, CAST(split_idx AS BIGINT) AS split_idx,
         substring(text, split_idx + 1, {CAP}) AS content
  FROM (SELECT *, unnest({chunk_offsets_sql('length(text)')}) AS split_idx FROM content_levels)
)"""


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({expr})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
