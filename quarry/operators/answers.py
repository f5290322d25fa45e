"""Staged answers to a batch of code queries (SCH-12..SCH-16, SCH-19, JN-3).

Each query goes through up to four stages, all queries in one plan:

1. *exact*: functions, methods, classes and file ranges by name, in the files that a
   choice keeps for the query;
2. *text*: exact queries left without a result are searched by their alternative text
   (BM25 within the instance), semantic ones by vector (L1, one row a file);
3. *extracted*: in the found files that a choice keeps, the elements that were named
   there are looked up inside the file;
4. *picked*: of several results the one whose index was chosen.

The first stage that has a result wins.  Choices (which files, which elements, which
index) are tables: replies of a model, or of whatever stands for it, parsed into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lookup import alternative_text, checked_kinds, exact_lookups
from quarry.operators.search import PRESET_TEXT, PRESET_VECTOR, bm25_search, l1_search
from quarry.session import shuffled, write_table


def found_files(queries: DataFrame, index, content: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """``(query_id, instance_id, source, filename, rank)``: the files of each query's search results, by their best rank."""
    by_text = queries.where("query_kind != 'semantic'")
    texts = bm25_search(index, content, alternative_text(by_text).select("query_id", "instance_id", "text"), per_instance=True, **PRESET_TEXT)
    semantic = shuffled(queries.where("query_kind = 'semantic'").select("query_id")).join(query_vectors, "query_id")
    near = l1_search(vectors, semantic, dedup_first=True, **PRESET_VECTOR)
    hits = texts.select("query_id", F.lit("text").alias("source"), "filename", "rank").unionByName(
        near.select("query_id", F.lit("semantic").alias("source"), "filename", "rank"))
    files = hits.groupBy("query_id", "source", "filename").agg(F.min("rank").alias("rank"))
    return shuffled(files).join(queries.select("query_id", "instance_id"), "query_id")


def staged_answers(queries: DataFrame, displays: DataFrame, files: DataFrame, index, content: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                   exact_choice: DataFrame, text_choice: DataFrame, extractions: DataFrame, result_choice: DataFrame) -> DataFrame:
    """One row per answered query: ``(query_id, source, n_results, result_idx, filename, elem_type, elem_name, text)``.

    ``exact_choice`` and ``text_choice(query_id, filename)`` are the files kept of exact and
    of search results, ``extractions(query_id, filename, item, query_kind, fn_name,
    class_name, method_name, line_start, line_end)`` the elements named in a found file,
    ``result_choice(query_id, index)`` the chosen result, which a single result does not
    need.  A query without results, or whose chosen index is none of them, has no row; a
    query of unknown kind is an error.
    """
    q = checked_kinds(queries)
    exact = exact_lookups(q.where("query_kind != 'semantic'"), displays, files)
    kept = write_table(exact.join(shuffled(exact_choice.select("query_id", "filename").distinct()), ["query_id", "filename"], "left_semi"), "staged_exact")
    missed = q.join(shuffled(kept.select("query_id").distinct()), "query_id", "left_anti")
    chosen = found_files(missed, index, content, vectors, query_vectors).join(shuffled(text_choice.select("query_id", "filename").distinct()), ["query_id", "filename"], "left_semi")
    named = checked_kinds(shuffled(chosen).join(extractions, ["query_id", "filename"]).withColumnRenamed("source", "_found_by"))
    extracted = exact_lookups(named, displays, files, in_file=True, id_cols=("query_id", "_found_by", "rank", "item"))
    cols = ["query_id", "source", "filename", "elem_type", "elem_name", "text"]
    rows = kept.select(F.lit(0).alias("stage"), F.lit(0).alias("rank"), F.lit(0).alias("item"), *cols).unionByName(
        extracted.drop("source").withColumnRenamed("_found_by", "source").select(F.lit(1).alias("stage"), F.col("rank").cast("int").alias("rank"), F.col("item").cast("int").alias("item"), *cols))
    by_query = Window.partitionBy("query_id")
    rows = rows.withColumn("_first", F.min("stage").over(by_query)).where("stage = _first")
    rows = rows.withColumn("n_results", F.count(F.lit(1)).over(by_query)).withColumn(
        "result_idx", (F.row_number().over(by_query.orderBy("rank", "item", "filename", "elem_name")) - 1).cast("long"))
    pick = result_choice.groupBy("query_id").agg(F.first("index").alias("_pick"))  # one reply a query
    picked = rows.join(shuffled(pick), "query_id", "left").where((F.col("n_results") == 1) | (F.col("result_idx") == F.col("_pick")))
    return picked.select("query_id", "source", F.col("n_results").cast("long").alias("n_results"), "result_idx", "filename", "elem_type", "elem_name", "text")
