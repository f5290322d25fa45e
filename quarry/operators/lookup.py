"""Exact lookups, routing and text fallback (SCH-8..SCH-14, SCH-16, JN-3, JN-8).

``queries(query_id, instance_id, query_kind, fn_name, class_name,
method_name, filename, line_start, line_end)`` are answered in one plan:
one equi join per kind against the element displays of the instance
(numbered, MODERATE), ``unionByName``; queries with no exact hit (left anti)
fall back to BM25 over the index rows with the alternative text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.elements import latest_by_name
from quarry.operators.render import CLASS_LIMIT_ALL_FILES, CLASS_LIMIT_IN_FILE, FILE_RANGE_LIMIT, lookup_range, range_text
from quarry.session import shuffled

QUERY_KINDS = ("semantic", "function", "method", "class", "file")
RESULT_COLS = ["query_id", "source", "filename", "elem_type", "elem_name", "text"]


def looked_up() -> Column:
    """The displays that :func:`exact_lookups` reads."""
    etype, level = F.col("elem_type"), F.col("display_level")
    return (etype.isin("function", "method") & (level == "moderate")) | ((etype == "class") & level.isin("moderate", "signature")) | (
        (etype == "module") & (level == "signature"))


def _level(d: DataFrame, etype: str, level: str, by: list[str]) -> DataFrame:
    """The last definitions of a type at a level, moved once, by the columns ``by`` that queries meet them on."""
    return latest_by_name(d.where((F.col("elem_type") == etype) & (F.col("display_level") == level)).repartition(*by))


def checked_kinds(queries: DataFrame) -> DataFrame:
    """The queries; one of an unknown or NULL kind is an error, not an empty answer."""
    known = F.coalesce(F.col("query_kind").isin(*QUERY_KINDS), F.lit(False))
    return queries.withColumn("query_kind", F.when(known, F.col("query_kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of query "), F.coalesce(F.col("query_id").cast("string"), F.lit("NULL"))))))


def exact_lookups(queries: DataFrame, displays: DataFrame, files: DataFrame, class_limit: int | None = None,
                  in_file: bool = False, id_cols: tuple = ("query_id",)) -> DataFrame:
    """Hits of function / method / class / file-range queries (SCH-8..SCH-11).

    ``in_file``: every query is answered inside its own ``filename`` (SCH-12), where a
    class may be ``CLASS_LIMIT_IN_FILE`` long, else ``CLASS_LIMIT_ALL_FILES``, before its
    signature stands for it.  ``id_cols`` name the columns that identify a query.
    """
    class_limit = class_limit or (CLASS_LIMIT_IN_FILE if in_file else CLASS_LIMIT_ALL_FILES)
    ids, on = list(id_cols), ["instance_id", *(["filename"] if in_file else [])]
    q = queries if in_file else queries.drop("filename")

    def out(hits, kind, name, text):
        return hits.select(*ids, F.lit("exact").alias("source"), "filename", F.lit(kind).alias("elem_type"), F.col(name).alias("elem_name"), text.alias("text"))

    fn = _level(displays.where(F.col("parent_name") == ""), "function", "moderate", [*on, "elem_name"])
    hf = shuffled(q.where(F.col("query_kind") == "function")).join(
        fn.select("instance_id", "filename", F.col("elem_name").alias("fn_name"), "display"), [*on, "fn_name"])
    me = _level(displays, "method", "moderate", [*on, "parent_name", "elem_name"])
    hm = shuffled(q.where(F.col("query_kind") == "method")).join(
        me.select("instance_id", "filename", F.col("parent_name").alias("class_name"), F.col("elem_name").alias("method_name"), "display"),
        [*on, "class_name", "method_name"])
    cls = displays.where((F.col("elem_type") == "class") & F.col("live") & F.col("display_level").isin("moderate", "signature")).repartition(*on, "elem_name")
    at = lambda level: F.max_by(F.when(F.col("display_level") == level, F.col("display")),
                                F.when(F.col("display_level") == level, F.col("ord")))
    cl = cls.groupBy("instance_id", "filename", "elem_name").agg(at("moderate").alias("_m"), at("signature").alias("_s"))
    hc = shuffled(q.where(F.col("query_kind") == "class")).join(cl.withColumnRenamed("elem_name", "class_name"), [*on, "class_name"])
    # file ranges: lines of module files only; over the limit -> module signature
    mods = displays.where((F.col("elem_type") == "module") & (F.col("kind") == "module") & (F.col("display_level") == "signature"))
    fl = shuffled(files).join(mods.select("instance_id", "filename", F.col("display").alias("_sig")), ["instance_id", "filename"])
    fl = fl.select("instance_id", "filename", F.split("content", "\n").alias("_lines"), "_sig")
    hq = shuffled(queries.where(F.col("query_kind") == "file")).join(fl, ["instance_id", "filename"])
    lo, hi = lookup_range(F.col("_lines"), F.col("line_start"), F.col("line_end"))
    t = range_text(F.col("_lines"), lo, hi)
    return (out(hf, "function", "fn_name", F.col("display")).unionByName(out(hm, "method", "method_name", F.col("display")))
            .unionByName(out(hc, "class", "class_name", F.when(F.length("_m") > class_limit, F.col("_s")).otherwise(F.col("_m"))))
            .unionByName(out(hq, "file", "filename", F.when(F.length(t) > FILE_RANGE_LIMIT, F.col("_sig")).otherwise(t))))


def alternative_text(queries: DataFrame) -> DataFrame:
    """Text searched when an exact lookup finds nothing (SCH-14)."""
    k = F.col("query_kind")
    alt = (F.when(k == "function", F.col("fn_name"))
           .when(k == "method", F.concat_ws(" ", "class_name", "method_name"))
           .when(k == "class", F.col("class_name"))
           .when(k == "file", F.col("filename"))
           .when(k == "semantic", F.col("semantic")))
    return queries.withColumn("text", alt)


def lookup_with_fallback(queries: DataFrame, displays: DataFrame, files: DataFrame, index, content: DataFrame,
                         k: int = 10) -> DataFrame:
    """Exact hits, plus search results (k=10, code only) for queries without one (SCH-12..SCH-14).

    Semantic queries have no exact form and are answered by their text.
    """
    from quarry.operators.search import bm25_search
    queries = checked_kinds(queries)
    hits = exact_lookups(queries, displays, files)
    missed = shuffled(queries).join(shuffled(hits.select("query_id").distinct()), "query_id", "left_anti")
    alt = alternative_text(missed).select("query_id", "instance_id", "text")
    found = bm25_search(index, content, alt, k=k, elem_type="code", per_instance=True)
    fb = found.select("query_id", F.lit("text").alias("source"), "filename", "elem_type", "elem_name",
                      F.col("content").alias("text"))
    return hits.unionByName(fb)


def located_context(items: DataFrame, displays: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Display of a located item at the level its kind and category call for (ELM-10).

    ``items(item_id, instance_id, kind, category, class_name, fn_name)``:
    functions and methods are shown FULL when the category is ``fix``, else
    MODERATE; classes MODERATE for ``fix``, else SIGNATURE.  Last definition
    of a repeated name wins.  Items that name their file (a ``filename`` column)
    are looked up in it, and an absent element keeps its row with a NULL display.

    Items of kind ``lines`` (with ``files(instance_id, filename, content)`` and item columns
    ``line_lo``, ``line_hi``) show the numbered lines from the one before ``line_lo``
    through ``line_hi + 1``, counted from 0; without their file the display is NULL.
    """
    fix = F.col("category") == "fix"
    k = F.col("kind")
    level = (F.when(k.isin("function", "method"), F.when(fix, "full").otherwise("moderate"))
             .when(k == "class", F.when(fix, "moderate").otherwise("signature")))
    it = items.withColumn("display_level", level).withColumn(
        "elem_name", F.when(k == "class", F.col("class_name")).otherwise(F.col("fn_name"))).withColumn(
        "parent_name", F.when(k == "method", F.col("class_name")).otherwise(F.lit(""))).withColumn("elem_type", k)
    d = latest_by_name(displays)
    keys = ["instance_id", "elem_type", "parent_name", "elem_name", "display_level"]
    if "filename" not in items.columns:
        return shuffled(it).join(d, keys)
    if files is None:
        return shuffled(it).join(shuffled(d), [*keys, "filename"], "left")
    named = shuffled(it.where(k != "lines")).join(shuffled(d.drop("ord")), [*keys, "filename"], "left")
    split = files.select("instance_id", "filename", F.split("content", "\n").alias("_lines"))
    lo = F.when(F.col("line_lo") > 0, F.col("line_lo") - 1).otherwise(F.col("line_lo"))
    hi = F.least(F.col("line_hi") + 1, F.size("_lines"))
    lines = shuffled(it.where(k == "lines")).join(shuffled(split), ["instance_id", "filename"], "left").withColumn(
        "display", F.when(F.col("_lines").isNotNull(), range_text(F.col("_lines"), lo, hi)))
    return named.unionByName(lines.select(*named.columns))
