"""Web result operators (SCH-17, SCH-20, SCH-21, FLT-4, FLT-5, TXT-9, TXT-10, AGG-9).

A *result* row is ``(query_id, result_idx, url, title, description, html)``;
an *item* row gives each query its ``repo``.  The network fetch of the
reference is not built: pages arrive as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import excluded_url, html_to_text, self_referential

# Fixed value: number of results above which the chosen subset is kept.
KEEP_ALL_UP_TO = 2


def page_title(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)


def filter_results(results: DataFrame, items: DataFrame) -> DataFrame:
    """Drop self-referential results and excluded hosts; renumber (FLT-4, FLT-5, SCH-21)."""
    r = results.join(items.select("query_id", "repo"), "query_id")
    probe = F.concat_ws(" ", F.col("title"), F.col("description"), F.col("url"))
    kept = r.where(~self_referential(F.col("repo"), probe) & ~excluded_url(F.col("url")))
    w = Window.partitionBy("query_id").orderBy("result_idx")
    return kept.withColumn("result_idx", (F.row_number().over(w) - 1).cast("long"))


def apply_choice(results: DataFrame, choices: DataFrame) -> DataFrame:
    """Keep the chosen indices when a query has more than 2 results (SCH-17, JN-7).

    ``choices``: (query_id, indices array<int>) — an int payload is wrapped
    into a one-element array beforehand (RSP-6).  ``pick_ord`` keeps the
    order of the chosen list; with 2 results or fewer every result is kept.
    """
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    picks = choices.select("query_id", F.posexplode("indices").alias("pick_ord", "result_idx"))
    picks = picks.withColumn("result_idx", F.col("result_idx").cast("long"))
    r = results.join(n, "query_id")
    small = r.where(F.col("_n") <= KEEP_ALL_UP_TO).withColumn("pick_ord", F.col("result_idx").cast("int"))
    big = r.where(F.col("_n") > KEEP_ALL_UP_TO).join(picks, ["query_id", "result_idx"])
    return small.unionByName(big).drop("_n")


def result_block(url, title, description, content) -> Column:
    return F.concat(F.lit("---\nURL: "), url, F.lit("\nTitle: "), title, F.lit("\nDescription:\n"), description,
                    F.lit("\nExtracted Page Content:\n\n"), content, F.lit("\n---"))


def ordered_text(df: DataFrame, group: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """``sep``-joined text of each group in ``order`` (AGG-9); groups must be bounded."""
    agg = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return agg.select(group, F.array_join(F.transform("_l", lambda x: x["t"]), sep).alias(text),
                      F.size("_l").cast("long").alias("n_parts"))


def aggregate_pages(chosen: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """One text per query from its chosen pages; self-referential texts dropped (SCH-20)."""
    kwargs = {} if limit is None else {"limit": limit}
    blocks = chosen.withColumn("block", result_block(F.col("url"), F.col("title"), F.col("description"),
                                                     html_to_text(F.col("html"), **kwargs)))
    text = ordered_text(blocks, "query_id", "pick_ord", "block")
    j = text.join(items.select("query_id", "repo"), "query_id")
    return j.where(~self_referential(F.col("repo"), F.col("block"))).drop("repo")
