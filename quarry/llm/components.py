"""Connected components of an edge table, by alternating large and small stars.

Each round is a partial ``min`` per node and a join; the rounds' tables are
written to the shared checkpoint folder, so a lost executor re-reads files and
no round's lineage grows.  Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import write_table

MAX_ROUNDS = 64


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over rows (u, v): every node points at the least node of its neighbourhood."""
    e = edges
    if both:  # large star: neighbours on both sides, only larger ones are re-pointed
        e = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:     # small star: from the larger to the smaller end
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = e.join(least, "u")
    if both:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``: the least node reachable, for each node of an edge.

    Rows with a null end and self loops are ignored; an empty edge table gives no rows.
    """
    spark = edges.sparkSession
    e = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct()
    e = write_table(e, name)
    if not e.limit(1).count():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(MAX_ROUNDS):
        e = write_table(_star(_star(e, both=True), both=False), name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
