"""Distributions and counters (AGG-2..AGG-7, FLT-7, FLT-8).

All are aggregates over a per-instance stats frame; a domain table (the
values to report) is a small literal frame and is joined after the counts
are reduced, so no step ever holds more than one row per (metric, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reported domains (0..max) of the patch metrics, truncation
# before binning, and bin widths.
DOMAINS = {"num_files": 10, "num_imports": 5, "num_edits": 10, "num_lines": 100}
TRUNCATE = {"num_files": 10, "num_edits": 50, "num_lines": 100, "num_imports": 10}
BIN_WIDTH = {"num_files": 1, "num_edits": 5, "num_lines": 10, "num_imports": 1}
# Simple instance: exactly one file and at most two edits.
SIMPLE_FILES = 1
SIMPLE_MAX_EDITS = 2
# Outcome phrases, checked in this order (first match wins).
OUTCOME_PHRASES = [
    ("success", ["All tests passed"]),
    ("test_script_failure", ["Test script run failed"]),
    ("test_failure", ["Some tests failed"]),
    ("install_failure", ["Installation failed"]),
    ("patch_failure", ["Apply patch failed"]),
]
UNKNOWN_OUTCOME = "unknown"


def _long_form(stats: DataFrame, metrics) -> DataFrame:
    expr = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(metrics), pairs=", ".join(f"'{m}', cast({m} as bigint)" for m in metrics))
    return stats.selectExpr(expr)


def value_distribution(stats: DataFrame, domains: dict = DOMAINS, overflow: bool = False) -> DataFrame:
    """% of instances per value 0..max, zero-filled, with a running total (AGG-2, AGG-3).

    With ``overflow``, larger values are counted in a row of value max + 1;
    without (the reference's cut) they are in no row.
    """
    spark = stats.sparkSession
    metrics = list(domains)
    values = _long_form(stats, metrics)
    if overflow:
        top = F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(domains[m] + 1).cast("long"))])
        values = values.withColumn("value", F.when(F.col("value").isNotNull(), F.least("value", top[F.col("metric")])))
    counts = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    # every instance has exactly one value per metric, so the per-metric sum is
    # the total; computed as a window over the (small) counts so the stats
    # input is consumed once
    by_metric = Window.partitionBy("metric")
    counts = counts.withColumn("total", F.sum("n").over(by_metric))
    dom = spark.createDataFrame([(m, v) for m, hi in domains.items() for v in range(hi + 1 + overflow)], "metric string, value bigint")
    j = dom.join(counts, ["metric", "value"], "left")
    j = j.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")) \
         .withColumn("total", F.coalesce(F.max("total").over(by_metric), F.lit(0)))
    pct = F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    w = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("pct", pct)
    return j.select("metric", "value", "n", F.round("pct", 6).alias("pct"),
                    F.round(F.sum("pct").over(w), 6).alias("cumulative_pct"))


def histogram_bins(stats: DataFrame, truncate: dict = TRUNCATE, widths: dict = BIN_WIDTH, overflow: bool = False) -> DataFrame:
    """Counts per bin (FLT-8, AGG-4), in one pass over the stats.

    With ``overflow``, values above the truncation are one bin that starts after
    it and has no end; without (the reference's cut) they are in no bin.
    """
    metrics = list(truncate)
    lim = F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(truncate[m]))])
    wid = F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(widths[m]))])
    lf = _long_form(stats, metrics)
    w = wid[F.col("metric")]
    above = F.col("value") > lim[F.col("metric")]
    kept = lf.where(F.col("value").isNotNull() if overflow else ~above)
    bin_lo = F.when(above, (lim[F.col("metric")] + 1).cast("long")).otherwise(F.floor(F.col("value") / w).cast("long") * w)
    binned = kept.select("metric", bin_lo.alias("bin_lo"), F.when(~above, w).alias("_w"))
    return binned.groupBy("metric", "bin_lo", "_w").agg(F.count(F.lit(1)).cast("long").alias("n")) \
        .select("metric", "bin_lo", "n", (F.col("bin_lo") + F.col("_w")).cast("long").alias("bin_hi"))


def simple_share(stats: DataFrame) -> DataFrame:
    """Instances with one file and at most two edits, and their share (FLT-7)."""
    simple = (F.col("num_files") == SIMPLE_FILES) & (F.col("num_edits") <= SIMPLE_MAX_EDITS)
    return stats.agg(F.count_if(simple).cast("long").alias("n_simple"), F.count(F.lit(1)).cast("long").alias("n_total")) \
        .withColumn("share_pct", F.round(F.when(F.col("n_total") > 0, 100.0 * F.col("n_simple") / F.col("n_total")), 6))


def classify_outcome(text: Column) -> Column:
    """First category whose phrase occurs in the lower-cased log (AGG-6)."""
    low = F.lower(text)
    expr = None
    for cat, phrases in OUTCOME_PHRASES:
        cond = F.lit(False)
        for ph in phrases:
            cond = cond | low.contains(ph.lower())
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(UNKNOWN_OUTCOME))


def outcome_counts(logs: DataFrame, text_col: str = "content") -> DataFrame:
    """Counts per outcome, zero-filled over all categories (AGG-5)."""
    spark = logs.sparkSession
    cats = [c for c, _ in OUTCOME_PHRASES] + [UNKNOWN_OUTCOME]
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(cats)], "outcome string, ord int")
    counts = logs.select(classify_outcome(F.col(text_col)).alias("outcome")).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "outcome", "left").select(
        "outcome", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def repo_chunks(items: DataFrame, n_workers: int = 8, repo_col: str = "repo") -> DataFrame:
    """Chunk id per repo: ``max(1, n_repos // n_workers)`` repos per chunk (AGG-7).

    The numbering runs over the *distinct* repos, range partitioned by name: each
    partition numbers its own repos and adds the number of repos before it.
    """
    from quarry.session import write_table
    parts = max(1, items.sparkSession.sparkContext.defaultParallelism)
    repos = items.select(repo_col).distinct().repartitionByRange(parts, repo_col).withColumn("_part", F.spark_partition_id())
    repos = write_table(repos, "repos")
    counts = repos.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as partitions
    before = {r["_part"]: r["_n"] for r in counts.collect()}
    size = max(1, sum(before.values()) // n_workers)
    offsets, total = {}, 0
    for part in sorted(before):
        offsets[part], total = total, total + before[part]
    pairs = [F.lit(x) for kv in offsets.items() for x in kv]
    offset = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    w = Window.partitionBy("_part").orderBy(repo_col)
    numbered = repos.select(repo_col, F.floor((offset + F.row_number().over(w) - 1) / size).cast("long").alias("chunk"))
    return items.join(numbered, repo_col)
