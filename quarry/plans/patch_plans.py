"""Queries: diff parsing and patch statistics, distributions, outcomes, chunks, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import adler32_bucket, xx_bucket
from quarry.operators.apply import LINE_END_BLANKS, accepted_patches, first_valid_variant, minimal_patches
from quarry.operators.patches import collapse_blank_before_hunks, parse_patches, patch_hunks, patch_stats, patch_stats_fold
from quarry.operators.stats import (BIN_WIDTH, DOMAINS, TRUNCATE, histogram_bins, outcome_counts,
                                    repo_chunks, simple_share, value_distribution)
from quarry.plans import register
from quarry.plans.fixtures import doc_filename
from quarry.sources.tables import Tables


# ------------------------------------------------------------------ rendered diffs
def _fmt_range(start, length):
    return F.when(length == 1, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit(","), length.cast("string")))


def render_diffs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One unified diff per order (instance), one hunk per line item.

    File by ``l_suppkey % 5``: 0-2 modified ``.py`` files, 3 a modified
    ``.md`` file, 4 an added file.  A hunk adds ``l_linenumber`` lines and
    removes ``l_quantity % 4`` lines (``--- gone``, which looks like a file
    header); its first added line is an import when ``l_returnflag = 'A'``,
    else ``+++ plus``; even line numbers get one context line on each side;
    a length of 1 is omitted from the header.
    """
    fkey = (F.col("l_suppkey") % 5).cast("int")
    is_new = fkey == 4
    a = F.col("l_linenumber").cast("long")
    r = F.when(is_new, F.lit(0)).otherwise((F.floor("l_quantity") % 4).cast("long"))
    ctx = F.when(~is_new & (F.col("l_linenumber") % 2 == 0), F.lit(1)).otherwise(F.lit(0))
    first = F.when(F.col("l_returnflag") == "A",
                   F.when(F.col("l_linestatus") == "O", F.lit("import os")).otherwise(F.lit("from os import path"))) \
             .otherwise(F.lit("++ plus"))
    more = F.when(a >= 2, F.transform(F.sequence(F.lit(2), a.cast("int")), lambda i: F.concat(F.lit("+x = "), i.cast("string")))) \
            .otherwise(F.array().cast("array<string>"))
    ctx_arr = F.array_repeat(F.lit(" keep"), ctx)
    body = F.concat(ctx_arr, F.array_repeat(F.lit("--- gone"), r.cast("int")), F.array(F.concat(F.lit("+"), first)), more, ctx_arr)
    old_start = F.when(is_new, F.lit(0)).otherwise(a * 100)
    header = F.concat(F.lit("@@ -"), _fmt_range(old_start, r + 2 * ctx), F.lit(" +"), _fmt_range(a * 100, a + 2 * ctx), F.lit(" @@"))
    path = (F.when(fkey < 3, F.concat(F.lit("pkg/mod_"), fkey.cast("string"), F.lit(".py")))
            .when(fkey == 3, F.lit("docs/notes.md")).otherwise(F.lit("pkg/new_mod.py")))
    src = F.when(fkey == 4, F.lit("--- /dev/null")).otherwise(F.concat(F.lit("--- a/"), path))
    fhead = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), src, F.lit("\n+++ b/"), path)
    hunks = lineitem.select("l_orderkey", fkey.alias("fkey"), "l_linenumber", fhead.alias("fhead"),
                            F.array_join(F.concat(F.array(header), body), "\n").alias("hunk"))
    # one ordered list per order (bounded by its line items); a file header opens each new file
    per = hunks.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("fkey", "l_linenumber", "fhead", "hunk"))).alias("_h"))
    text = F.array_join(F.transform("_h", lambda x, i: F.when(
        (i == 0) | (x["fkey"] != F.get(F.col("_h"), i - 1)["fkey"]), F.concat(x["fhead"], F.lit("\n"), x["hunk"]))
        .otherwise(x["hunk"])), "\n")
    patches = per.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(text, F.lit("\n")).alias("patch"))
    inst = orders.select("o_orderkey", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("instance_id"),
                         F.concat(F.lit("cust/c"), F.col("o_custkey").cast("string")).alias("repo"))
    return inst.join(patches, "o_orderkey", "left").select(
        "o_orderkey", "instance_id", "repo", F.coalesce("patch", F.lit("")).alias("patch"))


#: Line items a task renders: about a million diff lines, which it sorts in memory.
ITEMS_PER_TASK = 100_000


def _instances(spark, sf_dir) -> DataFrame:
    """Orders and line items move by order key as they are stored; their diffs are rendered and parsed where they lie."""
    t = Tables(spark, sf_dir)
    parts = t.parts_of("lineitem", ITEMS_PER_TASK)
    return render_diffs(t.colocated("orders", parts), t.colocated("lineitem", parts))


def instance_stats(spark, sf_dir) -> DataFrame:
    """Per-instance counts through the line-level window parser."""
    parsed = parse_patches(_instances(spark, sf_dir), "instance_id", "patch", colocated_by="o_orderkey")
    return patch_stats(parsed, "instance_id", colocated_by="o_orderkey")


def instance_stats_fold(spark, sf_dir) -> DataFrame:
    """The same counts as one fold per patch row: no shuffle, and faster than the windows where no lines are asked for."""
    return patch_stats_fold(_instances(spark, sf_dir), "instance_id", "patch")


_STATS_SQL = """
li AS (SELECT l_orderkey, l_suppkey % 5 AS fkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) % 4 AS r, l_returnflag FROM lineitem),
agg AS (SELECT l_orderkey, count(DISTINCT fkey) AS nf, count(*) AS ne, sum(l_linenumber + r) AS nl,
               count_if(l_returnflag = 'A') AS ni FROM li WHERE fkey < 3 GROUP BY l_orderkey),
st AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS instance_id, CAST(coalesce(nf, 0) AS BIGINT) AS num_files,
              CAST(coalesce(ne, 0) AS BIGINT) AS num_edits, CAST(coalesce(nl, 0) AS BIGINT) AS num_lines,
              CAST(coalesce(ni, 0) AS BIGINT) AS num_imports
       FROM orders LEFT JOIN agg ON o_orderkey = l_orderkey)"""

register("diff_parse_stats", f"""
WITH {_STATS_SQL}
SELECT * FROM st
""")(instance_stats)
register("diff_parse_stats_fold", f"""
WITH {_STATS_SQL}
SELECT * FROM st
""")(instance_stats_fold)


def diff_hunks(spark, sf_dir):
    parsed = parse_patches(_instances(spark, sf_dir), "instance_id", "patch", colocated_by="o_orderkey")
    h = patch_hunks(parsed, "instance_id", colocated_by="o_orderkey")
    return h.select("instance_id", "path", "src_start", "src_len", "tgt_start", "tgt_len",
                    F.col("modified").cast("long").alias("modified"))


register("diff_hunks", """
SELECT 'order-' || CAST(l_orderkey AS VARCHAR) AS instance_id,
       CASE WHEN l_suppkey % 5 < 3 THEN 'pkg/mod_' || CAST(l_suppkey % 5 AS VARCHAR) || '.py'
            WHEN l_suppkey % 5 = 3 THEN 'docs/notes.md' ELSE '/dev/null' END AS path,
       CAST(CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE l_linenumber * 100 END AS BIGINT) AS src_start,
       CAST(CASE WHEN l_suppkey % 5 = 4 THEN 0
                 ELSE CAST(floor(l_quantity) AS BIGINT) % 4 + 2 * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) END AS BIGINT) AS src_len,
       CAST(l_linenumber * 100 AS BIGINT) AS tgt_start,
       CAST(l_linenumber + 2 * (CASE WHEN l_suppkey % 5 < 4 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tgt_len,
       CAST(CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE 1 END AS BIGINT) AS modified
FROM lineitem
""")(diff_hunks)


# ------------------------------------------------------------------ AGG-2 / AGG-3 / AGG-4 / FLT-7 / FLT-8
def value_distribution_q(spark, sf_dir):
    return value_distribution(instance_stats_fold(spark, sf_dir), overflow=True)


def _long_sql(metrics):
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM st" for m in metrics)


register("value_distribution", f"""
WITH {_STATS_SQL},
lg AS ({_long_sql(DOMAINS)}),
top AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {hi + 1})" for m, hi in DOMAINS.items())}) AS t(metric, over)),
counts AS (SELECT metric, least(value, over) AS value, count(*) AS n FROM lg JOIN top USING (metric) GROUP BY ALL),
totals AS (SELECT metric, sum(n) AS total FROM counts GROUP BY metric),
dom AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, range AS value FROM range(0, {hi + 2})" for m, hi in DOMAINS.items())}),
j AS (SELECT d.metric, d.value, coalesce(c.n, 0) AS n, t.total FROM dom d LEFT JOIN counts c USING (metric, value) LEFT JOIN totals t USING (metric))
SELECT metric, CAST(value AS BIGINT) AS value, CAST(n AS BIGINT) AS n, round(CAST(100.0 AS DOUBLE) * n / total, 6) AS pct,
       round(sum(CAST(100.0 AS DOUBLE) * n / total) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative_pct
FROM j
""")(value_distribution_q)


def histogram_bins_q(spark, sf_dir):
    return histogram_bins(instance_stats_fold(spark, sf_dir), overflow=True)


register("histogram_bins", f"""
WITH {_STATS_SQL}
{" UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(floor({m} / {BIN_WIDTH[m]}) * {BIN_WIDTH[m]} AS BIGINT) AS bin_lo, CAST(count(*) AS BIGINT) AS n, CAST(floor({m} / {BIN_WIDTH[m]}) * {BIN_WIDTH[m]} + {BIN_WIDTH[m]} AS BIGINT) AS bin_hi FROM st WHERE {m} <= {hi} GROUP BY 1, 2, 4" for m, hi in TRUNCATE.items())}
{"".join(f" UNION ALL SELECT '{m}', CAST({hi + 1} AS BIGINT), CAST(count(*) AS BIGINT), CAST(NULL AS BIGINT) FROM st WHERE {m} > {hi} HAVING count(*) > 0" for m, hi in TRUNCATE.items())}
""")(histogram_bins_q)


def simple_share_q(spark, sf_dir):
    return simple_share(instance_stats_fold(spark, sf_dir))


register("simple_share", f"""
WITH {_STATS_SQL}
SELECT CAST(count_if(num_files = 1 AND num_edits <= 2) AS BIGINT) AS n_simple, CAST(count(*) AS BIGINT) AS n_total,
       round(CAST(100.0 AS DOUBLE) * count_if(num_files = 1 AND num_edits <= 2) / count(*), 6) AS share_pct
FROM st
""")(simple_share_q)


# ------------------------------------------------------------------ AGG-5 / AGG-6
def render_logs(orders: DataFrame, keep: tuple = ()) -> DataFrame:
    """Evaluation logs rendered from orders; urgent orders carry two phrases."""
    st = F.col("o_orderstatus")
    pr = F.col("o_orderpriority")
    main = (F.when(pr == "5-LOW", F.lit("nothing to report"))
            .when(pr == "2-HIGH", F.lit("Test Script Run Failed"))
            .when(st == "F", F.lit("ALL TESTS PASSED"))
            .when(st == "O", F.lit("Some tests failed"))
            .otherwise(F.lit("Installation failed")))
    prefix = F.when(pr == "1-URGENT", F.lit("Apply patch failed\n")).otherwise(F.lit(""))
    return orders.select(*keep, F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".eval.log")).alias("path"),
                         F.concat(F.lit("log of order "), F.col("o_orderkey").cast("string"), F.lit("\n"), prefix, main).alias("content"))


def outcome_counts_q(spark, sf_dir):
    return outcome_counts(render_logs(Tables(spark, sf_dir).orders))


register("outcome_counts", """
WITH cats AS (SELECT * FROM (VALUES ('success', 0), ('test_script_failure', 1), ('test_failure', 2),
                                    ('install_failure', 3), ('patch_failure', 4), ('unknown', 5)) AS t(outcome, ord)),
exp AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown'
              WHEN o_orderpriority = '2-HIGH' THEN 'test_script_failure'
              WHEN o_orderstatus = 'F' THEN 'success'
              WHEN o_orderstatus = 'O' THEN 'test_failure'
              ELSE 'install_failure' END AS outcome
  FROM orders)
SELECT c.outcome, CAST(c.ord AS INTEGER) AS ord, CAST(count(e.outcome) AS BIGINT) AS n
FROM cats c LEFT JOIN exp e USING (outcome) GROUP BY c.outcome, c.ord
""")(outcome_counts_q)


# ------------------------------------------------------------------ AGG-7 / KV-4 / SRC-2
def repo_chunks_q(spark, sf_dir):
    items = _instances(spark, sf_dir).select("instance_id", "repo")
    return repo_chunks(items).select("instance_id", "repo", "chunk")


register("repo_chunks", """
WITH items AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS instance_id, 'cust/c' || CAST(o_custkey AS VARCHAR) AS repo FROM orders),
repos AS (SELECT DISTINCT repo FROM items),
sz AS (SELECT greatest(1, count(*) // 8) AS size FROM repos),
num AS (SELECT repo, dense_rank() OVER (ORDER BY repo) AS dr FROM repos)
SELECT i.instance_id, i.repo, CAST(floor((n.dr - 1) / sz.size) AS BIGINT) AS chunk FROM items i JOIN num n USING (repo), sz
""")(repo_chunks_q)


def hash_bucket(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", "c_name", adler32_bucket("c_name", 8).alias("bucket"))


register("hash_bucket", """
SELECT c_custkey, c_name, CAST(((1 + list_sum(list_transform(string_split(c_name, ''), lambda ch: ascii(ch)))) % 65521) % 8 AS BIGINT) AS bucket
FROM customer
""")(hash_bucket)


def hash_bucket_xx(spark, sf_dir):
    """Default xxhash64 buckets and the shard selection built on them (SRC-2); rows-only."""
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", xx_bucket("c_name", 8).alias("bucket")).where(F.col("bucket") == 3)


register("hash_bucket_xx")(hash_bucket_xx)


# ------------------------------------------------------------------ PCH-6..PCH-8, JN-9
def _rendered_lines() -> Column:
    """A document's lines as a file's: numbered, so that no two are alike, and without blanks at their ends."""
    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n"),
                       lambda x, k: F.regexp_replace(F.concat((k + 1).cast("string"), F.lit(": "), x), LINE_END_BLANKS, ""))


def render_file_patches(documents: DataFrame):
    """A one-hunk patch for every document that replaces its line ``m = 1 + doc_id % n`` by ``patched m``, and the file lines.

    Up to three lines of context; by ``doc_id % 9`` the patch: 1 states a place 7 lines
    too far down, 2 has blanks after the removed line, 3 a wrong line of context, 4 blanks
    after the added line, 5 a blank line before ``@@``, 6 takes all lines out and puts all
    back, 7 lacks its last line feed, 8 removes a line that the file does not hold.
    """
    d = documents.select("doc_id", F.col("source").alias("instance_id"), doc_filename().alias("path"), _rendered_lines().alias("lines"),
                         (F.col("doc_id") % 9).cast("int").alias("kind"))
    d = d.withColumn("n", F.size("lines")).withColumn("m", (F.col("doc_id") % F.col("n") + 1).cast("int"))
    m, n, kind = F.col("m"), F.col("n"), F.col("kind")
    d = d.withColumn("lo", F.greatest(F.lit(1), m - 3)).withColumn("hi", F.least(n, m + 3))
    window = F.slice("lines", F.col("lo"), F.col("hi") - F.col("lo") + 1)
    at = m - F.col("lo")  # of the replaced line in the window
    wrong_at = F.when(kind == 3, F.when(at > 0, 0).when(F.col("hi") > F.col("lo"), 1))
    taken = F.concat(F.lit("-"), F.when(kind == 8, F.lit("no such line")).otherwise(F.get("lines", m - 1)), F.when(kind == 2, F.lit(" \t")).otherwise(F.lit("")))
    put = F.concat(F.lit("+patched "), m.cast("string"), F.when(kind == 4, F.lit("  ")).otherwise(F.lit("")))
    plain = F.flatten(F.transform(window, lambda x, k: F.when(k == at, F.array(taken, put)).otherwise(
        F.array(F.concat(F.lit(" "), x, F.when(k == wrong_at, F.lit(" X")).otherwise(F.lit("")))))))
    whole = F.concat(F.transform(window, lambda x: F.concat(F.lit("-"), x)),
                     F.transform(window, lambda x, k: F.when(k == at, put).otherwise(F.concat(F.lit("+"), x))))
    length = F.col("hi") - F.col("lo") + 1
    start = F.col("lo") + F.when(kind == 1, 7).otherwise(0)
    head = F.concat(F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.when(kind == 5, F.lit("\n\n")).otherwise(F.lit("\n")),
                    F.lit("@@ -"), _fmt_range(start, length), F.lit(" +"), _fmt_range(start, length), F.lit(" @@\n"))
    patch = F.concat(head, F.array_join(F.when(kind == 6, whole).otherwise(plain), "\n"), F.when(kind == 7, F.lit("")).otherwise(F.lit("\n")))
    patches = d.select(F.col("doc_id").alias("patch_id"), "instance_id", patch.alias("patch"))
    lines = d.select("instance_id", "path", F.posexplode_outer("lines").alias("pos", "line")).select("instance_id", "path", (F.col("pos") + 1).alias("line_no"), "line")
    return patches, lines


_PATCHED_SQL = f"""
d0 AS (SELECT doc_id, doc_id % 9 AS kind, string_split(coalesce(text, ''), chr(10)) AS raw,
              source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
                || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS f
       FROM documents),
d1 AS (SELECT *, list_transform(raw, lambda x, k: regexp_replace(CAST(k AS VARCHAR) || ': ' || x, '{LINE_END_BLANKS}', '')) AS ls,
              len(raw) AS n, 1 + doc_id % len(raw) AS m FROM d0),
d2 AS (SELECT *, greatest(1, m - 3) AS lo, least(n, m + 3) AS hi FROM d1),
d AS (SELECT *, CAST(lo AS VARCHAR) || CASE WHEN hi = lo THEN '' ELSE ',' || CAST(hi - lo + 1 AS VARCHAR) END AS rng,
             array_to_string(list_transform(ls[lo:m - 1], lambda x: ' ' || x || chr(10)), '') AS before,
             array_to_string(list_transform(ls[m + 1:hi], lambda x: ' ' || x || chr(10)), '') AS after
      FROM d2),
strict AS (SELECT *, 'diff --git a/' || f || ' b/' || f || chr(10) || '--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || '@@ -' || rng || ' +' || rng || ' @@' || chr(10)
                     || before || '-' || ls[m] || chr(10) || '+patched ' || CAST(m AS VARCHAR) || chr(10) || after AS accepted FROM d)"""


def patch_accepted(spark, sf_dir):
    """Every rendered patch with the strict text that stands for it, where it is acceptable as it is."""
    patches, lines = render_file_patches(Tables(spark, sf_dir).documents)
    r = accepted_patches(patches, lines, instance_col="instance_id")
    return r.select(F.col("patch_id").alias("doc_id"), F.md5("accepted").alias("accepted_md5"))


register("patch_accepted", f"""
WITH {_PATCHED_SQL}
SELECT doc_id, CASE WHEN kind IN (5, 7, 8) OR kind = 3 AND n > 1 THEN NULL ELSE md5(accepted) END AS accepted_md5 FROM strict
""")(patch_accepted)


def patch_first_valid(spark, sf_dir):
    patches, lines = render_file_patches(Tables(spark, sf_dir).documents)
    r = first_valid_variant(patches, lines, instance_col="instance_id")
    return r.select(F.col("patch_id").alias("doc_id"), "variant", F.md5("valid_patch").alias("valid_md5"))


register("patch_first_valid", f"""
WITH {_PATCHED_SQL}
SELECT doc_id, CASE WHEN kind IN (7, 8) THEN NULL WHEN kind = 3 AND n > 1 THEN 'minimal' WHEN kind = 5 THEN 'default_no_blank' ELSE 'default' END AS variant,
       CASE WHEN kind NOT IN (7, 8) THEN md5(accepted) END AS valid_md5
FROM strict
""")(patch_first_valid)


def patch_minimal(spark, sf_dir):
    patches, _ = render_file_patches(Tables(spark, sf_dir).documents)
    r = minimal_patches(parse_patches(patches), "patch_id")
    return r.select(F.col("patch_id").alias("doc_id"), F.md5("patch").alias("minimal_md5"))


register("patch_minimal", f"""
WITH {_PATCHED_SQL},
p AS (SELECT *, CAST(m + CASE WHEN kind = 1 THEN 7 ELSE 0 END AS VARCHAR) AS place FROM d)
SELECT doc_id, md5('--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || CASE WHEN kind = 5 THEN chr(10) ELSE '' END
                   || '@@ -' || place || ' +' || place || ' @@' || chr(10)
                   || '-' || CASE WHEN kind = 8 THEN 'no such line' ELSE ls[m] END || CASE WHEN kind = 2 THEN ' ' || chr(9) ELSE '' END || chr(10)
                   || '+patched ' || CAST(m AS VARCHAR) || CASE WHEN kind = 4 THEN '  ' ELSE '' END
                   || CASE WHEN kind = 7 THEN '' ELSE chr(10) END) AS minimal_md5
FROM p
""")(patch_minimal)


def patch_collapse(spark, sf_dir):
    patches, _ = render_file_patches(Tables(spark, sf_dir).documents)
    c = collapse_blank_before_hunks(F.col("patch"))
    return patches.select(F.col("patch_id").alias("doc_id"), F.md5(c).alias("patch_md5"))


register("patch_collapse", f"""
WITH {_PATCHED_SQL},
p AS (SELECT *, CAST(lo + CASE WHEN kind = 1 THEN 7 ELSE 0 END AS VARCHAR) || CASE WHEN hi = lo THEN '' ELSE ',' || CAST(hi - lo + 1 AS VARCHAR) END AS stated,
             '-' || CASE WHEN kind = 8 THEN 'no such line' ELSE ls[m] END || CASE WHEN kind = 2 THEN ' ' || chr(9) ELSE '' END AS taken,
             '+patched ' || CAST(m AS VARCHAR) || CASE WHEN kind = 4 THEN '  ' ELSE '' END AS put,
             CASE WHEN kind = 3 AND m > lo THEN lo WHEN kind = 3 AND hi > lo THEN lo + 1 ELSE 0 END AS odd
      FROM d),
t AS (SELECT *, CASE WHEN kind = 6
                THEN array_to_string(list_transform(ls[lo:hi], lambda x: '-' || x), chr(10)) || chr(10)
                     || array_to_string(list_transform(ls[lo:hi], lambda x, k: CASE WHEN lo + k - 1 = m THEN put ELSE '+' || x END), chr(10))
                ELSE array_to_string(list_transform(ls[lo:hi], lambda x, k: CASE WHEN lo + k - 1 = m THEN taken || chr(10) || put
                                     ELSE ' ' || x || CASE WHEN lo + k - 1 = odd THEN ' X' ELSE '' END END), chr(10)) END AS body
      FROM p)
SELECT doc_id, md5('--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || '@@ -' || stated || ' +' || stated || ' @@' || chr(10) || body
                   || CASE WHEN kind = 7 THEN '' ELSE chr(10) END) AS patch_md5
FROM t
""")(patch_collapse)


# ------------------------------------------------------------------ PCH-9
def test_patch_context(spark, sf_dir):
    """Orders without line items have no parsable test patch: they get the fallback sentence."""
    from quarry.operators.render import NO_TESTS_TEXT, test_patch_text
    inst = _instances(spark, sf_dir)
    tp = F.when(F.col("patch") == "", F.lit(None).cast("string")).otherwise(F.col("patch"))
    t = test_patch_text(tp)
    return inst.select("instance_id", (t == F.lit(NO_TESTS_TEXT)).cast("long").alias("is_fallback"),
                       (F.length(t) - F.length(F.col("patch"))).cast("long").alias("added_chars"))


register("test_patch_context", """
SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS instance_id,
       CAST(NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS is_fallback,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
                 THEN length('Here the test patch for the issue:') + 2 - 1 ELSE length('No test cases.') END AS BIGINT) AS added_chars
FROM orders
""")(test_patch_context)
