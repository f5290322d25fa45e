"""Queries: code elements from rendered Python files, index rows, exact lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.elements import element_displays, extract_elements, index_rows
from quarry.operators.lookup import exact_lookups
from quarry.plans import register
from quarry.session import shuffled, write_table
from quarry.sources.tables import Tables

PARTS_PER_FILE = 8
FILES_PER_INSTANCE = 10
BLOCK = 14          # lines per part block
HEADER = 3          # header lines before the first block


def render_python_files(part: DataFrame) -> DataFrame:
    """Python modules rendered from ``part``: 8 parts per file, 10 files per instance.

    Each part is a fixed 14-line block: a commented constant, a function with
    a docstring, a class with a comment and two methods (the second is
    ``async`` — so not an element — when ``p_size % 7 = 0``).  Function
    names come from ``p_name`` and repeat.  Every 17th file (``g % 17 = 5``)
    ends with a syntax error and is a raw file.
    """
    g = F.floor(F.col("p_partkey") / PARTS_PER_FILE).cast("long")
    pk = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    fname = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    put = F.when(F.col("p_size") % 7 == 0, F.lit("    async def put(self, v):")).otherwise(F.lit("    def put(self, v):"))
    lines = F.array(
        F.concat(F.lit("# constant of "), F.col("p_name")),
        F.concat(F.lit("SIZE_"), pk, F.lit(" = "), size),
        F.lit(""),
        F.concat(F.lit("def "), fname, F.lit("(x):")),
        F.concat(F.lit('    """Price of '), F.col("p_name"), F.lit('."""')),
        F.concat(F.lit("    return x * "), size),
        F.lit(""),
        F.concat(F.lit("class Part"), pk, F.lit(":")),
        F.concat(F.lit("    # brand "), F.col("p_brand")),
        F.lit("    def get(self):"),
        F.concat(F.lit("        return "), size),
        put,
        F.lit("        self.v = v"),
        F.lit(""),
    )
    # the columns move to their file before the texts are made of them, which are many times as long
    part = part.select(g.alias("g"), "p_partkey", "p_name", "p_size", "p_brand").repartition("g")
    blocks = part.select("g", "p_partkey", F.array_join(lines, "\n").alias("block"))
    files = blocks.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "block"))).alias("_b"))
    content = F.concat(F.lit("# Module for group "), F.col("g").cast("string"), F.lit("\nimport os\n\n"),
                       F.array_join(F.transform("_b", lambda x: x["block"]), "\n"),
                       F.when(F.col("g") % 17 == 5, F.lit("\ndef broken(:")).otherwise(F.lit("")))
    return files.select(
        F.concat(F.lit("repo"), F.floor(F.col("g") / FILES_PER_INSTANCE).cast("string")).alias("instance_id"),
        F.concat(F.lit("pkg/group_"), F.col("g").cast("string"), F.lit(".py")).alias("filename"),
        content.alias("content"))


def _files(spark, sf_dir):
    return render_python_files(Tables(spark, sf_dir).part)


def _elements(files):
    """The one Python job, written once: every display branch reads its output."""
    return write_table(extract_elements(files), "elements")


def _displays(files, elements, numbered: bool, read: Column | None = None):
    """Display levels written once as a table: lookups read it several times.  ``read``: the rows that they do read."""
    d = element_displays(elements, files, numbered=numbered)
    return write_table(d if read is None else d.where(read), "displays")


def element_extract(spark, sf_dir):
    e = extract_elements(_files(spark, sf_dir))
    return e.select("instance_id", "filename", "kind", "elem_type", "elem_name", "parent_name",
                    F.col("ord").cast("long").alias("ord"), F.col("start_line").cast("long").alias("start_line"),
                    F.col("end_line").cast("long").alias("end_line"), F.col("sig_lo").cast("long").alias("sig_lo"),
                    F.col("upper_lo").cast("long").alias("upper_lo"), F.col("lower_lo").cast("long").alias("lower_lo"))


_PARTS_SQL = f"""
p AS (SELECT p_partkey, p_name, p_size, CAST(floor(p_partkey / {PARTS_PER_FILE}) AS BIGINT) AS g,
             row_number() OVER (PARTITION BY floor(p_partkey / {PARTS_PER_FILE}) ORDER BY p_partkey) - 1 AS j FROM part),
f AS (SELECT g, count(*) AS m FROM p GROUP BY g),
pb AS (SELECT p.*, 'repo' || CAST(floor(g / {FILES_PER_INSTANCE}) AS BIGINT) AS instance_id,
              'pkg/group_' || CAST(g AS VARCHAR) || '.py' AS filename, {HEADER} + {BLOCK} * j AS base,
              g % 17 = 5 AS broken FROM p)"""

_LINE = "lpad(CAST(({n}) AS VARCHAR), w, ' ') || ' |' || {t} || chr(10)"
_FN_TEXT = _LINE.format(n="fbase + 4", t="'def ' || fn || '(x):'") + " || " + _LINE.format(n="fbase + 5", t="""'    \"\"\"Price of ' || p_name || '.\"\"\"'""")
_GET_TEXT = _LINE.format(n="base + 9", t="'    # brand ' || p_brand") + " || " + _LINE.format(n="base + 10", t="'    def get(self):'")
_PUT_TEXT = _LINE.format(n="base + 12", t="'    def put(self, v):'")
_CLASS_HEAD = _LINE.format(n="base + 8", t="'class ' || cls || ':'") + " || " + _LINE.format(n="base + 9", t="'    # brand ' || p_brand")
_CLASS_TEXT = (_CLASS_HEAD + " || " + _GET_TEXT
               + f" || chr(10) || CASE WHEN p_size % 7 = 0 THEN '' ELSE {_PUT_TEXT} || chr(10) END")
_LN_SQL = f"""ln AS (
  SELECT g, 0 AS n, '# Module for group ' || CAST(g AS VARCHAR) AS t FROM f UNION ALL SELECT g, 1, 'import os' FROM f UNION ALL SELECT g, 2, '' FROM f
  UNION ALL SELECT pb.g, base + k, [
    '# constant of ' || p_name, 'SIZE_' || CAST(p_partkey AS VARCHAR) || ' = ' || CAST(p_size AS VARCHAR), '', 'def ' || replace(p_name, ' ', '_') || '(x):',
    '    \"\"\"Price of ' || p_name || '.\"\"\"', '    return x * ' || CAST(p_size AS VARCHAR), '', 'class Part' || CAST(p_partkey AS VARCHAR) || ':', '    # brand ' || p_brand,
    '    def get(self):', '        return ' || CAST(p_size AS VARCHAR), CASE WHEN p_size % 7 = 0 THEN '    async def put(self, v):' ELSE '    def put(self, v):' END, '        self.v = v', ''][k + 1]
  FROM (SELECT pb.*, part.p_brand FROM pb JOIN part USING (p_partkey)) pb, (SELECT unnest(range(14)) AS k))"""

register("element_extract", f"""
WITH {_PARTS_SQL},
fe AS (SELECT 'repo' || CAST(floor(g / {FILES_PER_INSTANCE}) AS BIGINT) AS instance_id, 'pkg/group_' || CAST(g AS VARCHAR) || '.py' AS filename,
              g % 17 = 5 AS broken, {HEADER} + {BLOCK} * m + CASE WHEN g % 17 = 5 THEN 1 ELSE 0 END AS n FROM f),
rows AS (
  SELECT instance_id, filename, CASE WHEN broken THEN 'raw' ELSE 'module' END AS kind, 'module' AS elem_type, filename AS elem_name,
         '' AS parent_name, 0 AS ord, 1 AS start_line, n AS end_line, NULL AS sig_lo, NULL AS upper_lo,
         CASE WHEN broken THEN NULL ELSE 0 END AS lower_lo FROM fe
  UNION ALL SELECT instance_id, filename, 'module', 'import', 'import os', '', 0, 2, 2, NULL, NULL, NULL FROM fe WHERE NOT broken
  UNION ALL SELECT instance_id, filename, 'module', 'constant', 'SIZE_' || CAST(p_partkey AS VARCHAR), '', 1 + 3 * j, base + 2, base + 2, NULL, base, NULL FROM pb WHERE NOT broken
  UNION ALL SELECT instance_id, filename, 'module', 'function', replace(p_name, ' ', '_'), '', 2 + 3 * j, base + 4, base + 6, base + 3, NULL, base + 4 FROM pb WHERE NOT broken
  UNION ALL SELECT instance_id, filename, 'module', 'class', 'Part' || CAST(p_partkey AS VARCHAR), '', 3 + 3 * j, base + 8, base + 13, base + 7, NULL, base + 8 FROM pb WHERE NOT broken
  UNION ALL SELECT instance_id, filename, 'module', 'method', 'get', 'Part' || CAST(p_partkey AS VARCHAR), 0, base + 10, base + 11, base + 9, base + 8, NULL FROM pb WHERE NOT broken
  UNION ALL SELECT instance_id, filename, 'module', 'method', 'put', 'Part' || CAST(p_partkey AS VARCHAR), 1, base + 12, base + 13, base + 11, NULL, NULL FROM pb WHERE NOT broken AND p_size % 7 <> 0)
SELECT instance_id, filename, kind, elem_type, elem_name, parent_name, CAST(ord AS BIGINT) AS ord, CAST(start_line AS BIGINT) AS start_line,
       CAST(end_line AS BIGINT) AS end_line, CAST(sig_lo AS BIGINT) AS sig_lo, CAST(upper_lo AS BIGINT) AS upper_lo, CAST(lower_lo AS BIGINT) AS lower_lo
FROM rows
""")(element_extract)


def index_rows_q(spark, sf_dir):
    files = _files(spark, sf_dir)
    d = element_displays(_elements(files), files, numbered=False)
    r = index_rows(d).where(F.length("content") > 0)
    return r.select("instance_id", "filename", "elem_type", "elem_name", "display_level")


register("index_rows", f"""
WITH {_PARTS_SQL}
SELECT DISTINCT instance_id, filename, 'module' AS elem_type, filename AS elem_name, unnest(['minimal', 'moderate', 'full']) AS display_level FROM pb WHERE NOT broken
UNION ALL SELECT DISTINCT instance_id, filename, 'module', filename, '' FROM pb WHERE broken
UNION ALL SELECT DISTINCT instance_id, filename, 'function', replace(p_name, ' ', '_'), 'minimal' FROM pb WHERE NOT broken
UNION ALL SELECT instance_id, filename, 'class', 'Part' || CAST(p_partkey AS VARCHAR), 'minimal' FROM pb WHERE NOT broken
""")(index_rows_q)


def lookup_queries(part: DataFrame) -> DataFrame:
    """One exact-lookup query per part; the kind cycles with ``p_partkey % 4``."""
    g = F.floor(F.col("p_partkey") / PARTS_PER_FILE)
    kind = F.col("p_partkey") % 4
    inst = F.concat(F.lit("repo"), F.floor(g / FILES_PER_INSTANCE).cast("string"))
    return part.select(
        F.col("p_partkey").alias("query_id"), inst.alias("instance_id"),
        F.when(kind == 0, "function").when(kind == 1, "method").when(kind == 2, "class").otherwise("file").alias("query_kind"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("fn_name"),
        F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("class_name"),
        F.when(F.col("p_size") % 2 == 0, F.lit("get")).otherwise(F.lit("put")).alias("method_name"),
        F.concat(F.lit("pkg/group_"), g.cast("string"), F.lit(".py")).alias("filename"),
        (F.col("p_size") % 30).cast("long").alias("line_start"),
        F.when(F.col("p_size") % 3 == 0, F.lit(-1)).otherwise(F.col("p_size") % 30 + 5).cast("long").alias("line_end"),
        F.lit(None).cast("string").alias("semantic"))


def exact_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    files = _files(spark, sf_dir)
    d = _displays(files, _elements(files), numbered=True)
    hits = exact_lookups(lookup_queries(t.part), d, files)
    return hits.select("query_id", "source", "filename", "elem_type", "elem_name")


register("exact_lookup", f"""
WITH {_PARTS_SQL},
q AS (SELECT p_partkey AS query_id, 'repo' || CAST(floor(g / {FILES_PER_INSTANCE}) AS BIGINT) AS instance_id, p_partkey % 4 AS kind,
             replace(p_name, ' ', '_') AS fn_name, p_size FROM p),
fns AS (SELECT DISTINCT instance_id, filename, replace(p_name, ' ', '_') AS fn_name FROM pb WHERE NOT broken)
SELECT q.query_id, 'exact' AS source, f.filename, 'function' AS elem_type, q.fn_name AS elem_name
FROM q JOIN fns f ON f.instance_id = q.instance_id AND f.fn_name = q.fn_name WHERE q.kind = 0
UNION ALL
SELECT pb.p_partkey, 'exact', pb.filename, 'method', CASE WHEN pb.p_size % 2 = 0 THEN 'get' ELSE 'put' END
FROM pb WHERE NOT pb.broken AND pb.p_partkey % 4 = 1 AND (pb.p_size % 2 = 0 OR pb.p_size % 7 <> 0)
UNION ALL
SELECT pb.p_partkey, 'exact', pb.filename, 'class', 'Part' || CAST(pb.p_partkey AS VARCHAR) FROM pb WHERE NOT pb.broken AND pb.p_partkey % 4 = 2
UNION ALL
SELECT pb.p_partkey, 'exact', pb.filename, 'file', pb.filename FROM pb WHERE NOT pb.broken AND pb.p_partkey % 4 = 3
""")(exact_lookup)


# ------------------------------------------------------------------ PCH-5 / JN-8 (rows-only)
def render_function_patches(part: DataFrame) -> DataFrame:
    """One patch per rendered file: every part's function gets ``+ 1`` on its return line."""
    g = F.floor(F.col("p_partkey") / PARTS_PER_FILE).cast("long")
    per = part.select(g.alias("g"), "p_partkey", "p_size").groupBy("g").agg(
        F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("_p"))
    path = F.concat(F.lit("pkg/group_"), F.col("g").cast("string"), F.lit(".py"))

    def hunk(x, j):
        line = (HEADER + BLOCK * j + 6).cast("string")
        size = x["p_size"].cast("string")
        return F.concat(F.lit("@@ -"), line, F.lit(",1 +"), line, F.lit(",1 @@\n-    return x * "), size,
                        F.lit("\n+    return x * "), size, F.lit(" + 1"))

    text = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"),
                    F.array_join(F.transform("_p", hunk), "\n"), F.lit("\n"))
    return per.select(F.concat(F.lit("repo"), F.floor(F.col("g") / FILES_PER_INSTANCE).cast("string")).alias("instance_id"),
                      F.concat(F.lit("fix-"), F.col("g").cast("string")).alias("patch_id"), text.alias("patch"))


def patch_context(spark, sf_dir):
    from quarry.operators.patches import parse_patches, patch_hunks
    from quarry.operators.render import fix_context
    files = _files(spark, sf_dir)
    disp = _displays(files, _elements(files), numbered=True)
    mods = disp.where((F.col("elem_type") == "module") & (F.col("kind") == "module"))
    patches = render_function_patches(Tables(spark, sf_dir).part)
    parsed = parse_patches(patches, "patch_id", "patch", keep=("instance_id",))
    h = patch_hunks(parsed.withColumnRenamed("patch_id", "_pid"), "_pid")
    h = shuffled(h).join(patches.select(F.col("patch_id").alias("_pid"), "instance_id"), "_pid")
    h = h.where(F.col("modified") & F.col("path").endswith(".py")).select("instance_id", "path", "src_start", "src_len", "hunk_no")
    ctx, _unmatched = fix_context(h, files, mods)
    return ctx.select("instance_id", "n_parts", F.length("context").cast("long").alias("text_len"))


register("patch_context")(patch_context)


# ------------------------------------------------------------------ ELM-9 / ELM-10
def located_items(part: DataFrame) -> DataFrame:
    """One located item per part, in its own file: kind by ``p_partkey % 4``, category ``fix`` for even sizes."""
    g = F.floor(F.col("p_partkey") / PARTS_PER_FILE)
    m = F.col("p_partkey") % 4
    size = F.col("p_size").cast("long")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("repo"), F.floor(g / FILES_PER_INSTANCE).cast("string")).alias("instance_id"),
        F.concat(F.lit("pkg/group_"), g.cast("string"), F.lit(".py")).alias("filename"),
        F.when(m == 0, "function").when(m == 1, "class").when(m == 2, "method").otherwise("lines").alias("kind"),
        F.when(F.col("p_size") % 2 == 0, "fix").otherwise("context").alias("category"),
        F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("class_name"),
        F.when(m == 2, F.lit("get")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("fn_name"),
        (size % 20).alias("line_lo"), (size % 20 + size % 7).alias("line_hi"))


def locate_context(spark, sf_dir):
    from quarry.operators.lookup import located_context
    files = _files(spark, sf_dir)
    disp = _displays(files, _elements(files), numbered=True)
    r = located_context(located_items(Tables(spark, sf_dir).part), disp, files)
    return r.select("item_id", "filename", F.col("kind").alias("elem_type"), "display_level", F.md5("display").alias("text_md5"))


register("locate_context", f"""
WITH {_PARTS_SQL},
{_LN_SQL},
x AS (
  SELECT pb.*, part.p_brand, CAST(length(CAST({HEADER} + {BLOCK} * f.m + CASE WHEN broken THEN 1 ELSE 0 END AS VARCHAR)) AS INTEGER) AS w, replace(pb.p_name, ' ', '_') AS fn, 'Part' || CAST(p_partkey AS VARCHAR) AS cls,
         max(base) OVER (PARTITION BY pb.g, pb.p_name) AS fbase, CAST(p_partkey % 4 AS INTEGER) AS kind, pb.p_size % 2 = 0 AS fix,
         pb.p_size % 20 - CASE WHEN pb.p_size % 20 > 0 THEN 1 ELSE 0 END AS lo, pb.p_size % 20 + pb.p_size % 7 + 1 AS hi
  FROM pb JOIN part USING (p_partkey) JOIN f USING (g)),
lx AS (SELECT g, n, t FROM ln UNION ALL SELECT DISTINCT pb.g, {HEADER} + {BLOCK} * f.m, 'def broken(:' FROM pb JOIN f USING (g) WHERE broken),
rng AS (SELECT p_partkey, string_agg(lpad(CAST(lx.n + 1 AS VARCHAR), w, ' ') || ' |' || lx.t, chr(10) ORDER BY lx.n) || chr(10) AS t
        FROM x JOIN lx ON lx.g = x.g AND lx.n >= lo AND lx.n < hi WHERE kind = 3 GROUP BY p_partkey),
ret AS (SELECT x.p_partkey, max(CASE WHEN lx.n = fbase + 5 THEN lx.t END) AS fn_ret, max(CASE WHEN lx.n = base + 10 THEN lx.t END) AS get_ret FROM x JOIN lx ON lx.g = x.g GROUP BY x.p_partkey)
SELECT x.p_partkey AS item_id, filename, ['function', 'class', 'method', 'lines'][kind + 1] AS elem_type,
       CASE WHEN kind IN (0, 2) THEN CASE WHEN fix THEN 'full' ELSE 'moderate' END WHEN kind = 1 THEN CASE WHEN fix THEN 'moderate' ELSE 'signature' END END AS display_level,
       md5(CASE WHEN kind = 3 THEN rng.t WHEN broken THEN NULL
                WHEN kind = 0 THEN {_FN_TEXT} || CASE WHEN fix THEN {_LINE.format(n="fbase + 6", t="fn_ret")} ELSE '' END
                WHEN kind = 2 THEN {_GET_TEXT} || CASE WHEN fix THEN {_LINE.format(n="base + 11", t="get_ret")} ELSE '' END
                WHEN fix THEN {_CLASS_TEXT}
                ELSE {_CLASS_HEAD} || {_LINE.format(n="base + 10", t="'    def get(self):'")} || chr(10) || CASE WHEN p_size % 7 = 0 THEN '' ELSE {_PUT_TEXT} || chr(10) END END) AS text_md5
FROM x LEFT JOIN rng USING (p_partkey) JOIN ret USING (p_partkey)
""")(locate_context)


# ------------------------------------------------------------------ PRM-3 / PRM-5 (rows-only)
def display_ladder(spark, sf_dir):
    """Per module file the richest display under the ladder limit, with a short label per element."""
    from quarry.operators.render import brief_label, budget_ladder
    files = _files(spark, sf_dir)
    d = _displays(files, _elements(files), numbered=True)
    mods = d.where((F.col("elem_type") == "module") & (F.col("kind") == "module")).groupBy("instance_id", "filename").agg(
        *[F.max(F.when(F.col("display_level") == lv, F.col("display"))).alias(lv) for lv in ("full", "moderate", "signature")])
    lv = F.when(F.length("full") < 32000, "full").when(F.length("moderate") < 32000, "moderate").otherwise("signature")
    chosen = budget_ladder([F.col("full"), F.col("moderate"), F.col("signature")])
    labels = d.where(F.col("display_level") == "signature").groupBy("instance_id", "filename").agg(
        F.count_if(F.col("elem_type").isin("function", "class", "method")).alias("n_labelled"),
        F.max(brief_label(F.col("elem_type"), F.col("elem_name"), F.col("parent_name"), F.col("filename"))).alias("a_label"))
    return shuffled(mods.select("instance_id", "filename", lv.alias("level"), F.length(chosen).cast("long").alias("text_len"))) \
        .join(labels, ["instance_id", "filename"])


register("display_ladder")(display_ladder)
