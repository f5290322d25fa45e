"""Queries: index maintenance, cached inference, sinks and scans, boundary chunks, fallback, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import adler32_bucket
from quarry.functions.replies import parse_block
from quarry.functions.text import raw_elem_type
from quarry.operators.chunking import BOUNDARIES, LEAST_PART, boundary_chunks, fixed_chunks
from quarry.operators.elements import element_counts, extract_elements, index_rows, indexed
from quarry.operators.index import build_text_index
from quarry.operators.inference import (cache_key, call_cached, echo_model, embed_text, hashing_embedder, invoke_prompt,
                                        rule_failing_provider)
from quarry.operators.answers import staged_answers
from quarry.operators.lookup import looked_up, lookup_with_fallback
from quarry.operators.maintenance import new_version_path, tag_rows, write_files, write_predictions, write_text_per_instance
from quarry.operators.stats import outcome_counts
from quarry.operators.versions import manifest, read_index, unbuilt, write_version
from quarry.plans import register
from quarry.operators.build import build_index, embed_rows, search_by_text
from quarry.plans.element_plans import (_CLASS_TEXT, _FN_TEXT, _GET_TEXT, _LN_SQL, _PARTS_SQL, _PUT_TEXT, BLOCK, FILES_PER_INSTANCE, HEADER, PARTS_PER_FILE, _displays, _elements,
                                        _files, lookup_queries, render_python_files)
from quarry.plans.fixtures import chunk_offsets_sql, doc_filename
from quarry.plans.patch_plans import render_diffs, render_logs
from quarry.plans.search_plans import _adler_bucket_sql
from quarry.session import cut_lineage, shuffled, write_table
from quarry.sources.files import scan_eval_logs, scan_source_tree
from quarry.sources.tables import Tables, table_path
from quarry.streaming.index_stream import start_index_stream


# ------------------------------------------------------------------ SNK-1..SNK-4, JN-2, SET-1, SET-2
def _raw_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("instance_id"),
                       doc_filename().alias("filename"), "text").select(
        "instance_id", "filename", F.col("filename").alias("elem_name"), F.lit("").alias("parent_name"),
        raw_elem_type("filename").alias("elem_type"), F.lit("").alias("display_level"), F.col("text").alias("content"))


def _index_rows_for(docs: DataFrame, capacity: int) -> DataFrame:
    return tag_rows(fixed_chunks(_raw_rows(docs), "content", capacity))


def index_maintenance(spark, sf_dir):
    """Build en/fr, build what is missing, then rebuild fr with a smaller capacity and empty one instance.

    Returns each instance of the last manifest with its row counts, and the version that wrote its shard.
    """
    docs = Tables(spark, sf_dir).documents
    inst = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    root = new_version_path(spark, "index")
    ids = lambda d: d.select(inst.alias("instance_id")).distinct()
    shard = lambda n: adler32_bucket("instance_id", n).cast("int")
    first = docs.where(F.col("lang").isin("en", "fr"))
    write_version(spark, root, _index_rows_for(first, 4096), ids(first), shard=shard)
    todo = unbuilt(ids(docs), manifest(spark, root))
    write_version(spark, root, _index_rows_for(docs.join(todo, inst == todo["instance_id"], "left_semi"), 4096), todo, shard=shard)
    fr = docs.where((F.col("lang") == "fr") & (F.col("source") != EMPTIED))
    write_version(spark, root, _index_rows_for(fr, 2048), ids(docs.where((F.col("lang") == "fr") | ((F.col("source") == EMPTIED) & (F.col("lang") == "en")))), shard=shard)
    batches = None
    for v in (1, 2, 3):
        b = manifest(spark, root, v).select("batch").distinct().withColumn("version", F.lit(v))
        batches = b if batches is None else batches.unionByName(b)
    written = batches.groupBy("batch").agg(F.min("version").cast("long").alias("written_in"))
    m = manifest(spark, root).join(written, "batch")
    rows = read_index(spark, root).groupBy("instance_id").agg(F.count(F.lit(1)).cast("long").alias("n_found"), F.max("split_idx").cast("long").alias("max_split"),
                                                              F.count_if("exact_only").cast("long").alias("n_exact_only"))
    return m.join(rows, "instance_id", "left").select("instance_id", "n_rows", F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"), "max_split", "n_exact_only", "written_in")


#: The source whose instances the last change empties.
EMPTIED = "src3"


# ------------------------------------------------------------------ index build and search by text
def index_build(spark, sf_dir):
    """The whole build over the rendered modules: rows of all chunks, exact-only rows and unit vectors per instance."""
    index = build_index(spark, _files(spark, sf_dir), capacity=BUILD_CAPACITY)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return index.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("exact_only").alias("n_exact_only"),
                                        F.count_if(F.abs(norm - 1) < 1e-9).alias("n_vectors"))


#: Characters of an index chunk in the build query: whole modules take several.
BUILD_CAPACITY = 1024
register("index_build", f"""
WITH {_PARTS_SQL},
x AS (
  SELECT pb.*, length(pb.p_name) AS nl, length(part.p_brand) AS bl, length(CAST(pb.p_partkey AS VARCHAR)) AS kl, length(CAST(pb.p_size AS VARCHAR)) AS sl,
         row_number() OVER (PARTITION BY pb.g, pb.p_name ORDER BY pb.p_partkey DESC) AS last
  FROM pb JOIN part USING (p_partkey)),
-- lengths of the parts of a block: constant with its comment, function (as shown, whole), class header, members (as shown), the whole block
b AS (
  SELECT *, 14 + nl + 1 AS up_const, 8 + kl + sl + 1 AS const, 8 + nl + 1 AS sig, 20 + nl + 1 AS doc, 15 + sl + 1 AS ret, 11 + kl + 1 AS cls, 12 + bl + 1 AS brand, 18 + 1 AS get, 15 + sl + 1 AS getret,
         CASE WHEN p_size % 7 = 0 THEN 27 ELSE 21 END + 1 AS put, 18 + 1 AS putv
  FROM x),
h AS (SELECT g, count(*) AS m, 19 + length(CAST(g AS VARCHAR)) + 1 AS head, 10 AS imp, sum(up_const + const + 1 + sig + doc + ret + 1 + cls + brand + get + getret + put + putv + 1) AS blocks,
             sum(up_const + const + sig + doc + cls + brand + (brand + get) + 1 + CASE WHEN p_size % 7 = 0 THEN 0 ELSE put + 1 END) AS shown, bool_or(broken) AS broken FROM b GROUP BY g),
r AS (
  SELECT DISTINCT pb.instance_id, pb.filename, pb.filename AS name, lv.level,
         CASE lv.level WHEN 'minimal' THEN h.head WHEN 'moderate' THEN h.head + h.imp + h.shown + 3 * h.m + 1 ELSE h.head + h.imp + 1 + h.blocks END AS len
  FROM pb JOIN h USING (g), (SELECT unnest(['minimal', 'moderate', 'full']) AS level) lv WHERE NOT h.broken
  UNION ALL SELECT DISTINCT pb.instance_id, pb.filename, pb.filename, '', h.head + h.imp + 1 + h.blocks + 12 FROM pb JOIN h USING (g) WHERE h.broken
  UNION ALL SELECT instance_id, filename, replace(p_name, ' ', '_'), 'minimal', sig + doc FROM b WHERE NOT broken AND last = 1
  UNION ALL SELECT instance_id, filename, 'Part' || CAST(p_partkey AS VARCHAR), 'minimal', cls + brand FROM b WHERE NOT broken),
e AS (SELECT *, level = 'full' OR filename LIKE '%test%' OR filename LIKE '%example%' OR name LIKE '%test%' OR name LIKE '%example%' AS exact_only,
             1 + CASE WHEN len > {BUILD_CAPACITY} THEN CAST(ceil((len - {BUILD_CAPACITY}) / {float(BUILD_CAPACITY - BUILD_CAPACITY // 8)}) AS BIGINT) ELSE 0 END AS chunks FROM r)
SELECT instance_id, CAST(sum(chunks) AS BIGINT) AS n_rows, CAST(coalesce(sum(chunks) FILTER (exact_only), 0) AS BIGINT) AS n_exact_only,
       CAST(coalesce(sum(chunks) FILTER (NOT exact_only), 0) AS BIGINT) AS n_vectors
FROM e GROUP BY instance_id
""")(index_build)


TEXT_SEARCH_K = 3


def text_vector_search(spark, sf_dir):
    """Benchmark texts, embedded, against the embedded documents of one language each: L1 top 3."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("instance_id"), "text")
    corpus = docs.join(embed_rows(docs, "id", "text", EMBED_DIM), "id")
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("item_id") % 4 + 1).cast("int"))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), lang.alias("instance_id"), "text")
    r = search_by_text(corpus.drop("text"), q, k=TEXT_SEARCH_K, dim=EMBED_DIM, dedup=False)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("distance", 4).alias("distance"))


register("text_vector_search", f"""
WITH x AS (
  SELECT 'd' AS kind, doc_id AS id, lang AS instance_id, text FROM documents
  UNION ALL SELECT 'q', item_id, ['en', 'de', 'fr', 'es'][item_id % 4 + 1], text FROM benchmark),
w AS (SELECT kind, id, md5(unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM x),
b AS (
  SELECT kind, id, CAST('0x' || substr(h, 1, 6) AS BIGINT) % {{DIM}} AS b, sum(CASE WHEN CAST('0x' || substr(h, 7, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s
  FROM w GROUP BY ALL),
n AS (SELECT kind, id, sqrt(sum(s * s)) AS n FROM b GROUP BY ALL),
v AS (SELECT x.kind, x.id, x.instance_id, g.b, CASE WHEN coalesce(n.n, 0) > 0 THEN coalesce(b.s, 0) / n.n ELSE 0.0 END AS v
      FROM x CROSS JOIN (SELECT unnest(range(0, {{DIM}})) AS b) g LEFT JOIN b ON b.kind = x.kind AND b.id = x.id AND b.b = g.b
      LEFT JOIN n ON n.kind = x.kind AND n.id = x.id),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(abs(q.v - d.v)), 6) AS distance
      FROM v q JOIN v d ON q.kind = 'q' AND d.kind = 'd' AND q.instance_id = d.instance_id AND q.b = d.b GROUP BY q.id, d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(distance, 4) AS distance FROM r WHERE rank <= {TEXT_SEARCH_K}
""".replace("{DIM}", "64"))(text_vector_search)


def _chunk_count_sql(cap: int) -> str:
    step = cap - cap // 8
    return (f"CASE WHEN length(text) = 0 THEN 0 WHEN length(text) > {cap} THEN 1 + CAST(ceil((length(text) - {cap}) / {float(step)}) AS BIGINT) ELSE 1 END")


register("index_maintenance", f"""
WITH d AS (SELECT source || '/' || lang AS instance_id, source, lang, text,
                  source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
                    || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS filename FROM documents),
c AS (SELECT instance_id, source, lang, filename,
             CASE WHEN source = '{EMPTIED}' AND lang IN ('fr', 'en') THEN 0 WHEN lang = 'fr' THEN {_chunk_count_sql(2048)} ELSE {_chunk_count_sql(4096)} END AS n,
             CASE WHEN lang = 'fr' THEN 1792 ELSE 3584 END AS step FROM d),
g AS (SELECT instance_id, min(source) AS source, min(lang) AS lang, {_adler_bucket_sql('instance_id', 8)} AS shard, CAST(sum(n) AS BIGINT) AS n_rows,
             CAST(max(CASE WHEN n > 0 THEN (n - 1) * step END) AS BIGINT) AS max_split,
             CAST(sum(CASE WHEN filename LIKE '%test%' OR filename LIKE '%example%' THEN n ELSE 0 END) AS BIGINT) AS n_exact_only
      FROM c GROUP BY instance_id),
s AS (SELECT shard, max(CASE WHEN lang = 'fr' OR source = '{EMPTIED}' AND lang = 'en' THEN 3 WHEN lang != 'en' THEN 2 ELSE 1 END) AS written_in FROM g GROUP BY shard)
SELECT instance_id, n_rows, n_rows AS n_found, max_split, CASE WHEN n_rows > 0 THEN n_exact_only END AS n_exact_only, CAST(written_in AS BIGINT) AS written_in
FROM g JOIN s USING (shard)
""")(index_maintenance)


# ------------------------------------------------------------------ INF-1, INF-5, TXT-7
EMBED_DIM = 64


def _embed_requests(docs: DataFrame) -> DataFrame:
    """A request per chunk: texts are cut before they are embedded, so none is over the limit."""
    chunks = fixed_chunks(docs.select("doc_id", "source", "lang", F.col("text").alias("content")), "content")
    return chunks.select(cache_key("text_search", "source", "doc_id", "split_idx").alias("key"),
                         embed_text(F.col("content")).alias("prompt"), "lang")


def embed_cached(spark, sf_dir):
    """English documents were embedded before; the second run reuses them."""
    req = _embed_requests(Tables(spark, sf_dir).documents)
    _, cache0 = call_cached(req.where(F.col("lang") == "en"), None, hashing_embedder(EMBED_DIM))
    cache0 = cut_lineage(cache0)
    ans, _ = call_cached(req, cache0, hashing_embedder(EMBED_DIM))
    dims = F.size(F.from_json("value", "array<double>"))
    return ans.select("key", "status", F.col("cached").cast("long").alias("cached"),
                      F.when(F.col("status") == "ok", dims).cast("long").alias("n_dims"))


register("embed_cached", f"""
WITH r AS (SELECT 'text_search_' || source || '_' || CAST(doc_id AS VARCHAR) || '_' || CAST(unnest({chunk_offsets_sql('length(text)')}) AS VARCHAR) AS key, lang
           FROM documents WHERE length(text) > 0)
SELECT key, 'ok' AS status, CAST(lang = 'en' AS BIGINT) AS cached, CAST({EMBED_DIM} AS BIGINT) AS n_dims FROM r
""")(embed_cached)


# ------------------------------------------------------------------ INF-2
SYSTEM_TEXT = "You are a careful assistant."


def infer_cached(spark, sf_dir):
    conv = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    req = conv.select(cache_key("chat", "conv_id", "turn").alias("key"),
                      invoke_prompt(F.col("text"), None, SYSTEM_TEXT).alias("prompt"))
    ans, _ = call_cached(req, None, echo_model, kind="prompt")
    reply = F.get_json_object("value", "$")
    return ans.select("key", "status", parse_block(reply, "reason")["content"].alias("answer"))


register("infer_cached", f"""
SELECT 'chat_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS key,
       CASE WHEN length('{SYSTEM_TEXT}____' || text) <= 96000 THEN 'ok' ELSE 'token_limit' END AS status,
       CASE WHEN length('{SYSTEM_TEXT}____' || text) <= 96000 THEN 'length ' || CAST(length('{SYSTEM_TEXT}____' || text) AS VARCHAR) END AS answer
FROM conversations WHERE role = 'user'
""")(infer_cached)


# ------------------------------------------------------------------ INF-3, INF-4
def limits_and_errors(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    req = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("prompt"))
    ans, _ = call_cached(req, None, rule_failing_provider, kind="embed", batch_size=1, max_attempts=2)
    return ans.groupBy("status").agg(F.count(F.lit(1)).cast("long").alias("n"))


register("limits_and_errors", """
WITH s AS (SELECT CASE WHEN length(text) > 5000 THEN 'token_limit' WHEN length(text) % 5 = 0 THEN 'rate_limited'
                       WHEN length(text) % 7 = 0 THEN 'token_limit' WHEN length(text) % 11 = 0 THEN 'error' ELSE 'ok' END AS status
           FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key, text FROM documents))
SELECT status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY status
""")(limits_and_errors)


# ------------------------------------------------------------------ SNK-5 / SNK-6
def predictions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inst = render_diffs(t.orders, t.lineitem)
    preds = inst.select("instance_id", F.col("patch").alias("model_patch"), F.lit("quarry-model").alias("model_name_or_path"))
    path = new_version_path(spark, "predictions")
    write_predictions(preds, path)
    back = spark.read.schema("instance_id string, model_patch string, model_name_or_path string").json(path)
    return back.select("instance_id", "model_name_or_path", (F.length("model_patch") > 0).cast("long").alias("has_patch"))


register("predictions", """
SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS instance_id, 'quarry-model' AS model_name_or_path,
       CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS has_patch
FROM orders
""")(predictions)


# ------------------------------------------------------------------ SRC-5 / SRC-6
def _tree_rows(spark, sf_dir) -> DataFrame:
    files = render_python_files(Tables(spark, sf_dir).part)
    code = files.select(F.concat("instance_id", F.lit("/"), "filename").alias("filename"), "content")
    insts = files.select("instance_id").distinct()
    extra = []
    for rel, body in [("README.md", "# readme\n"), ("docs/notes.txt", "notes\n"), ("venv/lib/site.py", "x = 1\n"),
                      ("pkg/__pycache__/group.pyc", "bytes"), (".github/ci.py", "y = 2\n"), ("tools/README_dev.rst", "dev\n")]:
        extra.append(insts.select(F.concat("instance_id", F.lit("/" + rel)).alias("filename"), F.lit(body).alias("content")))
    out = code
    for e in extra:
        out = out.unionByName(e)
    return out


def file_scan(spark, sf_dir):
    root = new_version_path(spark, "tree")
    write_files(_tree_rows(spark, sf_dir), root)
    scanned = scan_source_tree(spark, root)
    return scanned.select(F.element_at(F.split("filename", "/"), 1).alias("instance_id"),
                          F.regexp_replace("filename", "^[^/]+/", "").alias("filename"), "kind")


register("file_scan", f"""
WITH g AS (SELECT DISTINCT CAST(floor(p_partkey / {PARTS_PER_FILE}) AS BIGINT) AS g FROM part),
f AS (SELECT 'repo' || CAST(floor(g / {FILES_PER_INSTANCE}) AS BIGINT) AS instance_id, 'pkg/group_' || CAST(g AS VARCHAR) || '.py' AS filename FROM g)
SELECT instance_id, filename, 'module' AS kind FROM f
UNION ALL SELECT DISTINCT instance_id, 'README.md', 'raw' FROM f
UNION ALL SELECT DISTINCT instance_id, 'tools/README_dev.rst', 'raw' FROM f
""")(file_scan)


# ------------------------------------------------------------------ SRC-9 + AGG-5/6
ORDERS_PER_LOG = 8


def eval_log_counts(spark, sf_dir):
    """One log file per run of 8 consecutive orders, read back and classified."""
    t = Tables(spark, sf_dir)
    logs = render_logs(t.orders.where("o_orderkey IS NOT NULL"), keep=("o_orderkey",))
    logs = logs.withColumn("run", F.floor(F.col("o_orderkey") / ORDERS_PER_LOG).cast("long"))
    per = logs.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "content"))).alias("_l"))
    files = per.select(F.concat(F.lit("run-"), F.col("run").cast("string"), F.lit(".eval.log")).alias("filename"),
                       F.array_join(F.transform("_l", lambda x: x["content"]), "\n").alias("content"))
    root = new_version_path(spark, "logs")
    write_files(files, root)
    write_files(logs.limit(1).select(F.lit("ignored.txt").alias("filename"), "content"), root)
    return outcome_counts(scan_eval_logs(spark, root))


register("eval_log_counts", """
WITH o AS (SELECT floor(o_orderkey / 8) AS run,
                  bool_or(o_orderpriority NOT IN ('5-LOW', '2-HIGH') AND o_orderstatus = 'F') AS s_success,
                  bool_or(o_orderpriority = '2-HIGH') AS s_script,
                  bool_or(o_orderpriority NOT IN ('5-LOW', '2-HIGH') AND o_orderstatus = 'O') AS s_test,
                  bool_or(o_orderpriority NOT IN ('5-LOW', '2-HIGH') AND o_orderstatus NOT IN ('F', 'O')) AS s_install,
                  bool_or(o_orderpriority = '1-URGENT') AS s_patch
           FROM orders GROUP BY 1),
e AS (SELECT CASE WHEN s_success THEN 'success' WHEN s_script THEN 'test_script_failure' WHEN s_test THEN 'test_failure'
                  WHEN s_install THEN 'install_failure' WHEN s_patch THEN 'patch_failure' ELSE 'unknown' END AS outcome FROM o),
cats AS (SELECT * FROM (VALUES ('success', 0), ('test_script_failure', 1), ('test_failure', 2),
                               ('install_failure', 3), ('patch_failure', 4), ('unknown', 5)) AS t(outcome, ord))
SELECT c.outcome, CAST(c.ord AS INTEGER) AS ord, CAST(count(e.outcome) AS BIGINT) AS n
FROM cats c LEFT JOIN e USING (outcome) GROUP BY c.outcome, c.ord
""")(eval_log_counts)


# ------------------------------------------------------------------ TXT-1b
BOUNDARY_CAPACITY, BOUNDARY_OVERLAP = 1024, 128


def chunk_boundary(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.col("text").alias("content"))
    ch = boundary_chunks(docs, ["doc_id"], "content", BOUNDARY_CAPACITY, BOUNDARY_OVERLAP)
    return ch.select("doc_id", "split_idx", F.length("content").cast("long").alias("chunk_len"), F.md5("content").alias("chunk_md5"))


_ENDS_SQL = [f"length(regexp_extract(w, '{b}', 1))" for b in BOUNDARIES]
register("chunk_boundary", f"""
WITH RECURSIVE r AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, 0 AS stop, 0 AS step FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, start, stop, step FROM (
    SELECT doc_id, text, n, start, CASE WHEN start + {BOUNDARY_CAPACITY} >= n THEN n
             {" ".join(f"WHEN {e} > {BOUNDARY_CAPACITY // LEAST_PART} THEN start + {e}" for e in _ENDS_SQL)} ELSE start + {BOUNDARY_CAPACITY} END AS stop, step
    FROM (SELECT *, substring(text, start + 1, {BOUNDARY_CAPACITY}) AS w FROM (
      SELECT doc_id, text, n, step + 1 AS step, CASE WHEN step = 0 THEN 0 WHEN sp > 0 AND sp < stop - nxt THEN nxt + sp ELSE nxt END AS start
      FROM (SELECT *, instr(substring(text, nxt + 1, stop - nxt), ' ') AS sp FROM (SELECT *, greatest(stop - {BOUNDARY_OVERLAP}, start + 1) AS nxt FROM r WHERE step = 0 OR stop < n))))))
SELECT doc_id, CAST(start AS BIGINT) AS split_idx, CAST(stop - start AS BIGINT) AS chunk_len, md5(substring(text, start + 1, stop - start)) AS chunk_md5 FROM r WHERE step > 0
""")(chunk_boundary)


# ------------------------------------------------------------------ SCH-12..SCH-14 (rows-only)
def lookup_fallback(spark, sf_dir):
    """Function lookups hit; ``Part<k>.size`` method lookups miss and fall back to BM25."""
    part = Tables(spark, sf_dir).part
    files = _files(spark, sf_dir)
    elems = _elements(files)
    disp = _displays(files, elems, numbered=True)
    plain = _displays(files, elems, numbered=False)
    rows = index_rows(plain)
    content = fixed_chunks(rows, "content").withColumn("id", F.xxhash64("instance_id", "filename", "elem_name", "elem_type",
                                                                        "display_level", "split_idx"))
    content = cut_lineage(content)
    idx = build_text_index(content).materialize()
    g = F.floor(F.col("p_partkey") / PARTS_PER_FILE)
    q = part.select(F.col("p_partkey").alias("query_id"),
                    F.concat(F.lit("repo"), F.floor(g / FILES_PER_INSTANCE).cast("string")).alias("instance_id"),
                    F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("method").alias("query_kind"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("fn_name"),
                    F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("class_name"),
                    F.lit("size").alias("method_name"), F.lit(None).cast("string").alias("filename"),
                    F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"),
                    F.lit(None).cast("string").alias("semantic"))
    r = lookup_with_fallback(q, disp, files, idx, content)
    return r.select("query_id", "source", "filename", "elem_type", "elem_name", F.length("text").cast("long").alias("text_len"))


register("lookup_fallback")(lookup_fallback)


# ------------------------------------------------------------------ SCH-12..SCH-16, SCH-19, JN-3: staged answers
#: Index rows that a task cuts into words at once.
ROWS_A_PART = 50_000


def staged_lookup(spark, sf_dir):
    """A query per part, of all five kinds, answered by name, by text or by vector, with the choices as tables.

    Exact files are kept except, for methods and classes, where ``p_partkey % 7 = 0``; found
    files are kept for methods, classes and semantic queries where ``p_partkey % 3 != 0``; in
    a found file the part's class and its first method are named, and ``p_partkey % 2`` is chosen.
    """
    part = Tables(spark, sf_dir).part
    files = _files(spark, sf_dir)
    elems = _elements(files)
    displays = _displays(files, elems, numbered=True, read=looked_up())
    rows = write_table(tag_rows(fixed_chunks(index_rows(_displays(files, elems, numbered=False, read=indexed())), "content")), "staged_rows")
    # rows move by id before they are cut into words: their postings and vectors stay where they are made
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_PART))
    index = build_text_index(rows.repartition(parts, "id")).materialize()
    pk, kind = F.col("p_partkey"), F.col("p_partkey") % 5
    null = lambda t: F.lit(None).cast(t)
    q = shuffled(lookup_queries(part).drop("query_kind", "semantic")).join(part.select(pk.alias("query_id"), "p_name"), "query_id")
    q = q.withColumn("_k", F.col("query_id") % 5).withColumn("query_kind", F.element_at(F.array(*map(F.lit, ("function", "method", "class", "file", "semantic"))), (F.col("_k") + 1).cast("int")))
    q = q.withColumn("semantic", F.when(F.col("_k") == 4, F.col("p_name"))).drop("_k", "p_name")
    own = lookup_queries(part).select("query_id", "filename", "class_name")
    exact_choice = own.where("query_id % 5 IN (0, 3) OR query_id % 7 != 0")
    text_choice = own.where("query_id % 5 IN (1, 2, 4) AND query_id % 3 != 0")
    item = lambda n, k, method: own.select("query_id", "filename", F.lit(n).alias("item"), F.lit(k).alias("query_kind"), null("string").alias("fn_name"), "class_name",
                                           method.alias("method_name"), null("long").alias("line_start"), null("long").alias("line_end"))
    extractions = item(0, "class", null("string")).unionByName(item(1, "method", F.lit("get")))
    result_choice = part.select(pk.alias("query_id"), (pk % 2).cast("long").alias("index"))
    vectors = write_table(shuffled(rows.drop("content").repartition(parts, "id")).join(embed_rows(rows.where(~F.col("exact_only")), "id", "content", EMBED_DIM, parts), "id"), "staged_vectors")
    semantic = q.where("query_kind = 'semantic'").select("query_id", "instance_id", "semantic")
    query_vectors = shuffled(semantic.select("query_id", "instance_id")).join(embed_rows(semantic, "query_id", "semantic", EMBED_DIM).withColumnRenamed("embedding", "qvec"), "query_id")
    r = staged_answers(q, displays, files, index, rows, vectors, query_vectors, exact_choice, text_choice, extractions, result_choice)
    return r.select("query_id", "source", "n_results", "result_idx", "filename", "elem_type", "elem_name", F.md5("text").alias("text_md5"))


register("staged_lookup", f"""
WITH {_PARTS_SQL},
{_LN_SQL},
x AS (
  SELECT pb.*, part.p_brand, f.m, {HEADER} + {BLOCK} * f.m AS lines, CAST(length(CAST({HEADER} + {BLOCK} * f.m AS VARCHAR)) AS INTEGER) AS w, replace(pb.p_name, ' ', '_') AS fn, 'Part' || CAST(p_partkey AS VARCHAR) AS cls,
         max(base) OVER (PARTITION BY pb.g, pb.p_name) AS fbase, CAST(p_partkey % 5 AS INTEGER) AS kind, CASE WHEN pb.p_size % 2 = 0 THEN 'get' ELSE 'put' END AS method,
         greatest(0, pb.p_size % 30 - 10) AS lo, least({HEADER} + {BLOCK} * f.m, CASE WHEN pb.p_size % 3 = 0 THEN {HEADER} + {BLOCK} * f.m ELSE pb.p_size % 30 + 5 END + 10) AS hi
  FROM pb JOIN part USING (p_partkey) JOIN f USING (g) WHERE NOT broken),
rng AS (SELECT p_partkey, string_agg(lpad(CAST(ln.n + 1 AS VARCHAR), w, ' ') || ' |' || ln.t, chr(10) ORDER BY ln.n) || chr(10) AS t
        FROM x JOIN ln ON ln.g = x.g AND ln.n >= lo AND ln.n < hi WHERE kind = 3 GROUP BY p_partkey),
e AS (SELECT *, kind IN (0, 3) OR (p_partkey % 7 != 0 AND (kind = 2 OR kind = 1 AND (method = 'get' OR p_size % 7 != 0))) AS by_name FROM x),
a AS (
  SELECT p_partkey, 'exact' AS source, 1 AS n, 0 AS idx, filename, ['function', 'method', 'class', 'file'][kind + 1] AS elem_type,
         CASE kind WHEN 0 THEN fn WHEN 1 THEN method WHEN 2 THEN cls ELSE filename END AS elem_name,
         CASE kind WHEN 0 THEN {_FN_TEXT} WHEN 1 THEN CASE WHEN method = 'get' THEN {_GET_TEXT} ELSE {_PUT_TEXT} END WHEN 2 THEN {_CLASS_TEXT}
              ELSE (SELECT rng.t FROM rng WHERE rng.p_partkey = e.p_partkey) END AS text
  FROM e WHERE by_name
  UNION ALL
  SELECT p_partkey, CASE WHEN kind = 4 THEN 'semantic' ELSE 'text' END, 2, p_partkey % 2, filename, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'method' END,
         CASE WHEN p_partkey % 2 = 0 THEN cls ELSE 'get' END, CASE WHEN p_partkey % 2 = 0 THEN {_CLASS_TEXT} ELSE {_GET_TEXT} END
  FROM e WHERE NOT by_name AND kind IN (1, 2, 4) AND p_partkey % 3 != 0)
SELECT p_partkey AS query_id, source, CAST(n AS BIGINT) AS n_results, CAST(idx AS BIGINT) AS result_idx, filename, elem_type, elem_name, md5(text) AS text_md5 FROM a
""")(staged_lookup)


# ------------------------------------------------------------------ AGG-10, SNK-6
def file_kind_counts(spark, sf_dir):
    """Files of each instance that parse and that do not."""
    return element_counts(extract_elements(_files(spark, sf_dir))).select("instance_id", "kind", "n")


register("file_kind_counts", f"""
WITH {_PARTS_SQL}
SELECT instance_id, CASE WHEN broken THEN 'raw' ELSE 'module' END AS kind, count(DISTINCT filename) AS n FROM pb GROUP BY ALL
""")(file_kind_counts)


def instance_texts(spark, sf_dir):
    """Texts written to a folder per instance, and the lines and characters read back from it."""
    path = new_version_path(spark, "instance-texts")
    write_text_per_instance(Tables(spark, sf_dir).documents.select(F.col("source").alias("instance_id"), "text"), path)
    back = spark.read.option("lineSep", "\n").text(path)
    return back.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).cast("long").alias("n_chars"))


register("instance_texts", """
SELECT source AS instance_id, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines,
       CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS n_chars
FROM documents GROUP BY source
""")(instance_texts)


# ------------------------------------------------------------------ streaming incremental build
def stream_index_build(spark, sf_dir):
    """documents read as a file stream (availableNow) into the shard-partitioned index."""
    schema = Tables(spark, sf_dir).documents.schema
    index_path = new_version_path(spark, "stream-index")
    ckpt = new_version_path(spark, "stream-ckpt")
    # as a pattern the path stands for a single file and for a folder of part files alike
    path = table_path(sf_dir, "documents")
    q = start_index_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, lambda b: _index_rows_for(b, 4096), index_path, ckpt)
    q.awaitTermination()
    out = spark.read.parquet(index_path)
    return out.groupBy("instance_id").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


register("stream_index_build", f"""
SELECT source || '/' || lang AS instance_id, CAST(sum({_chunk_count_sql(4096)}) AS BIGINT) AS n_rows
FROM documents WHERE length(text) > 0 GROUP BY 1
""")(stream_index_build)
