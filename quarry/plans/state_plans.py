"""Queries: replies, JSON payloads, keyed cache, rules, offsets, line ranges, dirs, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.cache import cache_get, cache_put, to_json_value
from quarry.operators.chunking import chunk_offsets
from quarry.operators.render import lookup_range, range_text, offsets_to_lines, FILE_RANGE_LIMIT, line_width
from quarry.operators.replies import parse_payloads, parse_query_payload, parse_replies
from quarry.plans import register
from quarry.plans.fixtures import CAP, STEP, chunk_offsets_sql, doc_filename
from quarry.plans.text_plans import parse_indices
from quarry.sources.files import list_dirs
from quarry.sources.instances import allow_list, select_split
from quarry.sources.rules import rule_matches, rules_from_rows
from quarry.sources.tables import Tables


# ------------------------------------------------------------------ RSP-1..RSP-4
def render_replies(conversations: DataFrame) -> DataFrame:
    """One reply per conversation: a reason block, then its assistant turns as numbered patch blocks.

    Numbering by ``conv_id % 3``: 0 -> from 0; 1 -> from 1 (no ``patch0``, so
    nothing numbered is read); 2 -> number 1 skipped (a gap after ``patch0``).
    """
    a = conversations.where(F.col("role") == "assistant")
    g = a.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    m = F.col("conv_id") % 3

    def num(k):
        return F.when(m == 0, k).when(m == 1, k + 1).otherwise(F.when(k < 1, k).otherwise(k + 1))

    blocks = F.transform("_t", lambda x, k: F.concat(
        F.lit("<patch"), num(k).cast("string"), F.lit(" a="), x["turn"].cast("string"), F.lit(">\n```diff\n"),
        x["text"], F.lit("\n```\n</patch"), num(k).cast("string"), F.lit(">")))
    reply = F.concat(F.lit("<reason>\n```md\nconversation "), F.col("conv_id").cast("string"), F.lit("\n```\n</reason>\n"),
                     F.array_join(blocks, "\n"))
    return g.select(F.col("conv_id").alias("reply_id"), reply.alias("response"))


def reply_blocks(spark, sf_dir):
    rep = render_replies(Tables(spark, sf_dir).conversations)
    b = parse_replies(rep)
    return b.select(F.col("reply_id").alias("conv_id"), "tag", "block_no", F.md5("content").alias("content_md5"),
                    F.col("attrs")["a"].alias("attr_a"))


register("reply_blocks", """
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k
           FROM conversations WHERE role = 'assistant')
SELECT DISTINCT conv_id, 'reason' AS tag, CAST(-1 AS BIGINT) AS block_no, md5('conversation ' || CAST(conv_id AS VARCHAR)) AS content_md5,
       CAST(NULL AS VARCHAR) AS attr_a FROM a
UNION ALL
SELECT conv_id, 'patch', CAST(k AS BIGINT), md5(text), CAST(turn AS VARCHAR) FROM a
WHERE conv_id % 3 = 0 OR (conv_id % 3 = 2 AND k = 0)
""")(reply_blocks)


# ------------------------------------------------------------------ RSP-5 / SCH-13 / SCH-21
PARTS_PER_REPLY = 5


def render_query_replies(part: DataFrame) -> DataFrame:
    """A ``<queries>`` JSON reply per 5 parts; the query kind cycles with ``p_size % 5``."""
    kind = F.col("p_size") % 5
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    cls = F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    q = (F.when(kind == 0, F.create_map(F.lit("fn_name"), name))
         .when(kind == 1, F.create_map(F.lit("class_name"), cls, F.lit("method_name"), F.lower("p_type")))
         .when(kind == 2, F.create_map(F.lit("class_name"), cls))
         .when(kind == 3, F.create_map(F.lit("filename"), F.concat(F.lit("pkg/"), F.lower("p_type"), F.lit(".py")),
                                       F.lit("line_start"), F.col("p_size").cast("string"),
                                       F.lit("line_end"), (F.col("p_size") + 10).cast("string")))
         .otherwise(F.create_map(F.lit("semantic"), F.col("p_name"))))
    item = F.to_json(F.struct(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("reasoning"), q.alias("query")))
    g = part.select(F.floor(F.col("p_partkey") / PARTS_PER_REPLY).cast("long").alias("reply_id"), "p_partkey", item.alias("item"))
    r = g.groupBy("reply_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "item"))).alias("_l"))
    js = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["item"]), ", "), F.lit("]"))
    return r.select("reply_id", F.concat(F.lit("Sure.\n<queries>\n```json\n"), js, F.lit("\n```\n</queries>")).alias("response"))


def reply_json(spark, sf_dir):
    rep = render_query_replies(Tables(spark, sf_dir).part)
    b = parse_replies(rep, code_tag="queries", code_lang="json").where((F.col("tag") == "queries") & (F.col("block_no") == -1))
    return parse_query_payload(b)


register("reply_json", f"""
SELECT CAST(floor(p_partkey / {PARTS_PER_REPLY}) AS BIGINT) AS reply_id,
       CAST(row_number() OVER (PARTITION BY floor(p_partkey / {PARTS_PER_REPLY}) ORDER BY p_partkey) - 1 AS BIGINT) AS query_idx,
       'part ' || CAST(p_partkey AS VARCHAR) AS reasoning,
       CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'file' ELSE 'semantic' END AS query_kind,
       CASE WHEN p_size % 5 = 0 THEN replace(p_name, ' ', '_') END AS fn_name,
       CASE WHEN p_size % 5 IN (1, 2) THEN replace(p_brand, '#', '_') END AS class_name,
       CASE WHEN p_size % 5 = 1 THEN lower(p_type) END AS method_name,
       CASE WHEN p_size % 5 = 3 THEN 'pkg/' || lower(p_type) || '.py' END AS filename,
       CAST(CASE WHEN p_size % 5 = 3 THEN p_size END AS BIGINT) AS line_start,
       CAST(CASE WHEN p_size % 5 = 3 THEN p_size + 10 END AS BIGINT) AS line_end,
       CASE WHEN p_size % 5 = 4 THEN p_name END AS semantic
FROM part
""")(reply_json)


def render_payloads(part: DataFrame) -> DataFrame:
    """A JSON payload per part: the nine shapes by ``p_partkey % 11``, and one that breaks off."""
    c, k = F.col, F.col("p_partkey") % 11
    js = lambda **f: F.struct(*[v.alias(n) for n, v in f.items()])
    both = F.array(c("p_name"), c("p_brand"))
    queries = F.concat(F.lit("["), F.to_json(js(reasoning=c("p_type"), query=js(fn_name=c("p_name")))), F.lit(", "),
                       F.to_json(js(reasoning=c("p_type"), query=js(filename=c("p_brand"), line_start=c("p_size"), line_end=F.lit(-1)))), F.lit("]"))
    selection = F.concat(F.lit("["), F.to_json(js(reasoning=c("p_type"), index=c("p_size"))), F.lit(","), F.to_json(js(index=F.lit("x"), reasoning=c("p_type"))), F.lit("]"))
    texts = [queries, F.to_json(both), F.to_json(js(index=c("p_size"))), F.to_json(js(index=F.array(c("p_size"), F.lit(0)))),
             F.to_json(F.array(js(reasoning=c("p_type"), extract=js(class_name=c("p_brand"), method_name=c("p_name"))))), selection,
             F.to_json(F.array(js(reason=c("p_type"), query_type=F.lit("docs"), query=c("p_name")))),
             F.when(c("p_size") % 2 == 0, F.to_json(js(indices=c("p_size")))).otherwise(F.to_json(js(indices=F.array(c("p_size"), F.lit(1))))),
             F.to_json(js(relevant=both)),
             F.to_json(js(reasoning=c("p_type"), category=F.lit("function"), fn_name=c("p_name"), generic_lines=F.array(c("p_size")))),
             F.concat(F.lit('[{"reasoning": "'), c("p_name"))]
    content = F.when(k == 0, texts[0])
    for n, t in enumerate(texts[1:], 1):
        content = content.when(k == n, t)
    return part.select(F.col("p_partkey").alias("reply_id"), F.concat(F.lit("\n"), content, F.lit("\n")).alias("content"))


def reply_payloads(spark, sf_dir):
    r = parse_payloads(render_payloads(Tables(spark, sf_dir).part))
    return r.select("reply_id", "item_idx", "shape", F.trim(F.regexp_replace("reasoning", "\n", "")).alias("reasoning"), "query_kind", "fn_name", "class_name", "method_name", "filename",
                    "semantic", "query_type", "query", "category", "line_start", "line_end", F.array_join("numbers", ",").alias("numbers"), F.array_join("texts", ",").alias("texts"))


def _payload_sql(kind: int, idx: int, shape: str, reasoning: str = "p_type", where: str = "TRUE", **fields: str) -> str:
    text = lambda f: f"CAST({fields.get(f, 'NULL')} AS VARCHAR) AS {f}"
    num = lambda f: f"CAST({fields.get(f, 'NULL')} AS BIGINT) AS {f}"
    names = ["query_kind", "fn_name", "class_name", "method_name", "filename", "semantic", "query_type", "query", "category", "numbers", "texts"]
    return (f"SELECT p_partkey AS reply_id, CAST({idx} AS BIGINT) AS item_idx, '{shape}' AS shape, {reasoning} AS reasoning, {', '.join(map(text, names))}, "
            f"{num('line_start')}, {num('line_end')} FROM part WHERE p_partkey % 11 = {kind} AND {where}")


register("reply_payloads", "\nUNION ALL\n".join([
    _payload_sql(0, 0, "queries", query_kind="'function'", fn_name="p_name"),
    _payload_sql(0, 1, "queries", query_kind="'file'", filename="p_brand", line_start="p_size", line_end="-1"),
    _payload_sql(1, 0, "files", "NULL", texts="p_name"), _payload_sql(1, 1, "files", "NULL", texts="p_brand"),
    _payload_sql(2, 0, "result", "NULL", numbers="p_size"), _payload_sql(3, 0, "result", "NULL", numbers="CAST(p_size AS VARCHAR) || ',0'"),
    _payload_sql(4, 0, "extractions", query_kind="'method'", class_name="p_brand", method_name="p_name"),
    _payload_sql(5, 0, "selection", numbers="p_size"), _payload_sql(5, 1, "corrupt", """'{"index":"x","reasoning":"' || p_type || '"}'"""),
    _payload_sql(6, 0, "web_queries", query_type="'docs'", query="p_name"),
    _payload_sql(7, 0, "indices", "NULL", numbers="CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || ',1' END"),
    _payload_sql(8, 0, "relevant", "NULL", texts="p_name || ',' || p_brand"),
    _payload_sql(9, 0, "located", category="'function'", fn_name="p_name", numbers="p_size"),
    _payload_sql(10, 0, "corrupt", """'[{"reasoning": "' || p_name"""),
]))(reply_payloads)


# ------------------------------------------------------------------ KV-1..KV-3
def _event_cache_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("prompt"),
                         to_json_value(F.col("value")).alias("value"), F.col("event_id").alias("seq"))


def _value_v(col):
    return F.get_json_object(col, "$.v").cast("double")


def cache_upsert(spark, sf_dir):
    c = cache_put(None, _event_cache_rows(Tables(spark, sf_dir).events))
    return c.select("key", "prompt", _value_v(F.col("value")).alias("value_v"), "seq")


register("cache_upsert", """
SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS prompt, arg_max(value, event_id) AS value_v,
       max(event_id) AS seq
FROM events GROUP BY user_id
""")(cache_upsert)


def cache_lookup(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    cache = cache_put(None, _event_cache_rows(ev))
    req = ev.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("prompt")).distinct()
    got = cache_get(req, cache)
    return got.select("key", "prompt", F.col("hit").cast("long").alias("hit"), _value_v(F.col("value")).alias("value_v"))


register("cache_lookup", """
WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS prompt, arg_max(value, event_id) AS v
           FROM events GROUP BY user_id),
r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type AS prompt FROM events)
SELECT r.key, r.prompt, CAST(c.key IS NOT NULL AS BIGINT) AS hit, c.v AS value_v
FROM r LEFT JOIN c ON r.key = c.key AND r.prompt = c.prompt
""")(cache_lookup)


# ------------------------------------------------------------------ JN-5 / AGG-8 / SRC-10
# Five literal rules: one disabled, one with NULL ``enabled`` (= enabled).
RULES = [
    (0, r"^src1", True, "rule one"),
    (1, r"tests/", False, "rule two"),
    (2, r"/fr/", None, "rule three"),
    (3, r"\.py$", True, "rule four"),
    (4, r"doc_[0-9]*7\.", True, "rule five"),
]


def rule_matches_q(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    terms = docs.select("doc_id", doc_filename().alias("term"))
    return rule_matches(terms, rules_from_rows(spark, RULES)).select("doc_id", "term", "matches", "n_matches")


def _rules_sql():
    en = [r for r in RULES if r[2] is not False]
    arr = ", ".join(f"CASE WHEN regexp_matches(term, '{m}') THEN '{c}' END" for _, m, _, c in en)
    return f"""
WITH t AS (
  SELECT doc_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
         || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS term FROM documents),
m AS (SELECT doc_id, term, list_filter([{arr}], lambda x: x IS NOT NULL) AS l FROM t)
SELECT doc_id, term, array_to_string(l, chr(10) || '---' || chr(10)) AS matches, CAST(len(l) AS BIGINT) AS n_matches FROM m
"""


register("rule_matches", _rules_sql())(rule_matches_q)


def rule_matches_many(spark, sf_dir):
    """Document names against a rule per customer and two rules without a needed literal."""
    t = Tables(spark, sf_dir)
    own = t.customer.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("(?i)/DOC_"), F.col("c_custkey").cast("string"), F.lit("[.](py|md)$")).alias("match"),
                            (F.col("c_custkey") % 10 != 0).alias("enabled"), F.col("c_name").alias("content"))
    free = rules_from_rows(spark, [(-1, "[0-9]7[.]", None, "ends with 7"), (-2, "^.*$", True, "any"), (-3, ".", False, "off")])
    terms = t.documents.select("doc_id", doc_filename().alias("term"))
    return rule_matches(terms, own.unionByName(free)).select("doc_id", "term", "matches", "n_matches")


register("rule_matches_many", """
WITH t AS (
  SELECT doc_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || lang || '/doc_' || CAST(doc_id AS VARCHAR)
         || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.txt' END AS term FROM documents),
m AS (
  SELECT doc_id, -2 AS ord, 'any' AS content FROM t
  UNION ALL SELECT doc_id, -1, 'ends with 7' FROM t WHERE doc_id % 10 = 7 AND doc_id > 9
  UNION ALL SELECT doc_id, c_custkey, c_name FROM t JOIN customer ON c_custkey = doc_id WHERE doc_id % 3 != 2 AND c_custkey % 10 != 0)
SELECT t.doc_id, t.term, string_agg(content, chr(10) || '---' || chr(10) ORDER BY ord) AS matches, CAST(count(*) AS BIGINT) AS n_matches
FROM t JOIN m USING (doc_id) GROUP BY t.doc_id, t.term
""")(rule_matches_many)


# ------------------------------------------------------------------ TXT-8
def offset_to_line(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    offs = docs.where(F.length("text") > 0).select(
        "id", F.explode(chunk_offsets(F.length("text"), CAP, CAP - STEP)).alias("offset"))
    r = offsets_to_lines(docs, offs, "id", "text", "offset")
    return r.select(F.col("id").alias("doc_id"), "offset", F.col("line_idx").cast("long").alias("line_idx"))


register("offset_to_line", f"""
WITH sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM sp),
cum AS (SELECT doc_id, pos, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ln),
offs AS (SELECT doc_id, unnest({chunk_offsets_sql('length(text)')}) AS off FROM documents WHERE length(text) > 0)
SELECT o.doc_id, CAST(o.off AS BIGINT) AS "offset", CAST(min(c.pos) AS BIGINT) AS line_idx
FROM offs o LEFT JOIN cum c ON c.doc_id = o.doc_id AND c.c >= o.off
GROUP BY o.doc_id, o.off
""")(offset_to_line)


# ------------------------------------------------------------------ JN-6 / SCH-11 / PRM-1
def line_range_context(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    ls = (F.col("doc_id") % 13 + 1)
    le = F.when(F.col("doc_id") % 9 == 0, F.lit(-1)).otherwise(ls + F.col("doc_id") % 5)
    x = d.select("doc_id", F.split("text", "\n").alias("lines"), ls.alias("ls"), le.alias("le"))
    lo, hi = lookup_range(F.col("lines"), F.col("ls"), F.col("le"))
    x = x.select("doc_id", "lines", lo.alias("lo"), hi.alias("hi"))
    t = range_text(F.col("lines"), F.col("lo"), F.col("hi"), line_width(F.col("lines")))
    x = x.select("doc_id", (F.col("lo") + 1).cast("long").alias("first_line"),
                 F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("long").alias("n_shown"), t.alias("t"))
    over = F.length("t") > FILE_RANGE_LIMIT
    return x.select("doc_id", "first_line", "n_shown", F.length("t").cast("long").alias("text_len"),
                    F.when(~over, F.md5("t")).alias("text_md5"), over.cast("long").alias("fallback"))


register("line_range_context", f"""
WITH q AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 13 + 1 AS ls,
         CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 13 + 1 + doc_id % 5 END AS le FROM documents),
r AS (SELECT doc_id, lines, len(lines) AS n, greatest(0, ls - 10) AS lo,
             least(len(lines), (CASE WHEN le = -1 THEN len(lines) ELSE le END) + 10) AS hi FROM q),
t AS (SELECT doc_id, lo, hi, array_to_string(list_transform(list_slice(lines, lo + 1, hi), lambda x, i:
        (CASE WHEN length(CAST(lo + i AS VARCHAR)) >= length(CAST(n AS VARCHAR)) THEN CAST(lo + i AS VARCHAR)
              ELSE lpad(CAST(lo + i AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), ' ') END) || ' |' || x), chr(10)) || chr(10) AS t FROM r)
SELECT doc_id, CAST(lo + 1 AS BIGINT) AS first_line, CAST(greatest(hi - lo, 0) AS BIGINT) AS n_shown,
       CAST(length(t) AS BIGINT) AS text_len, CASE WHEN length(t) > {FILE_RANGE_LIMIT} THEN NULL ELSE md5(t) END AS text_md5,
       CAST(length(t) > {FILE_RANGE_LIMIT} AS BIGINT) AS fallback
FROM t
""")(line_range_context)


# ------------------------------------------------------------------ SRC-7 / SRC-8
def render_paths(documents: DataFrame) -> DataFrame:
    """Relative file paths per instance (source); the layout cycles with ``doc_id % 6``."""
    m = F.col("doc_id") % 6
    d = (F.when(m == 0, "pkg/core").when(m == 1, "pkg/venv/lib").when(m == 2, "docs")
         .when(m == 3, "__pycache__").when(m == 4, "pkg/node_modules_x/a").otherwise("tests/unit"))
    return documents.select(F.col("source").alias("instance_id"),
                            F.concat(d, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"))


def dir_listing(spark, sf_dir):
    return list_dirs(render_paths(Tables(spark, sf_dir).documents)).select("instance_id", "dir", "depth")


register("dir_listing", """
WITH k AS (SELECT DISTINCT source AS instance_id, doc_id % 6 AS m FROM documents),
d AS (SELECT instance_id, unnest(CASE m WHEN 0 THEN ['pkg', 'pkg/core'] WHEN 1 THEN ['pkg', 'pkg/venv'] WHEN 2 THEN ['docs']
                                       WHEN 3 THEN [] WHEN 4 THEN ['pkg', 'pkg/node_modules_x'] ELSE ['tests', 'tests/unit'] END) AS dir FROM k)
SELECT DISTINCT instance_id, dir, CAST(length(dir) - length(replace(dir, '/', '')) AS BIGINT) AS depth FROM d
""")(dir_listing)


# ------------------------------------------------------------------ SRC-1 / SRC-3 / SRC-4
def orders_as_instances(orders: DataFrame) -> DataFrame:
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "test").otherwise("dev")
    return orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("instance_id"),
                         F.concat(F.lit("cust/c"), F.col("o_custkey").cast("string")).alias("repo"),
                         split.alias("split"), "o_custkey")


def instance_select(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inst = select_split(orders_as_instances(t.orders), "test")
    allowed = orders_as_instances(t.orders).join(
        t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return allow_list(inst, allowed).select("instance_id", "repo")


register("instance_select", """
SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS instance_id, 'cust/c' || CAST(o_custkey AS VARCHAR) AS repo
FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")(instance_select)


# ------------------------------------------------------------------ JN-7 / SCH-16 / RSP-6
RESULTS_PER_QUERY = 7


def pick_by_index(spark, sf_dir):
    """Best-of-results: 0 rows skip, 1 row taken, else the chosen index (a list gives its first)."""
    ev = Tables(spark, sf_dir).events
    r = ev.select(F.floor(F.col("event_id") / RESULTS_PER_QUERY).cast("long").alias("query_id"), "event_id", "props")
    w = Window.partitionBy("query_id").orderBy("event_id")
    r = r.withColumn("result_idx", (F.row_number().over(w) - 1).cast("long"))
    n = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("props", "event_id").alias("p0"))
    k = F.get_json_object("p0", "$.k").cast("long")
    payload = F.when(F.col("query_id") % 2 == 0, F.format_string('{"index": %d}', k % F.col("n"))) \
               .otherwise(F.format_string('{"index": [%d, 0]}', k % F.col("n")))
    from quarry.plans.text_plans import CHOICE_SCHEMA_INT, CHOICE_SCHEMA_LIST  # noqa: F401
    as_list = F.from_json(payload, "index array<int>")["index"]
    as_int = F.from_json(payload, "index int")["index"]
    chosen = F.coalesce(F.get(as_list, 0), as_int)
    pick = n.select("query_id", F.when(F.col("n") == 1, F.lit(0)).otherwise(chosen).cast("long").alias("result_idx"))
    return r.join(pick, ["query_id", "result_idx"]).select("query_id", "event_id", "result_idx")


register("pick_by_index", f"""
WITH r AS (SELECT CAST(floor(event_id / {RESULTS_PER_QUERY}) AS BIGINT) AS query_id, event_id, props,
                  row_number() OVER (PARTITION BY floor(event_id / {RESULTS_PER_QUERY}) ORDER BY event_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY floor(event_id / {RESULTS_PER_QUERY})) AS n FROM events),
c AS (SELECT query_id, CASE WHEN n = 1 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) % n END AS pick FROM r WHERE idx = 0)
SELECT r.query_id, r.event_id, CAST(r.idx AS BIGINT) AS result_idx FROM r JOIN c ON r.query_id = c.query_id AND r.idx = c.pick
""")(pick_by_index)
