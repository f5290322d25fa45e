"""Reply tables: tagged blocks and JSON payloads as rows (RSP-1..RSP-6, SCH-13, SCH-21).

``parse_replies`` turns ``(reply_id, response)`` into one row per parsed
block: ``(reply_id, tag, block_no, content, attrs)`` with ``block_no = -1``
for the unnumbered block.  The loop of the reference (unnumbered block,
then ``0, 1, ...`` until a code block is missing; the reason block of the
stopping number is still read) becomes array expressions per row, so the
job is a projection plus one explode — no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.replies import numbered_blocks, parse_block, take_until_null

QUERY_ITEM = T.ArrayType(T.StructType([
    T.StructField("reasoning", T.StringType()),
    T.StructField("query", T.MapType(T.StringType(), T.StringType())),
]))


def parse_replies(replies: DataFrame, id_col: str = "reply_id", text_col: str = "response",
                  reason_tag: str = "reason", code_tag: str = "patch", code_lang: str | None = "diff") -> DataFrame:
    r = F.col(text_col)
    staged = replies.select(
        id_col,
        text_col,
        parse_block(r, reason_tag, "md").alias("_r0"),
        parse_block(r, code_tag, code_lang).alias("_c0"),
        numbered_blocks(r, code_tag, code_lang).alias("_cn"),
    )
    # materialise the numbered codes before slicing them (no re-evaluation)
    staged = staged.withColumn("_codes", take_until_null(F.col("_cn")))
    n_codes = F.size("_codes")
    reasons = F.transform(F.sequence(F.lit(0), n_codes),
                          lambda i: F.struct(i.alias("no"), parse_block(r, F.concat(F.lit(reason_tag), i.cast("string")), "md").alias("b")))
    codes = F.transform(F.col("_codes"), lambda b, i: F.struct(i.alias("no"), b.alias("b")))
    items = F.concat(
        F.array(F.struct(F.lit(reason_tag).alias("tag"), F.lit(-1).alias("no"), F.col("_r0").alias("b"))),
        F.array(F.struct(F.lit(code_tag).alias("tag"), F.lit(-1).alias("no"), F.col("_c0").alias("b"))),
        F.transform(reasons, lambda x: F.struct(F.lit(reason_tag).alias("tag"), x["no"].alias("no"), x["b"].alias("b"))),
        F.transform(codes, lambda x: F.struct(F.lit(code_tag).alias("tag"), x["no"].alias("no"), x["b"].alias("b"))),
    )
    out = staged.select(id_col, F.explode_outer(F.filter(items, lambda x: x["b"].isNotNull())).alias("_x"))
    return out.where(F.col("_x").isNotNull()).select(
        id_col, F.col("_x.tag").alias("tag"), F.col("_x.no").cast("long").alias("block_no"),
        F.col("_x.b.content").alias("content"), F.col("_x.b.attrs").alias("attrs"))


def query_kind(q: Column) -> Column:
    """Route a query map: semantic > function > method > class > file (SCH-13)."""
    has = lambda k: F.map_contains_key(q, k)
    return (F.when(has("semantic"), "semantic").when(has("fn_name"), "function")
            .when(has("class_name") & has("method_name"), "method").when(has("class_name"), "class")
            .when(has("filename"), "file").otherwise("unknown"))


def parse_query_payload(blocks: DataFrame, id_col: str = "reply_id") -> DataFrame:
    """``queries`` JSON payload -> one row per search query, numbered (RSP-5, SCH-21).

    A payload that is no JSON list of queries keeps one row of kind ``corrupt``
    (``query_idx`` NULL, the payload in ``reasoning``); an empty list has no rows.
    """
    arr = F.from_json(F.trim(F.col("content")), QUERY_ITEM)
    ex = blocks.select(id_col, "content", arr.alias("_a"))
    ex = ex.where(F.col("_a").isNull() | (F.size("_a") > 0)).select(id_col, "content", "_a", F.posexplode_outer("_a").alias("query_idx", "_q"))
    ex = ex.where(F.col("content").isNotNull())
    q = F.col("_q.query")
    corrupt = F.col("_a").isNull() | q.isNull()
    return ex.select(
        id_col, F.col("query_idx").cast("long").alias("query_idx"),
        F.when(F.col("_a").isNull(), F.col("content")).otherwise(F.col("_q.reasoning")).alias("reasoning"),
        F.when(corrupt, F.lit("corrupt")).otherwise(query_kind(q)).alias("query_kind"),
        q["fn_name"].alias("fn_name"), q["class_name"].alias("class_name"), q["method_name"].alias("method_name"),
        q["filename"].alias("filename"), q["line_start"].try_cast("long").alias("line_start"),
        q["line_end"].try_cast("long").alias("line_end"), q["semantic"].alias("semantic"))


#: Shapes of JSON payloads, in the order in which they are tried: (name, where, sign).  An
#: object of a list (``item``) or a whole payload (``whole``) is of the first shape whose sign it has.
SHAPES = [
    ("web_queries", "item", "query_type"), ("queries", "item", "query"), ("extractions", "item", "extract"), ("selection", "item", "index"),
    ("result", "whole", "index"), ("indices", "whole", "indices"), ("relevant", "whole", "relevant"), ("located", "whole", "category"),
]
TARGET_FIELDS = ["fn_name", "class_name", "method_name", "filename", "semantic", "query_type", "query", "category"]


def parse_payloads(blocks: DataFrame, id_col: str = "reply_id", content_col: str = "content") -> DataFrame:
    """JSON payloads of all nine shapes -> one row per item, in one pass over the parsed values (RSP-5).

    A list gives a row per element, an object one row; ``item_idx`` is the place in the
    list (0 for an object).  Columns: ``shape``, ``reasoning``, ``query_kind`` (of a
    query or extraction), the target's fields, ``numbers`` (a single number counts as a
    list of one) and ``texts``.  What is no JSON, an element of no known shape, and one
    whose numbers or texts are of another type come as rows of shape ``corrupt`` with their text in
    ``reasoning``; so does an object that names a key twice.  An empty list has no rows,
    a NULL payload has none either.
    """
    v = F.try_parse_json(F.col(content_col))
    listed = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    rows = blocks.where(F.col(content_col).isNotNull()).select(id_col, F.col(content_col).alias("_text"), v.alias("_v"))
    rows = rows.select(id_col, "_text", listed.isNotNull().alias("_list"), F.when(listed.isNotNull(), listed).otherwise(F.array("_v")).alias("_items"))
    rows = rows.select(id_col, "_text", "_list", F.posexplode("_items").alias("_at", "_i"))
    get = lambda path, kind: F.try_variant_get(F.col("_i"), path, kind)
    # one typed view of each item; the shape is read off the keys that it has
    rows = rows.select(id_col, "_text", "_list", "_at", "_i", get("$", "map<string,variant>").alias("_m"),
                       F.when(F.schema_of_variant("_i") == "STRING", get("$", "string")).alias("_string"))
    has = lambda key: F.coalesce(F.map_contains_key("_m", F.lit(key)), F.lit(False))
    shape = F.when(F.col("_list") & F.col("_string").isNotNull(), F.lit("files"))
    for name, where, sign in SHAPES:
        shape = shape.when((F.col("_list") == (where == "item")) & has(sign), F.lit(name))
    target = F.coalesce(get("$.query", "map<string,string>"), get("$.extract", "map<string,string>"), get("$", "map<string,string>"))
    number_path = {"selection": "$.index", "result": "$.index", "indices": "$.indices", "located": "$.generic_lines"}
    one, many = F.lit(None).cast("bigint"), F.lit(None).cast("array<bigint>")
    for name, path in number_path.items():
        here = F.col("shape") == name
        one = F.when(here, get(path, "bigint")).otherwise(one)
        many = F.when(here, get(path, "array<bigint>")).otherwise(many)
    rows = rows.withColumn("shape", shape)
    rows = rows.withColumn("_target", F.when(F.col("shape").isin("queries", "extractions", "web_queries", "located"), target))
    rows = rows.withColumn("numbers", F.coalesce(many, F.when(one.isNotNull(), F.array(one))))
    rows = rows.withColumn("texts", F.when(F.col("shape") == "files", F.array("_string")).when(F.col("shape") == "relevant", get("$.relevant", "array<string>")))
    holds = (F.col("shape").isNotNull()
             & ~(F.col("shape").isin("queries", "extractions") & get("$.query", "map<string,string>").isNull() & get("$.extract", "map<string,string>").isNull())
             & ~(F.col("shape").isin("selection", "result", "indices") & F.col("numbers").isNull())
             & ~((F.col("shape") == "relevant") & F.col("texts").isNull()))
    rows = rows.withColumn("_ok", F.coalesce(holds, F.lit(False)))
    t = F.when(F.col("_ok"), F.col("_target"))
    text = F.when(F.col("_i").isNull(), F.col("_text")).otherwise(F.to_json("_i"))
    return rows.select(
        id_col, F.col("_at").cast("long").alias("item_idx"), F.when(F.col("_ok"), F.col("shape")).otherwise(F.lit("corrupt")).alias("shape"),
        F.when(F.col("_ok"), F.coalesce(get("$.reasoning", "string"), get("$.reason", "string"))).otherwise(text).alias("reasoning"),
        F.when(F.col("_ok") & F.col("shape").isin("queries", "extractions"), query_kind(t)).alias("query_kind"),
        *[t[f].alias(f) for f in TARGET_FIELDS], t["line_start"].try_cast("long").alias("line_start"), t["line_end"].try_cast("long").alias("line_end"),
        F.when(F.col("_ok"), F.col("numbers")).alias("numbers"), F.when(F.col("_ok"), F.col("texts")).alias("texts"))
