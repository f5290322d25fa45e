"""Tagged-reply parsing as Column expressions (RSP-1..RSP-4).

A reply holds blocks ``<tag attrs>content</tag>``.  The rules:

* the opening tag is found by **prefix** (``<patch`` also finds ``<patch0``);
  the block ends at the first ``</tag>`` after the opening tag's ``>``;
  a missing opening or closing tag gives NULL (RSP-1);
* one leading and one trailing newline are stripped, then code fences are
  removed in a fixed order (RSP-2);
* ``a=1 b=x`` attributes become a map; parts without ``=`` are ignored, a
  value stops at its second ``=``, a repeated key keeps the last (RSP-3);
* numbered blocks ``tag0, tag1, ...`` are read until the first missing one
  (RSP-4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fence replacements, applied in this order, then "```" removed.
# (The first entry is one literal string, as in the reference; it only
# matches that exact text.)
FENCE_REPLACEMENTS = ["```json, ```diff, ```py", "```md", "```\n", "\n```"]
FENCE = "```"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _strip_one_newline(b: Column) -> Column:
    b = F.when(b.startswith("\n"), F.substring(b, 2, 1 << 30)).otherwise(b)
    return F.when(b.endswith("\n"), F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b)


def remove_fences(block: Column, lang: str | None) -> Column:
    reps = ([FENCE + lang] if lang else []) + FENCE_REPLACEMENTS
    for r in reps:
        block = F.replace(block, F.lit(r), F.lit(FENCE))
    return F.replace(block, F.lit(FENCE), F.lit(""))


def block_bounds(reply: Column, tag) -> dict:
    """Positions (1-based) of the parts of the first ``<tag`` block."""
    tag = _lit(tag)
    start_tag = F.concat(F.lit("<"), tag)
    end_tag = F.concat(F.lit("</"), tag, F.lit(">"))
    start = F.position(start_tag, reply)
    end_any = F.position(end_tag, reply)
    attrs_start = start + F.length(start_tag)
    attrs_end = F.position(F.lit(">"), reply, attrs_start)
    body_start = attrs_end + 1
    body_end = F.position(end_tag, reply, body_start)
    return dict(start=start, end_any=end_any, attrs_start=attrs_start, attrs_end=attrs_end,
                body_start=body_start, body_end=body_end)


def parse_block(reply: Column, tag, lang: str | None = None) -> Column:
    """``struct<content string, attrs map<string,string>>`` or NULL (RSP-1..RSP-3)."""
    b = block_bounds(reply, tag)
    found = (b["start"] > 0) & (b["end_any"] > 0) & (b["attrs_end"] > 0)
    body_len = F.when(b["body_end"] > 0, b["body_end"] - b["body_start"]).otherwise(F.length(reply) - b["body_start"])
    body = F.substring(reply, b["body_start"], body_len)
    content = remove_fences(_strip_one_newline(body), lang)
    attrs = parse_attrs(F.substring(reply, b["attrs_start"], b["attrs_end"] - b["attrs_start"]))
    return F.when(found, F.struct(content.alias("content"), attrs.alias("attrs")))


def parse_attrs(s: Column) -> Column:
    """``a=1 b=x`` -> map; parts without ``=`` dropped; last duplicate wins (RSP-3)."""
    parts = F.filter(F.split(s, " "), lambda p: p.contains("="))
    kv = F.transform(parts, lambda p: F.struct(F.get(F.split(p, "="), 0).alias("k"), F.get(F.split(p, "="), 1).alias("v")))
    n = F.size(kv)
    keep = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(keep)


def numbered_blocks(reply: Column, tag: str, lang: str | None = None) -> Column:
    """``array<struct<content, attrs>>`` of ``tag0, tag1, ...`` up to the first missing one (RSP-4).

    The candidate numbers are ``0 .. count('<tag')``: a block cannot exist
    beyond the number of opening tags.  Positions are found in stages
    (one ``transform`` per dependent search), so each substring search runs
    once per candidate instead of once per use inside the lambda.
    """
    n_open = F.size(F.split(reply, F.lit("<" + tag))) - 1
    nums = F.sequence(F.lit(0), F.greatest(n_open, F.lit(0)))
    s1 = F.transform(nums, lambda i: F.struct(
        F.concat(F.lit(tag), i.cast("string")).alias("t")))
    s2 = F.transform(s1, lambda x: F.struct(
        x["t"].alias("t"),
        F.position(F.concat(F.lit("<"), x["t"]), reply).alias("s"),
        F.position(F.concat(F.lit("</"), x["t"], F.lit(">")), reply).alias("e")))
    s3 = F.transform(s2, lambda x: F.struct(
        x["t"].alias("t"), x["s"].alias("s"), x["e"].alias("e"),
        (x["s"] + F.length(x["t"]) + 1).alias("as"),
        F.position(F.lit(">"), reply, x["s"] + F.length(x["t"]) + 1).alias("ae")))
    s4 = F.transform(s3, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["as"].alias("as"), x["ae"].alias("ae"),
        F.position(F.concat(F.lit("</"), x["t"], F.lit(">")), reply, x["ae"] + 1).alias("be")))
    s5 = F.transform(s4, lambda x: F.struct(
        ((x["s"] > 0) & (x["e"] > 0) & (x["ae"] > 0)).alias("found"),
        F.substring(reply, x["as"], x["ae"] - x["as"]).alias("attrs_text"),
        F.substring(reply, x["ae"] + 1,
                    F.when(x["be"] > 0, x["be"] - x["ae"] - 1).otherwise(F.length(reply) - x["ae"] - 1)).alias("body")))
    s6 = F.transform(s5, lambda x: F.struct(
        x["found"].alias("found"), x["attrs_text"].alias("attrs_text"), _strip_one_newline(x["body"]).alias("body")))
    return F.transform(s6, lambda x: F.when(x["found"], F.struct(
        remove_fences(x["body"], lang).alias("content"), parse_attrs(x["attrs_text"]).alias("attrs"))))


def take_until_null(arr: Column) -> Column:
    """Prefix of ``arr`` before its first NULL element."""
    first_null = F.array_position(F.transform(arr, lambda x: x.isNull()), True)
    return F.when(first_null == 0, arr).otherwise(F.slice(arr, 1, F.greatest(first_null - 1, F.lit(0))))
