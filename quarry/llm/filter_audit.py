"""How five filters interact: what each removes, repeats or alone would catch, in every order of application.

The failure conditions, with words as maximal runs of non-ASCII-white-space:

* A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * ``[A-Z]``
  characters > 3 * code points; D: any of ``#$%&*|``; each is a bit of the
  document's own text;
* E: an identical text belongs to a smaller doc_id anywhere in the table.  This is
  a left-semi self-join on the text's hash, the exact text and a smaller id.

The marks of E are united with the other failures and the bits of each document
are combined; all that follows works on the counts of bit combinations, at most
32 a part, not on documents.

For scale: the self-join's right side holds one row for each repeated text (its
smallest id; copies meet map-side first), and where the repeated hashes are proven
few, rows with other hashes are left out before any text is shuffled.  A text with
more than ``block`` copies is dealt over as many salts as it has blocks, so a hot
group of copies is no single task.  Ids, parts and bits are all that later steps carry.

Defined results: a null text counts as empty and a null lang as the part ``''``;
empty texts are identical to each other; a null doc_id has no labels, is smaller than none and has
none below it; rows that repeat a doc_id each count, and an equal id is not a smaller
one; a label row with quality 1 (toxic 1) marks its doc_id, however often it is
labelled; null labels mark nothing; texts may have any length; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, text_or_empty
from quarry.session import broadcast_if_small, write_table

FILTERS = "ABCDE"
#: Copies of one text in a task of the self-join.
BLOCK = 20_000
#: Repeated hashes (8 bytes each) that may be broadcast to leave out other rows early.
FEW_HASHES = 1_000_000


def _bits() -> F.Column:
    n = F.size("words")
    fails = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0)).cast("int")


def _base(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))


def identical_to_smaller(rows: DataFrame, hashes: DataFrame, block: int = BLOCK, few: int = FEW_HASHES) -> DataFrame:
    """``(id, part, h)`` of each of ``rows(id, part, text, h)`` whose text a smaller id has too.

    ``hashes(h)`` holds at least the hash of every row.
    """
    repeated = write_table(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "audit_repeated")
    if repeated.limit(few + 1).count() <= few:
        rows = rows.join(F.broadcast(repeated.select("h")), "h", "left_semi")
    hot = repeated.filter(F.col("n") > block).select("h", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    hot = broadcast_if_small(hot)
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("id", "part", F.spark_partition_id()), salts).cast("int")).drop("salts")
    first = rows.groupBy("h", "text").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    right = first.join(hot, "h", "left").select("h", "text", "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    same = F.expr("l.h = r.h AND l.salt = r.salt AND l.text = r.text AND r.least < l.id")
    return left.alias("l").join(right.alias("r"), same, "left_semi").select("id", "part", "h")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          block: int = BLOCK, few: int = FEW_HASHES) -> DataFrame:
    """One row per part, order of the five filters and step; see the module and :func:`steps`."""
    base = _base(docs, id_col, text_col, part_col)
    words = base.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    rows = write_table(words.select("id", "part", "h", _bits().alias("bits")), "audit_rows")
    marked = identical_to_smaller(base, rows.select("h"), block, few)
    failures = rows.withColumn("n", F.lit(1)).unionByName(marked.select("*", F.lit(1 << 4).alias("bits"), F.lit(0).alias("n")))
    verdicts = failures.groupBy("id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    by_id = verdicts.groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))  # a repeated id is few rows before it meets its labels
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    tally = by_id.join(marks, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return steps(tally)


def steps(tally: DataFrame) -> DataFrame:
    """``tally(part, bits, n, good, toxic)`` -> the counts of every step of every order, zeros included."""
    plan = [{"filter_order": "".join(order), "step": k + 1, "own": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in order[:k])}
            for order in itertools.permutations(FILTERS) for k, f in enumerate(order)]
    each = F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order:string,step:int,own:int,before:int>>"))
    bits, own, before = F.col("bits"), F.col("own"), F.col("before")
    fails, gone = bits.bitwiseAND(own) != 0, bits.bitwiseAND(before) != 0

    def count(where, what="n"):
        return F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")

    counted = tally.select("*", each.alias("s")).select("*", "s.*").groupBy("part", "filter_order", "step", "own").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(bits == own).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
