"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets whole-text counts and four ratios (integers): characters a
word x 100, and per thousand the symbols a word, the repeated lines and the
words in repeated three-word windows.  For every ratio, language and source a
quantile sketch is kept: counts by value rounded down to five significant bits
(relative error 1/16 at most, the same whatever the order of rows or retries).
Sketches merge by adding counts, so sources merge into languages and languages
into the corpus; a group of fewer than ``min_rows`` documents takes the sketch
above it.  All limits come from these quantiles; no constant decides one:

* upper: the median, plus ``reach`` quarters of the distance to an upper quantile
  (90 % for characters a word and symbols, 99 % for repetition, which has a long
  tail in sound texts), plus one step of the sketch at that quantile;
* lower, for characters a word: the median less four times its distance to the
  10 % quantile, less one step of the sketch.

So a limit moves with each language and source, and less than a tenth of junk (for
repetition a hundredth) does not move it.  Documents beyond a limit fail, as do those
that the base rules reject; the base-rejected are left out of the sketches.

Nothing groups rows by a hot key without adding them up first: sketches are
partial counts, and the thresholds (a row per language and source) are broadcast
only below a checked number of rows.

Defined results: null text counts as empty (0 words, so rejected by the base
rules); null language or source are groups of their own; repeated rows count as
often as they occur and get the same verdict; a repeated window is found by
64-bit hashes within its document; texts may have any length; extra columns of any name pass
through ``keep_good``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small, write_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MIN_ROWS = 100
#: Ratio -> (upper quantile in per cent, quarters of its distance to the median, whether there is a lower limit)
RATIOS = {"chars_word": (90, 16, True), "symbols": (90, 16, False), "repeated_lines": (99, 5, False), "repeated_words": (99, 5, False)}
#: Times the distance from the median to the 10 % quantile that a lower limit lies below the median.
REACH_BELOW = 4
#: Significant bits of a sketch's keys.
BITS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACES = "\t\n\x0b\x0c\r"


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """Adds the struct ``m`` of counts and ratios; a few projections, one pass over the text, no shuffle."""
    blank = lambda c: F.translate(c, _SPACES, "     ")
    d = df.withColumn("t", F.coalesce(text, F.lit("")))
    d = d.withColumn("w", F.filter(F.split(blank(F.col("t")), " "), lambda x: x != ""))
    d = d.withColumn("n", F.size("w"))
    d = d.withColumn("g", F.when(F.col("n") >= 4, F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    # most texts repeat no window: only the others are sorted
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, k: same(x, F.get("s", k - 1)) | same(x, F.get("s", k + 1))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(blank(x)) != ""))
    n = F.col("n").cast("long")
    m = F.struct(
        n.alias("n_words"),
        F.length(F.translate(F.col("t"), " " + _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate(F.col("t"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"))
    return d.withColumn("m", m).drop("t", "w", "n", "g", "s", "p", "lines")


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def _ratio(name: str) -> Column:
    """The ratio's integer value; 0 for a text without words."""
    over = {"chars_word": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000),
            "repeated_lines": ("n_dup_lines", "n_lines", 1000), "repeated_words": ("n_repeat_words", "n_words", 1000)}
    a, b, scale = over[name]
    return F.coalesce(F.expr(f"(m.{a} * {scale}) div nullif(m.{b}, 0)"), F.lit(0).cast("long"))


def _step(v: Column) -> Column:
    """Width of the sketch's cell that holds ``v``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(v)) - BITS, F.lit(0)))


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, ratio, key, n)``: each group's counts by rounded value."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("v")) for r in RATIOS]))
    v = measured.filter(~base_failed()).select("lang", "source", values.alias("x")).select("lang", "source", "x.ratio", "x.v")
    key = F.col("v") - F.pmod(F.col("v"), _step(F.col("v")))
    return v.groupBy("lang", "source", "ratio", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, level: list[str]) -> DataFrame:
    """Rows of a level, and the 10, 50, 90 and 99 % quantiles of each of its ratios."""
    group = [*level, "ratio"]
    merged = sketch.groupBy(*group, "key").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*group).orderBy("key")
    whole = Window.partitionBy(*group)
    c = merged.withColumn("upto", F.sum("n").over(up_to)).withColumn("rows", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("key")))
    return c.groupBy(*group).agg(F.max("rows").alias("rows"), at(10).alias("q10"), at(50).alias("q50"), at(90).alias("q90"), at(99).alias("q99"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per language and source: ``lo_<ratio>`` (null where there is none) and ``hi_<ratio>``."""
    groups = sketch.select("lang", "source", "ratio").distinct()
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"])
    corpus = _quantiles(sketch, [])
    pick = lambda q: F.when(F.col("o.rows") >= min_rows, F.col(f"o.{q}")).when(
        F.col("l.rows") >= min_rows, F.col(f"l.{q}")).otherwise(F.col(f"c.{q}")).alias(q)
    g, o, la, c = groups.alias("g"), own.alias("o"), lang.alias("l"), corpus.alias("c")
    picked = (g.join(o, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source"))
                     & (F.col("g.ratio") == F.col("o.ratio")))
              .join(la, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.ratio") == F.col("l.ratio")))
              .join(F.broadcast(c), F.col("g.ratio") == F.col("c.ratio"))  # one row a ratio
              .select("g.lang", "g.source", "g.ratio", pick("q10"), pick("q50"), pick("q90"), pick("q99")))
    cols = []
    for r, (upper, quarters, lower) in RATIOS.items():
        of = lambda e, r=r: F.max(F.when(F.col("ratio") == r, e))
        q50, top = F.col("q50"), F.col(f"q{upper}")
        cols.append(of(q50 + F.floor(quarters * (top - q50) / 4) + _step(top)).alias(f"hi_{r}"))
        if lower:
            cols.append(of(q50 - REACH_BELOW * (q50 - F.col("q10")) - _step(q50)).alias(f"lo_{r}"))
    return picked.groupBy("lang", "source").agg(*cols)


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    limits = broadcast_if_small(write_table(limits, "quality_thresholds"))
    x = limits.select(F.col("lang").alias("x_lang"), F.col("source").alias("x_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    j = measured.join(x, measured["lang"].eqNullSafe(x["x_lang"]) & measured["source"].eqNullSafe(x["x_source"]), "left")
    good = ~base_failed()
    for r, (_, _, lower) in RATIOS.items():
        good = good & F.coalesce(_ratio(r) <= F.col(f"hi_{r}"), F.lit(True))
        if lower:
            good = good & F.coalesce(_ratio(r) >= F.col(f"lo_{r}"), F.lit(True))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", good)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                min_rows: int = MIN_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = write_table(_measured(rows, F.col("text")).drop("text"), "quality_counts")
    out = _judged(measured, thresholds(sketches(measured), min_rows))
    return out.select(F.col("doc_id").alias(id_col), *[F.col(f"m.{c}").alias(c) for c in COUNTS], "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The rows are written with their counts, which both the sketches and the verdict read: texts are not
    joined back by id, and filters are not pushed into the counting expressions.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = write_table(_measured(rows, F.col(f"row.`{text_col}`")), "quality_rows")
    out = _judged(measured, thresholds(sketches(measured), min_rows))
    return out.filter("kept").select("row.*")
