"""Rule scan and rule matching (SRC-10, JN-5, AGG-8).

Rules are configuration: ``(ord, match regex, enabled, content)``; a NULL
``enabled`` means enabled.  Rules meet terms by pieces of literals that their
patterns need, in an equi join; only those pairs are tested, so neither the plan
nor the driver grows with the rules.  A piece is as long as the literal allows
(3, 6, 12, ... characters): there are only so many trigrams, and the pairs that
meet in one grow with the rules times the terms.
"""

from __future__ import annotations

import string
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small, ship_package, write_table

RULE_SCHEMA = "ord long, match string, enabled boolean, content string"
RULE_SEPARATOR = "\n---\n"  # fixed value: separator between matched rule texts


def rules_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """TOML (``[[injections]]`` tables) or JSON-lines rule files."""
    if path.endswith(".toml"):
        with open(path, "rb") as f:
            data = tomllib.load(f)
        items = data.get("injections", data)
        rows = [(i, it["match"], it.get("enabled"), it["content"]) for i, it in enumerate(items)]
        return rules_from_rows(spark, rows)
    df = spark.read.schema("ord long, match string, enabled boolean, content string").json(path)
    # files without an ``ord`` keep their line order; the long id orders lines within and across partitions
    return df.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce(F.col("enabled"), F.lit(True)))


#: Least length of the pieces by which rules meet terms; longer ones have twice, four times, ... this length.
GRAM = 3
#: Parts over which a rule without a needed literal is laid, so that its terms are no single key.
SPREAD = 64


def _needed(items) -> tuple[str, ...] | None:
    """Literals of which each match of a parsed pattern holds at least one; None where no such set is known.

    Runs of ASCII characters that must follow each other count, and what groups and
    repetitions need; an alternation needs one literal of each branch.  Of several sets
    the one whose shortest literal is longest wins.
    """
    from re import _constants as k
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is k.LITERAL and 0 < arg < 128:
            run += chr(arg)
            continue
        if op is k.AT:  # zero width: the run goes on
            continue
        if run:
            found.append((run,))
            run = ""
        inner = None
        if op is k.SUBPATTERN:
            inner = _needed(arg[3])
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is k.ATOMIC_GROUP:
            inner = _needed(arg)
        elif op is k.BRANCH:
            branches = [_needed(b) for b in arg[1]]
            inner = tuple(sorted({x for b in branches for x in b})) if all(branches) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def needed_literals(pattern: str) -> list[str] | None:
    """Lower-cased literals (ASCII) of which every text that ``pattern`` finds holds at least one.

    None where there is none of at least ``GRAM`` characters.  Patterns are read as
    Python does; escapes that Java reads otherwise give None, as do patterns that Python cannot read.
    """
    import re
    import warnings
    if re.search(r"\\[0-9vQEhHRGXN]|&&", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    got = _needed(tree)
    return sorted({x.lower() for x in got}) if got and min(map(len, got)) >= GRAM else None


def _grams(text: Column, size: Column) -> Column:
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _gram_size(literal: Column) -> Column:
    """The largest of ``GRAM``, ``2 * GRAM``, ``4 * GRAM``, ... that is no longer than the literal."""
    return (GRAM * F.pow(F.lit(2), F.length(F.bin(F.floor(F.length(literal) / GRAM))) - 1)).cast("int")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def rule_candidates(terms: DataFrame, rules: DataFrame, term_col: str = "term") -> DataFrame:
    """``(term, ord, match, content)``: the pairs in which a rule may match, a superset of those in which it does.

    Each needed literal of a rule stands in the index under one of its pieces of the
    longest length that fits (:func:`_gram_size`), that which fewest terms hold; a term
    meets the literals of its own pieces, of the lengths that are in use.  A rule without
    needed literals meets every term.
    """
    ship_package(terms.sparkSession)

    @F.pandas_udf("array<string>")
    def literals(patterns: pd.Series) -> pd.Series:
        return patterns.map(needed_literals)

    listed = write_table(rules.where(F.col("match").isNotNull()).select("ord", "match", "content", literals("match").alias("_literals")), "rules")
    asked = listed.where("_literals IS NOT NULL").select("ord", "match", "content", F.explode("_literals").alias("_literal")).distinct()
    pieces = asked.select("_literal").distinct().select("_literal", _gram_size(F.col("_literal")).alias("_size"))
    # as many as the longest literal has doublings
    sizes = sorted(r["_size"] for r in pieces.select("_size").distinct().collect())
    low = terms.select(term_col, _ascii_lower(F.col(term_col)).alias("_low"))
    own = F.concat(F.array().cast("array<string>"), *[_grams(F.col("_low"), F.lit(n)) for n in sizes])
    grams = write_table(low.select(term_col, F.explode(own).alias("gram")), "term_grams")
    # (literal, gram) with the number of terms that hold the gram; a literal with an absent gram cannot match
    pieces = pieces.select("_literal", F.explode(_grams(F.col("_literal"), F.col("_size"))).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    best = (pieces.join(seen, "gram", "left").groupBy("_literal")
            .agg(F.min(F.coalesce("_n", F.lit(0))).alias("_least"), F.min_by("gram", F.struct("_n", "gram")).alias("gram")).where("_least > 0"))
    held = grams.join(broadcast_if_small(write_table(best.select("_literal", "gram"), "rule_grams")), "gram")
    held = held.where(F.contains(_ascii_lower(F.col(term_col)), F.col("_literal"))).select(term_col, "_literal")
    met = held.join(broadcast_if_small(asked), "_literal").select(term_col, "ord", "match", "content").distinct()
    free = listed.where("_literals IS NULL").select("ord", "match", "content", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    any_term = terms.select(term_col, F.pmod(F.xxhash64(term_col), F.lit(SPREAD)).cast("int").alias("_part"))
    return met.unionByName(any_term.join(broadcast_if_small(free), "_part").select(term_col, "ord", "match", "content"))


def rule_matches(terms: DataFrame, rules: DataFrame, term_col: str = "term") -> DataFrame:
    """Per term: texts of matching enabled rules, in rule order, joined (JN-5, AGG-8).

    Distinct terms meet their candidate rules by trigrams (:func:`rule_candidates`) and
    are tested by ``rlike`` there only; the result is joined back.  Rules are a table of
    any length.
    """
    distinct_terms = write_table(terms.select(term_col).where(F.col(term_col).isNotNull()).distinct(), "terms")
    pairs = rule_candidates(distinct_terms, enabled_rules(rules), term_col).where(F.expr(f"`{term_col}` rlike match"))
    matched = pairs.groupBy(term_col).agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("_m"))
    matched = matched.select(term_col, F.array_join(F.transform("_m", lambda x: x["content"]), RULE_SEPARATOR).alias("matches"),
                             F.size("_m").cast("long").alias("n_matches"))
    return (terms.join(matched, term_col, "left")
            .withColumn("matches", F.coalesce("matches", F.lit(""))).withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long"))))
