"""Inverted index over content rows (TXT-5, TXT-6, SCH-4).

``build_text_index`` returns two DataFrames:

* ``postings(id, <scope cols>, term, tf, dl, first)`` — one row per
  (row, term); ``dl`` (the row's token count) is carried so scoring needs
  no join back, and ``first`` marks one posting per row, so N and avgdl
  come from the same table without a shuffle (a row with no token keeps a
  single posting with a NULL term).

Term counts: tokens are sorted and exploded once, then counted with a
partial aggregate (all tokens of a row are in one task, so the map side
already holds the final counts).  Persist with
:func:`write_text_index`, which sorts postings by term inside each shard so
Parquet min/max statistics skip row groups for a term lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokenize

INDEX_FIELDS = ("filename", "content")


@dataclass
class TextIndex:
    """``postings(id, <scope>, term, tf, dl, first)``; a row without tokens
    keeps one posting with a NULL term so it still counts in N."""
    postings: DataFrame
    id_col: str = "id"
    scope_cols: tuple = ()

    @property
    def lengths(self) -> DataFrame:
        """One row per content row (its first posting): no shuffle needed."""
        return self.postings.where(F.col("first")).select(self.id_col, *self.scope_cols, "dl")

    def terms(self) -> DataFrame:
        return self.postings.where(F.col("term").isNotNull())

    def materialize(self) -> "TextIndex":
        """Write the postings once as a Parquet table in the shared folder; every
        later branch (statistics, df, matches) scans that table."""
        from quarry.session import write_table
        return TextIndex(write_table(self.postings, "postings"), self.id_col, self.scope_cols)


def _tokens(fields):
    arrs = [tokenize(f) for f in fields]
    return arrs[0] if len(arrs) == 1 else F.concat(*arrs)


def build_text_index(content: DataFrame, id_col: str = "id", fields=INDEX_FIELDS,
                     scope_cols=("instance_id",), colocated_by: str | None = None) -> TextIndex:
    """``colocated_by``: a column the content is already hash partitioned by and
    that is constant per row id (e.g. the document of a chunk); it joins the
    grouping keys so the postings aggregate reuses that partitioning."""
    scope_cols = tuple(c for c in scope_cols if c in content.columns)
    co = [colocated_by] if colocated_by and colocated_by in content.columns else []
    base = content.select(*co, id_col, *scope_cols, _tokens(fields).alias("_toks"))
    # explode_outer: no inferred size() filter (it would re-tokenise), and a
    # row without tokens keeps one posting with a NULL term so it counts in N
    ex = base.select(*co, id_col, *scope_cols, F.size("_toks").cast("long").alias("dl"),
                     F.posexplode_outer(F.sort_array("_toks")).alias("_pos", "term"))
    # all postings of a row sit in one task: the partial (map-side) aggregate
    # already holds the final counts, the exchange only moves postings
    postings = ex.groupBy(*co, id_col, *scope_cols, "dl", "term").agg(
        F.count("term").alias("tf"), F.bool_or(F.coalesce(F.col("_pos") == 0, F.lit(True))).alias("first"))
    postings = postings.select(id_col, *scope_cols, "term", "tf", "dl", "first")
    return TextIndex(postings, id_col, scope_cols)


def corpus_stats(index: TextIndex, scope: list[str] | tuple = ()) -> DataFrame:
    """N (rows) and average row length per statistics scope (SCH-4)."""
    g = index.lengths.groupBy(*scope) if scope else index.lengths.groupBy()
    return g.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum("dl").cast("long").alias("total_len"))


def term_document_frequency(index: TextIndex, terms: DataFrame, scope=(), counted_first: bool = False) -> DataFrame:
    """df(term) per scope, for the given (distinct) terms only.

    ``counted_first``: for terms too many to be broadcast, the postings are counted
    before the terms meet them, so that counts are shuffled and not postings.
    """
    if counted_first:
        counts = index.terms().groupBy(*scope, "term").agg(F.count(F.lit(1)).cast("long").alias("df"))
        return counts.join(terms.select("term").distinct(), "term", "left_semi")
    p = index.terms().join(terms.select("term").distinct(), "term", "left_semi")
    return p.groupBy(*scope, "term").agg(F.count(F.lit(1)).cast("long").alias("df"))


def write_text_index(index: TextIndex, path: str, shard_col: str | None = None, mode: str = "overwrite") -> None:
    """Persist postings (sorted by term within each shard) and lengths."""
    post = index.postings
    w = post.repartition(shard_col) if shard_col else post.repartitionByRange("term")
    # lengths are the postings' first rows; they are not written separately
    (w.sortWithinPartitions("term")
       .write.mode(mode).partitionBy(*([shard_col] if shard_col else [])).parquet(f"{path}/postings"))
