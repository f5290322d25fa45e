"""Batch search: BM25 top-k and exact L1 vector top-k (SCH-1..SCH-7, FLT-1..3).

Both searches take a *batch* of queries as a DataFrame and return ranked rows
for every query in one plan:

1. score candidates (postings join for BM25, per-instance equi join for L1);
2. apply the pre-filters (element type, directory prefixes);
3. keep the best ``over_fetch * k`` per query with ``row_number`` (Spark's
   window group limit computes a partial top-k before the shuffle);
4. join the wide content columns only for those rows (late materialisation);
5. de-duplicate, first seen wins, and cut to ``k``.

Scale notes: the query side is broadcast only after its size is measured
(:func:`quarry.session.broadcast_if_small`); BM25 looks up only (candidate,
query term) pairs, whose count is bounded before the plan runs by
``sum(df(rarest term) * n_terms)`` read from the small per-term df table; the
top-k frame is bounded by ``n_queries * over_fetch * k`` rows, which is
checked the same way before it is broadcast to the content join.  Scores are summed with a partial
(map-side) aggregate, so a term present in a third of all rows is combined
per task before it is shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import (NON_CODE_PATH_LIKE, NON_CODE_TYPES, clean_query,
                                   tokenize, with_term_counts)
from quarry.operators.index import TextIndex, corpus_stats, term_document_frequency
from quarry.session import BROADCAST_MAX_ROWS, broadcast_if_small, shuffled, write_table

# BM25 constants and the IDF floor, default k and over-fetch.
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
DEFAULT_K = 5
OVER_FETCH = 3
# Search presets (k, dedup by file) of the call sites.
PRESET_VECTOR = dict(k=25, dedup_by_file=True, elem_type="code")
PRESET_TEXT = dict(k=10, elem_type="code")
PRESET_TRY = dict(k=3, elem_type="code")

ELEMENT_KEY = ["filename", "elem_name", "parent_name", "elem_type", "split_idx"]


# --------------------------------------------------------------------------- filters
def elem_type_filter(elem_type) -> Column | None:
    """``"code"`` / list / single type / None (FLT-1)."""
    if elem_type is None:
        return None
    if elem_type == "code":
        return (~F.col("elem_type").isin(NON_CODE_TYPES)) & (~F.col("filename").ilike(NON_CODE_PATH_LIKE))
    if isinstance(elem_type, (list, tuple)):
        return F.col("elem_type").isin(list(elem_type))
    return F.col("elem_type") == F.lit(elem_type)


def dir_filter(in_dirs) -> Column | None:
    """OR of ``filename LIKE 'd%'`` (``_``/``%`` stay wildcards, ASCII case ignored) (FLT-2)."""
    if in_dirs is None:
        return None
    dirs = [in_dirs] if isinstance(in_dirs, str) else list(in_dirs)
    cond = F.lit(False)
    for d in dirs:
        cond = cond | F.col("filename").ilike(d + "%")
    return cond


def like_prefix(d: Column) -> Column:
    """What a LIKE pattern says literally: its part before the first ``%`` or ``_``."""
    return F.regexp_extract(d, r"^[^%_]*", 0)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def in_query_dirs(rows: DataFrame, dirs: DataFrame, wildcards: bool = False, id_col: str = "id") -> DataFrame:
    """``rows(query_id, id, filename)`` that lie in a directory of their own query (FLT-2, JN-3).

    ``dirs(query_id, dir)``: a path lies in a directory that it starts with, ASCII case
    ignored.  Queries that name no directory keep all their rows.  Each path gives its
    prefixes of the lengths that directories have, and these meet ``dirs`` in an equi
    join on (query, prefix).  ``%`` and ``_`` stand for themselves unless
    ``wildcards`` asks for LIKE; then the part before the first of them is the key.
    """
    d = dirs.where(F.col("dir").isNotNull()).select("query_id", _ascii_lower(F.col("dir")).alias("dir")).distinct()
    d = write_table(d.withColumn("prefix", like_prefix(F.col("dir")) if wildcards else F.col("dir")), "query_dirs")
    lengths = sorted(r[0] for r in d.select(F.length("prefix")).distinct().collect())  # no more than the longest path has characters
    asking = broadcast_if_small(d.select("query_id").distinct())
    free = rows.join(asking, "query_id", "left_anti").select("query_id", id_col)
    path = _ascii_lower(F.col("filename"))
    keys = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("filename")) if lengths else F.array().cast("array<int>")
    tried = rows.join(asking, "query_id", "left_semi").select("query_id", id_col, path.alias("_path"), F.explode(keys).alias("_n"))
    tried = tried.withColumn("prefix", F.substring("_path", F.lit(1), F.col("_n")))
    met = tried.join(broadcast_if_small(d), ["query_id", "prefix"])
    if wildcards:
        met = met.where(F.expr("_path LIKE concat(dir, '%')"))
    return free.unionByName(met.select("query_id", id_col).distinct())


def combine_filters(*conds) -> Column | None:
    out = None
    for c in conds:
        if c is not None:
            out = c if out is None else (out & c)
    return out


# --------------------------------------------------------------------------- ranking helpers
def _top_n(df: DataFrame, n: int, order: list, part: str = "query_id", rank_col: str = "_r") -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def dedup_ranked(df: DataFrame, k: int, by_file: bool, rank_col: str = "_r") -> DataFrame:
    """First seen wins by file or by element key, then cut to ``k`` (SCH-7)."""
    key = ["filename"] if by_file else ELEMENT_KEY
    w_key = Window.partitionBy("query_id", *key).orderBy(rank_col)
    first = df.withColumn("_d", F.row_number().over(w_key)).where(F.col("_d") == 1).drop("_d")
    w = Window.partitionBy("query_id").orderBy(rank_col)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _attach_content(top: DataFrame, content: DataFrame, id_col: str, bound: int) -> DataFrame:
    """Join the wide columns for the top rows only; broadcast when the bound allows."""
    side = F.broadcast(top) if bound <= BROADCAST_MAX_ROWS else shuffled(top)
    return content.join(side, id_col)


# --------------------------------------------------------------------------- BM25
def query_terms(queries: DataFrame, text_col: str = "text", keep=("instance_id",)) -> DataFrame:
    """(query_id, [instance_id], term, qtf, n_terms) after punctuation clean-up (TXT-4)."""
    keep = [c for c in keep if c in queries.columns]
    toks = queries.select("query_id", *keep, tokenize(clean_query(F.col(text_col))).alias("_qt"))
    return (
        with_term_counts(toks, "_qt", "_tc")
        .select("query_id", *keep, F.size("_tc").cast("long").alias("n_terms"), F.explode_outer("_tc").alias("_t"))
        .where(F.col("_t").isNotNull())
        .select("query_id", *keep, F.col("_t.term").alias("term"), F.col("_t.tf").alias("qtf"), "n_terms")
    )


#: Hashes of what queries ask for that may be broadcast to the postings.
TERM_HASHES = 2_000_000


def asked_postings(postings: DataFrame, query_term_rows: DataFrame, cols: list[str]) -> DataFrame:
    """The postings that queries may read: those whose ``cols`` (the term, with its instance) a query names.

    Many queries still name few of the terms of all rows.  While what they name is
    within ``TERM_HASHES``, its 64-bit hashes are broadcast and no posting is shuffled;
    two names that share a hash keep postings too many, which the joins that follow leave out.
    """
    asked = query_term_rows.select(F.xxhash64(*cols).alias("_h")).distinct()
    small = broadcast_if_small(asked, TERM_HASHES)
    if small is asked:
        return postings.join(shuffled(query_term_rows.select(*cols).distinct()), cols, "left_semi")
    return postings.withColumn("_h", F.xxhash64(*cols)).join(small, "_h", "left_semi").drop("_h")


def bm25_scores(index: TextIndex, queries: DataFrame, per_instance: bool = True, stats_scope=(),
                k1: float = BM25_K1, b: float = BM25_B, text_col: str = "text", allowed: DataFrame | None = None,
                narrow=None) -> DataFrame:
    """(query_id, id, score) for rows holding *all* query terms; smaller is better.

    ``stats_scope`` names the columns N, avgdl and df are grouped by:
    ``()`` for the whole corpus, ``("shard",)`` or ``("instance_id",)``.
    ``allowed`` (a frame of ids) and ``narrow`` (from ``(query_id, id)`` to the rows
    to keep) narrow the candidates before they are scored.
    """
    id_col = index.id_col
    inst = ["instance_id"] if per_instance else []
    qt_all = query_terms(queries, text_col, keep=tuple(inst))
    qt = broadcast_if_small(qt_all)
    # rarest-term rows are at most one per query term row: broadcast them only
    # when the query terms themselves passed the size check
    small_queries = qt is not qt_all
    qt = qt if small_queries else shuffled(qt_all)
    scope = list(stats_scope)
    stats = corpus_stats(index, scope).withColumn("avgdl", F.col("total_len") / F.col("n_rows"))
    if small_queries:
        dfreq, terms = term_document_frequency(index, qt, scope), index.terms()
    else:
        dfreq = term_document_frequency(TextIndex(asked_postings(index.terms(), qt_all, ["term"]), id_col, index.scope_cols), qt, scope, counted_first=True)
        terms = write_table(asked_postings(index.terms(), qt_all, [*inst, "term"]), "asked_postings")
    # Conjunctive evaluation: a row must hold every query term, so the
    # candidates are the rows holding the query's rarest term; only those
    # (candidate, query term) pairs are looked up in the postings.  A query
    # with a term absent from the corpus has no candidate at all.
    # df of the query terms is tiny (one row per distinct query term): write it
    # once, so the candidate bound below and the scoring read the same table
    dfreq = write_table(dfreq, "dfreq")
    dfreq = dfreq if small_queries else shuffled(dfreq)
    dglob = dfreq.groupBy("term").agg(F.sum("df").alias("_gdf"))
    rare = (qt.join(dglob, "term")
              .groupBy("query_id", *inst)
              .agg(F.count(F.lit(1)).alias("_present"), F.first("n_terms").alias("_n"),
                   F.min_by(F.struct("term", "_gdf"), F.struct("_gdf", "term")).alias("_r"))
              .where(F.col("_present") == F.col("_n"))
              .select("query_id", *inst, F.col("_r.term").alias("term"), (F.col("_r._gdf") * F.col("_n")).alias("_pairs")))
    # proven size of the (candidate, query term) set: sum of rarest df x terms
    bound = rare.agg(F.sum("_pairs")).first()[0] or 0
    rare_side = rare.drop("_pairs")
    cand = terms.join(F.broadcast(rare_side) if small_queries else shuffled(rare_side), ["term"] + inst).select("query_id", id_col)
    if allowed is not None:
        cand = cand.join(shuffled(allowed), id_col, "left_semi")
    if narrow is not None:
        cand = narrow(cand)
    pairs = cand.join(qt.select("query_id", "term", "qtf", "n_terms"), "query_id")
    if bound <= BROADCAST_MAX_ROWS:
        pairs = F.broadcast(pairs)
    else:
        pairs = shuffled(pairs)
    hits = terms.join(pairs, [id_col, "term"])
    if not scope:
        # two numbers for the whole corpus: literals, no join
        one = stats.select("n_rows", "avgdl").first()
        hits = hits.join(dfreq, ["term"]).withColumn("n_rows", F.lit(one["n_rows"])).withColumn("avgdl", F.lit(one["avgdl"]))
    else:
        hits = hits.join(stats, scope).join(dfreq, scope + ["term"])
    idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    tf = F.col("tf").cast("double")
    contrib = F.col("qtf") * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    agg = hits.groupBy("query_id", id_col).agg(
        F.sum(contrib).alias("_s"), F.count(F.lit(1)).alias("_m"), F.first("n_terms").alias("_n"))
    return agg.where(F.col("_m") == F.col("_n")).select("query_id", id_col, (-F.col("_s")).alias("score"))


def bm25_search(index: TextIndex, content: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                over_fetch: int = OVER_FETCH, elem_type=None, in_dirs=None, dedup: bool = True,
                dedup_by_file: bool = False, per_instance: bool = True, stats_scope=(),
                score_round: int | None = 6, text_col: str = "text", wildcards: bool = False) -> DataFrame:
    """BM25 top-k per query with pre-filters, over-fetch, de-dup (SCH-3..SCH-7).

    A query whose text has no term after clean-up returns no rows (SCH-5).
    ``in_dirs`` is a list for all queries or a table ``(query_id, dir)``
    (:func:`in_query_dirs`).
    """
    id_col = index.id_col
    by_query = isinstance(in_dirs, DataFrame)
    cond = combine_filters(elem_type_filter(elem_type), None if by_query else dir_filter(in_dirs))
    allowed = content.where(cond).select(id_col) if cond is not None else None
    narrow = (lambda cand: in_query_dirs(cand.join(content.select(id_col, "filename"), id_col), in_dirs, wildcards, id_col)) if by_query else None
    scores = bm25_scores(index, queries, per_instance, stats_scope, text_col=text_col, allowed=allowed, narrow=narrow)
    dist = F.round("score", score_round) if score_round is not None else F.col("score")
    scores = scores.withColumn("distance", dist)
    n_q = queries.select("query_id").distinct().count()
    fetch = over_fetch * k
    top = _top_n(scores, fetch, [F.col("distance"), F.col(id_col)])
    ranked = _attach_content(top, content, id_col, n_q * fetch)
    if dedup:
        return dedup_ranked(ranked, k, dedup_by_file)
    w = Window.partitionBy("query_id").orderBy("_r")
    return ranked.withColumn("rank", F.row_number().over(w))


# --------------------------------------------------------------------------- L1 vectors
def l1_distance(a, b) -> Column:
    """Sum of absolute differences, in double (SCH-2)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


#: Rows of an instance in one join key, where the queries are too many to be broadcast.
BLOCK_ROWS = 100_000


def choose_pivots(corpus: DataFrame, n: int = 8, id_col: str = "id", vec_col: str = "embedding") -> list[list[float]]:
    """``n`` vectors, those with the least hashed ids; any choice gives the same answers, only more or less is scored."""
    rows = corpus.where(F.size(vec_col) > 0).select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(n).collect()
    return [[float(x) for x in r[0]] for r in rows]


def pivot_distances(vec_col, pivots: list[list[float]]) -> Column:
    """L1 distances of a vector to the pivots; stored with a row when the index is built."""
    at = [l1_distance(vec_col, F.lit(p).cast("array<double>")) for p in pivots]
    return F.array(*at) if at else F.array().cast("array<double>")


def _by_block(cand: DataFrame, q: DataFrame, id_col: str, block_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Candidates and queries with common join keys: the instance, cut into salted blocks unless the queries are proven few."""
    small = broadcast_if_small(q)
    if small is not q:
        return cand, small, ["instance_id"]
    sizes = cand.groupBy("instance_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"))
    sizes = broadcast_if_small(write_table(sizes, "instance_blocks"))
    cand = cand.join(sizes, "instance_id").withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int")).drop("_blocks")
    q = q.join(sizes, "instance_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return cand, shuffled(q), ["instance_id", "_block"]


def pivot_candidates(cand: DataFrame, queries: DataFrame, pivots: list[list[float]], fetch: int, id_col: str = "id", vec_col: str = "embedding",
                     qvec_col: str = "qvec", pivot_col: str = "pivot_distances", slack: float = 1e-6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, id)``: the pairs that may be among the ``fetch`` nearest, by the triangle inequality on stored distances.

    For each pivot ``|d(x, p) - d(q, p)|`` is a lower bound of ``d(x, q)``.  The rows with
    the least bounds are scored first; the ``fetch``-th of their distances bounds the
    answer from above, and only rows whose lower bound reaches it by ``slack`` (for rounded scores) remain.
    """
    q = queries.select("query_id", "instance_id", pivot_distances(qvec_col, pivots).alias("_qd"))
    rows, q, keys = _by_block(cand.select(id_col, "instance_id", F.col(pivot_col).alias("_xd")), q, id_col, block_rows)
    gaps = F.zip_with("_xd", "_qd", lambda a, b: F.abs(a - b))
    pairs = rows.join(q, keys).select("query_id", id_col, F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("_lo"))
    first = write_table(_top_n(pairs, fetch, [F.col("_lo"), F.col(id_col)]).select("query_id", id_col), "pivot_first")
    scored = (cand.select(id_col, vec_col).join(broadcast_if_small(first), id_col)
              .join(broadcast_if_small(queries.select("query_id", qvec_col)), "query_id")
              .select("query_id", l1_distance(vec_col, qvec_col).alias("_d")))
    reach = scored.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= fetch, F.max("_d")).alias("_top"))
    reach = broadcast_if_small(write_table(reach, "pivot_reach"))
    within = pairs.join(reach, "query_id").where(F.col("_top").isNull() | (F.col("_lo") <= F.col("_top") + F.lit(slack)))
    return within.select("query_id", id_col)


def l1_search(corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_K, over_fetch: int = OVER_FETCH,
              elem_type=None, in_dirs=None, dedup: bool = True, dedup_by_file: bool = True,
              id_col: str = "id", vec_col: str = "embedding", qvec_col: str = "qvec",
              score_round: int | None = 6, content: DataFrame | None = None, wildcards: bool = False,
              pivots: list[list[float]] | None = None, block_rows: int = BLOCK_ROWS, dedup_first: bool = False) -> DataFrame:
    """Exact L1 top-k per query inside its instance (SCH-1, JN-1, JN-4).

    ``corpus``: (id, instance_id, embedding, ...content columns).  Rows with an
    empty embedding (exact-only rows) are not candidates.  ``queries``:
    (query_id, instance_id, qvec).  Only ``id, instance_id, embedding`` take
    part in scoring; the content columns are joined after the top-k.  With
    ``pivots``, for a corpus that stores :func:`pivot_distances`, rows out of reach are
    left out before any vector is compared.  ``dedup_first`` takes the best row of each
    file or element before the cut, so that copies of one never crowd out others; by
    default ``over_fetch * k`` rows are cut first.
    """
    key = ["filename"] if dedup_by_file else ELEMENT_KEY
    # what copies are told by goes with the rows that are scored, where these hold it: the pairs are many times as many
    with_key = key if dedup and dedup_first and content is None else []
    content = content if content is not None else corpus
    by_query = isinstance(in_dirs, DataFrame)
    cond = combine_filters(elem_type_filter(elem_type), None if by_query else dir_filter(in_dirs))
    cand = corpus.where(F.size(vec_col) > 0)
    if cond is not None:
        cand = cand.where(cond)
    q = queries.select("query_id", "instance_id", qvec_col)
    fetch = over_fetch * k
    if by_query:  # decided on paths, before any vector is looked at
        paths = cand.select(id_col, "instance_id", "filename").join(q.drop(qvec_col), "instance_id").select("query_id", id_col, "filename")
        pairs = in_query_dirs(paths, in_dirs, wildcards, id_col)
        asked = cand.select(id_col, vec_col, *with_key).join(pairs, id_col).join(broadcast_if_small(q.drop("instance_id")), "query_id")
    elif pivots is not None and not (dedup and dedup_first):  # the bound on ids says nothing about files
        slack = 1e-9 if score_round is None else 2 * 10.0 ** -score_round
        pairs = pivot_candidates(cand, q, pivots, fetch, id_col, vec_col, qvec_col, slack=slack, block_rows=block_rows)
        asked = cand.select(id_col, vec_col).join(pairs, id_col).join(broadcast_if_small(q.drop("instance_id")), "query_id")
    else:
        rows, q, keys = _by_block(cand.select(id_col, "instance_id", vec_col, *with_key), q, id_col, block_rows)
        asked = rows.join(q, keys)
    scored = asked.select(
        "query_id", id_col, *with_key, l1_distance(vec_col, qvec_col).alias("score"))
    dist = F.round("score", score_round) if score_round is not None else F.col("score")
    scored = scored.withColumn("distance", dist)
    n_q = queries.select("query_id").distinct().count()
    if dedup and dedup_first:
        named = scored if with_key else scored.join(content.select(id_col, *key), id_col)
        best = named.groupBy("query_id", *key).agg(F.min(F.struct("distance", id_col)).alias("_b"))
        scored, fetch = best.select("query_id", F.col(f"_b.{id_col}").alias(id_col), F.col("_b.distance").alias("distance")), k
    top = _top_n(scored, fetch, [F.col("distance"), F.col(id_col)])
    ranked = _attach_content(top, content.drop(vec_col) if vec_col in content.columns else content, id_col, n_q * fetch)
    if dedup:
        return dedup_ranked(ranked, k, dedup_by_file)
    w = Window.partitionBy("query_id").orderBy("_r")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
