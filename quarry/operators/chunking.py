"""Text chunking (TXT-1a, TXT-1b, TXT-1c).

``fixed_chunks`` is the fixed-window splitter: windows of ``capacity``
characters that overlap by ``overlap`` (default ``capacity // 8``); the
``split_idx`` of a chunk is its character offset.  Empty text gives no chunk.

The chunk array is built in one projection (``transform`` over the offsets)
and exploded once, so the source text is not copied into every output row
before ``substring`` runs.

``boundary_chunks`` is the boundary-aware variant: it prefers to cut after
blank lines, then line ends, then sentence ends, then spaces, never
exceeding ``capacity``; a fold over each text walks from cut to cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default capacity (characters) and overlap divisor.
DEFAULT_CAPACITY = 4096
OVERLAP_DIVISOR = 8


def chunk_offsets(length: Column, capacity: int, overlap: int) -> Column:
    """Start offsets 0, step, 2*step, ... of windows that cover ``length`` chars."""
    step = capacity - overlap
    n_more = F.when(length > capacity, F.ceil((length - capacity) / F.lit(step))).otherwise(F.lit(0))
    return F.sequence(F.lit(0), (n_more * step).cast("int"), F.lit(step))


def fixed_chunks(df: DataFrame, text_col: str = "content", capacity: int = DEFAULT_CAPACITY,
                 overlap: int | None = None, offset_col: str = "split_idx",
                 chunk_col: str | None = None) -> DataFrame:
    """One row per window; other columns are carried, ``text_col`` is replaced.

    ``chunk_col`` defaults to ``text_col`` (the chunk replaces the text).
    """
    if overlap is None:
        overlap = capacity // OVERLAP_DIVISOR
    if not 0 <= overlap < capacity:
        raise ValueError("overlap must be in [0, capacity)")
    chunk_col = chunk_col or text_col
    text = F.col(text_col)
    offsets = chunk_offsets(F.length(text), capacity, overlap)
    chunks = F.transform(
        offsets,
        lambda s: F.struct(s.cast("long").alias(offset_col), F.substring(text, s + 1, F.lit(capacity)).alias(chunk_col)),
    )
    keep = [c for c in df.columns if c not in (text_col, offset_col, chunk_col)]
    return (
        df.where(F.length(text) > 0)
        .select(*keep, F.explode(chunks).alias("_chunk"))
        .select(*keep, "_chunk.*")
    )


# --- boundary-aware splitter ------------------------------------------------

#: Cut preferences, strongest first, as patterns whose group ends at the last such place of a
#: window: after a blank line, after a line, after a sentence (before white space), after a space.
BOUNDARIES = [r"(?s)^(.*\n\n)", r"(?s)^(.*\n)", r"(?s)^(.*[.!?])[ \t\n\r]", r"(?s)^(.* )"]
#: A cut lies beyond this part of the window.
LEAST_PART = 4


def _cut(window: Column, capacity: int) -> Column:
    """Length of the chunk that starts a full window: up to its strongest late boundary, or the whole window."""
    ends = [F.length(F.regexp_extract(window, b, 1)) for b in BOUNDARIES]
    cut = F.when(ends[0] > capacity // LEAST_PART, ends[0])
    for e in ends[1:]:
        cut = cut.when(e > capacity // LEAST_PART, e)
    return cut.otherwise(F.lit(capacity))


def boundary_chunks(df: DataFrame, key_cols: list[str], text_col: str = "content",
                    capacity: int = DEFAULT_CAPACITY, overlap: int | None = None,
                    offset_col: str = "split_idx") -> DataFrame:
    """Boundary-aware chunks (TXT-1b): ``(key columns, split_idx, text)``.

    A chunk is a window of ``capacity`` characters cut after its strongest boundary:
    the last blank line, else line, else sentence, else space that ends beyond a
    quarter of the window, else the whole window; the last chunk ends with the text.
    The next chunk starts ``overlap`` characters before that end, after the first space
    there (the last character does not count as one), and at least one character on.
    Empty texts give no chunk; chunks laid at their offsets give the text again.

    The starts come from a fold over each text that carries the next start, so no row
    leaves the JVM; a text is one row, whatever its length.
    """
    if overlap is None:
        overlap = capacity // OVERLAP_DIVISOR
    if not 0 <= overlap < capacity:
        raise ValueError("overlap must be in [0, capacity)")
    least_step = max(1, capacity // LEAST_PART + 1 - overlap)
    text = F.col("_text")
    rows = df.select(*key_cols, F.col(text_col).alias("_text")).where(F.length("_text") > 0).withColumn("_n", F.length("_text"))
    n = F.col("_n")
    none = F.array().cast("array<struct<at:int,len:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("chunks"))

    def step(s, _):
        at = s["at"]
        # each lambda below binds a value that later expressions use more than once
        cut = F.transform(F.array(F.when(at + capacity >= n, n - at).otherwise(_cut(F.substring(text, at + 1, F.lit(capacity)), capacity))), lambda length: F.struct(
            length.alias("len"), F.greatest(at + length - overlap, at + 1).alias("next")))
        moved = F.transform(cut, lambda c: F.struct(
            c["len"].alias("len"), c["next"].alias("next"), F.position(F.lit(" "), F.substring(text, c["next"] + 1, at + c["len"] - c["next"])).alias("space")))
        done = F.transform(moved, lambda c: F.struct(
            F.when(at + c["len"] >= n, n).when((c["space"] > 0) & (c["space"] < at + c["len"] - c["next"]), c["next"] + c["space"]).otherwise(c["next"]).alias("at"),
            F.concat(s["chunks"], F.array(F.struct(at.alias("at"), c["len"].alias("len")))).alias("chunks")))
        return F.when(at >= n, s).otherwise(F.get(done, 0))

    bound = F.ceil(n / F.lit(least_step)).cast("int")
    chunks = F.aggregate(F.sequence(F.lit(1), bound), start, step, lambda s: s["chunks"])
    out = rows.select(*key_cols, "_text", F.explode(chunks).alias("_c"))
    return out.select(*key_cols, F.col("_c.at").cast("long").alias(offset_col), F.substring("_text", F.col("_c.at") + 1, F.col("_c.len")).alias(text_col))
