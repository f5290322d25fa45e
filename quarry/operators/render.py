"""Line-numbered text, ranges and prompt text assembly (PRM-1..PRM-6, TXT-8, SCH-11, JN-6).

Files are arrays of lines (``split(content, '\\n')``); ranges are
``slice`` calls and numbering is a ``transform`` with the element index, so
rendering one file is a projection of its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import shuffled

# Lookup padding (lines), size limits (characters), ladder limit.
LOOKUP_PAD = 10
FILE_RANGE_LIMIT = 20_000
CLASS_LIMIT_ALL_FILES = 5_000
CLASS_LIMIT_IN_FILE = 10_000
LADDER_LIMIT = 32_000
NO_FILES_TEXT = "No files retrieved."
NO_TESTS_TEXT = "No test cases."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rjust(num: Column, width: Column) -> Column:
    """``str(num).rjust(width)`` — never truncates (``lpad`` would)."""
    s = num.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, " "))


def numbered_lines(lines: Column, first_index: Column, width: Column, numbers: bool = True) -> Column:
    """``"{n:>w} |{line}"`` per line joined by newlines, plus a trailing newline (PRM-1).

    ``first_index`` is 0-based (the first line shows ``first_index + 1``).
    """
    ls = F.transform(F.coalesce(_c(lines), F.array().cast("array<string>")), lambda l: F.coalesce(l, F.lit("")))
    if numbers:
        ls = F.transform(ls, lambda l, i: F.concat(rjust(i + first_index + 1, width), F.lit(" |"), l))
    return F.concat(F.array_join(ls, "\n"), F.lit("\n"))


def line_width(lines: Column) -> Column:
    """Padding width: digits of the file's line count."""
    return F.length(F.size(_c(lines)).cast("string"))


def lookup_range(lines: Column, line_start: Column, line_end: Column, pad: int = LOOKUP_PAD):
    """Lookup form of a range: ``max(0, start-pad) .. min(n, end+pad)`` 0-based, ``-1`` = end (SCH-11)."""
    n = F.size(lines)
    lo = F.greatest(F.lit(0), line_start - pad)
    end = F.when(line_end == -1, n).otherwise(line_end)
    hi = F.least(n, end + pad)
    return lo, hi


def range_text(lines: Column, lo: Column, hi: Column, width: Column | None = None) -> Column:
    """Numbered text of ``lines[lo:hi]`` (0-based half-open)."""
    width = width if width is not None else line_width(lines)
    sub = F.when(hi > lo, F.slice(lines, lo + 1, hi - lo)).otherwise(F.array().cast("array<string>"))
    return numbered_lines(sub, lo, width)


#: Lines of a text, and characters, that one window or join key holds at most.
SEGMENT_LINES = 65_536
SEGMENT_CHARS = 1 << 20


def running_lengths(lines: DataFrame, id_col: str = "id", segment: int = SEGMENT_LINES) -> tuple[DataFrame, DataFrame]:
    """Running length at each line of ``lines(id, pos, len)``, as segmented prefix sums.

    A text is cut into segments of ``segment`` lines; each adds up its own lines, the
    totals are added up over the segments, and a line's running length is its segment's
    start plus its own.  Returns ``(id, segment, pos, key)`` and the segments ``(id, segment, start, stop)``.
    """
    cut = lines.withColumn("segment", F.floor(F.col("pos") / segment).cast("long"))
    totals = cut.groupBy(id_col, "segment").agg(F.sum("len").alias("_n"))
    before = Window.partitionBy(id_col).orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = totals.withColumn("stop", F.sum("_n").over(before).cast("long"))
    segments = ends.select(id_col, "segment", (F.col("stop") - F.col("_n")).cast("long").alias("start"), "stop")
    own = Window.partitionBy(id_col, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.select(id_col, "segment", "pos", F.sum("len").over(own).cast("long").alias("_in"))
    return within.join(segments.select(id_col, "segment", "start"), [id_col, "segment"]).select(id_col, "segment", "pos", (F.col("start") + F.col("_in")).alias("key")), segments


def offsets_to_lines(texts: DataFrame, offsets: DataFrame, id_col: str = "id", text_col: str = "text",
                     offset_col: str = "offset", segment: int = SEGMENT_LINES, bucket: int = SEGMENT_CHARS) -> DataFrame:
    """First line whose running length (newlines not counted) reaches the offset (TXT-8).

    NULL when the offset lies beyond the text.  See :func:`line_of_offset`.
    """
    lines = texts.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return line_of_offset(lines.select(id_col, F.col("pos").cast("long").alias("pos"), F.length("line").alias("len")), offsets, id_col, offset_col, segment, bucket)


def line_of_offset(lines: DataFrame, offsets: DataFrame, id_col: str = "id", offset_col: str = "offset",
                   segment: int = SEGMENT_LINES, bucket: int = SEGMENT_CHARS) -> DataFrame:
    """``(id, offset, line_idx)`` from ``lines(id, pos, len)``, which may be rows of texts of any length.

    An offset finds its segment by the stretch of ``bucket`` characters that it lies in
    (an equi join; a segment stands under each stretch that it reaches into).  Inside
    the segment, lines and offsets are merged into one stream, ordered downwards, and
    each offset takes the last line position seen, so no window is longer than a segment.
    Of lines with the same running length (empty lines) the first one counts.
    """
    cum, segments = running_lengths(lines, id_col, segment)
    # an offset of 0 or less is reached by the first line, whatever its length
    first = F.col("segment") == 0
    low = F.when(first, F.lit(-1)).otherwise(F.floor(F.col("start") / bucket))
    high = F.greatest(low, F.floor((F.col("stop") - 1) / bucket))
    reach = segments.where(first | (F.col("stop") > F.col("start"))).select(id_col, "segment", "start", "stop", F.explode(F.sequence(low, high)).alias("_bucket"))
    marks = offsets.select(id_col, F.col(offset_col).cast("long").alias(offset_col))
    asked = marks.distinct().withColumn("_bucket", F.greatest(F.lit(-1).cast("long"), F.floor((F.col(offset_col) - 1) / bucket)))
    inside = (F.col(offset_col) <= F.col("stop")) & ((F.col(offset_col) > F.col("start")) | (first & (F.col(offset_col) <= 0)))
    found = asked.join(reach, [id_col, "_bucket"]).where(inside).select(id_col, "segment", offset_col)
    stream = cum.select(id_col, "segment", "key", "pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias(offset_col)).unionByName(
        found.select(id_col, "segment", F.col(offset_col).alias("key"), F.lit(None).cast("long").alias("pos"), F.lit(0).alias("kind"), offset_col))
    down = Window.partitionBy(id_col, "segment").orderBy(F.desc("key"), F.desc("kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = stream.withColumn("line_idx", F.last("pos", ignorenulls=True).over(down)).where(F.col("kind") == 0).select(id_col, offset_col, "line_idx")
    return marks.join(at, [id_col, offset_col], "left").select(id_col, offset_col, "line_idx")


def budget_ladder(texts_by_level: list[Column], limit: int = LADDER_LIMIT) -> Column:
    """Richest text under the limit; the last one is kept even if over (PRM-3)."""
    expr = None
    for t in texts_by_level[:-1]:
        expr = F.when(F.length(t) < limit, t) if expr is None else expr.when(F.length(t) < limit, t)
    last = texts_by_level[-1]
    return last if expr is None else expr.otherwise(last)


def brief_label(elem_type: Column, elem_name: Column, parent_name: Column, filename: Column) -> Column:
    """Short label by element type (PRM-5)."""
    return (F.when(elem_type == "function", F.format_string("Function %s in %s", elem_name, filename))
            .when(elem_type == "method", F.format_string("Method %s.%s in %s", parent_name, elem_name, filename))
            .when(elem_type == "class", F.format_string("Class %s in %s", elem_name, filename))
            .otherwise(F.format_string("Content of %s", filename)))


def file_for_prompt(path: Column, content: Column, ranges: Column, mode: str = "FILE_AND_LINES") -> Column:
    """Retrieved-file rendering (PRM-2).

    ``ranges``: ``array<struct<start int, end int>>`` half-open, 1-based;
    modes FILE_ONLY / LINES_ONLY / FILE_AND_LINES.  With no ranges (NULL)
    the whole file is shown.
    """
    lines = F.split(content, "\n")
    sections = None
    if mode != "FILE_ONLY":
        def sec(r):
            s, e = r["start"], r["end"]
            w = F.length(e.cast("string"))
            body = F.array_join(
                F.transform(F.when(e - 1 >= s, F.slice(lines, s, e - s)).otherwise(F.array().cast("array<string>")),
                            lambda l, i: F.concat(rjust(i + s, w), F.lit(" |"), l)), "\n")
            return F.concat(F.lit("Here is a portion of "), path, F.lit(" from line "), s.cast("string"), F.lit(" to "),
                            (e - 1).cast("string"), F.lit(":\n```py\n"), body, F.lit("\n```"))
        joined = F.array_join(F.transform(ranges, sec), "\n-----\n")
        sections = F.when(ranges.isNotNull(), F.concat(F.lit("\n-----\n"), joined, F.lit("\n-----\n"))).otherwise(F.lit(""))
    else:
        sections = F.lit("")
    full = None
    n = F.size(lines)
    w = F.length((n + 1).cast("string"))
    whole = F.array_join(F.transform(lines, lambda l, i: F.concat(rjust(i + 1, w), F.lit(" |"), l)), "\n")
    whole = F.concat(F.lit("\n-----\nHere is the full content of "), path, F.lit(":\n"), whole, F.lit("\n-----\n"))
    if mode == "LINES_ONLY":
        full = F.when(ranges.isNull(), whole).otherwise(F.lit(""))
    else:
        full = whole
    return F.concat(full, sections)


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def fix_context(hunks: DataFrame, files: DataFrame, module_displays: DataFrame, limit: int = FILE_RANGE_LIMIT):
    """Context of a patch per instance (PCH-5, JN-6, JN-8).

    ``hunks(instance_id, path, src_start, src_len, hunk_no)`` of modified
    ``.py`` files; ``files(instance_id, filename, content)``;
    ``module_displays(instance_id, filename, display_level, display)``
    numbered.  Per file: an overview (moderate, else signature when over the
    limit, else nothing) and each hunk's source lines padded by 10, numbered.
    Returns ``(context, unmatched)``: paths not found among the files are
    reported, not dropped silently.
    """
    fl = files.select("instance_id", F.col("filename").alias("path"), F.split("content", "\n").alias("_lines"))
    md = module_displays.where(F.col("display_level").isin("moderate", "signature")).groupBy("instance_id", "filename").agg(
        F.max(F.when(F.col("display_level") == "moderate", F.col("display"))).alias("_mod"),
        F.max(F.when(F.col("display_level") == "signature", F.col("display"))).alias("_sig"))
    md = md.withColumnRenamed("filename", "path")
    unmatched = hunks.select("instance_id", "path").distinct().join(shuffled(fl), ["instance_id", "path"], "left_anti")
    h = shuffled(hunks).join(fl, ["instance_id", "path"])
    start0 = F.col("src_start") - 1
    lo = F.greatest(F.lit(0), start0 - LOOKUP_PAD)
    hi = F.least(F.size("_lines"), start0 + F.col("src_len") + LOOKUP_PAD)
    sub = range_text(F.col("_lines"), lo, hi)
    block = F.concat(F.lit("=======\nRelevant section of "), F.col("path"), F.lit(":\n"), sub, F.lit("\n======="))
    per_hunk = h.select("instance_id", "path", "hunk_no", block.alias("block"))
    from quarry.operators.pages import ordered_text
    per_file = ordered_text(per_hunk.withColumn("_k", F.struct("path", "hunk_no")).withColumn(
        "_g", F.concat_ws("\u0000", "instance_id", "path")), "_g", "hunk_no", "block")
    per_file = per_file.select(F.split("_g", "\u0000").getItem(0).alias("instance_id"),
                               F.split("_g", "\u0000").getItem(1).alias("path"), F.col("block").alias("_sections"))
    j = shuffled(per_file).join(shuffled(md), ["instance_id", "path"], "left")
    summary = (F.when(F.length("_mod") <= limit, F.col("_mod"))
               .when(F.length("_sig") <= limit, F.col("_sig")))
    overview = F.when(summary.isNull(), F.lit("")).otherwise(
        _strip(F.concat(F.lit("Overview of "), F.col("path"), F.lit(":\n"), summary)))
    ftext = F.concat(F.lit("\n=====================\n"), overview, F.lit("\n"), F.col("_sections"),
                     F.lit("\n=====================\n"))
    ctx = ordered_text(j.select("instance_id", "path", ftext.alias("ftext")), "instance_id", "path", "ftext")
    return ctx.withColumnRenamed("ftext", "context"), unmatched


def test_patch_text(test_patch: Column) -> Column:
    """Test-patch context, or the fixed sentence when the test patch is missing (PCH-9)."""
    body = _strip(F.concat(F.lit("Here the test patch for the issue:\n\n"), test_patch))
    return F.when(test_patch.isNull(), F.lit(NO_TESTS_TEXT)).otherwise(body)
