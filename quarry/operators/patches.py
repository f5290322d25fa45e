"""Unified diffs as DataFrames (PCH-1..PCH-9, AGG-1, JN-6, JN-9).

``parse_patches`` turns ``(patch_id, patch)`` rows into one row per diff
line, classified with window functions over the line position:

* ``hunk_no`` — running count of ``@@`` headers; a header's omitted length
  is 1;
* a line is **body** iff, before it, the hunk has consumed fewer old lines
  than the header's old length *or* fewer new lines than its new length.
  Consumption is a running count, so ``--- x`` / ``+++ x`` inside a hunk is
  a removed / added line, exactly as a count-driven parser sees it;
* file headers are the non-body ``--- `` / ``+++ `` lines; the current file
  of every row is ``last(header, ignoreNulls)``.

All windows share one spec (``partitionBy(patch_id).orderBy(pos)``), so the
lines are shuffled and sorted once; the per-patch aggregates that follow
reuse that partitioning (no second exchange).  One patch is one input row,
so its lines stay in one task — a group bounded by a single text value.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quarry.session import ship_package

HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
DEV_NULL = "/dev/null"
# Added-line prefixes that count as imports; context padding.
IMPORT_PREFIXES = ["import ", "from "]
CONTEXT_PAD = 10


def _len_group(line: Column, i: int) -> Column:
    g = F.regexp_extract(line, HUNK_RE, i)
    return F.when(g == "", F.lit(1)).otherwise(g.cast("long"))


def _path(line: Column) -> Column:
    """Path of a ``--- ``/``+++ `` header, cut at a tab (timestamp)."""
    return F.regexp_extract(line, r"^(?:---|\+\+\+) ([^\t]*)", 1)


def parse_patches(patches: DataFrame, id_col: str = "patch_id", patch_col: str = "patch",
                  keep: tuple = (), colocated_by: str | None = None) -> DataFrame:
    """One row per diff line with hunk / file context and a body flag.

    Columns: ``id, pos, line, marker, value, is_hdr, is_body, hunk_no,
    file_no, src_start, src_len, tgt_start, tgt_len, source_file,
    target_file, is_src_hdr, is_tgt_hdr``.  ``colocated_by``: a column the
    patches are already hash partitioned by (constant per patch); the windows
    partition by it too, so the exploded lines are not shuffled again.
    """
    if colocated_by and colocated_by not in keep:
        keep = (colocated_by,) + tuple(keep)
    # the text is split below the generator: what stands beside it would be computed again for every line
    split = patches.select(id_col, *keep, F.split(F.coalesce(F.col(patch_col), F.lit("")), "\n").alias("_lines"))
    split = split.select(id_col, *keep, "_lines", F.size("_lines").alias("_n"))
    # a text has one line at least; the outer form keeps Spark from a filter on its size, which would run the text's own expression again
    lines = split.select(id_col, *keep, "_n", F.posexplode_outer("_lines").alias("pos", "line"))
    w = Window.partitionBy(*([colocated_by] if colocated_by else []), id_col).orderBy("pos")
    line = F.col("line")
    marker = F.substring(line, 1, 1)
    is_hdr = line.rlike(HUNK_RE)
    # an empty line is an empty context line, but what follows the final line feed is no line
    after_end = (line == "") & (F.col("pos") == F.col("_n") - 1)
    own_old = F.when(marker.isin(" ", "-") | ((line == "") & ~after_end), 1).otherwise(0)
    own_new = F.when(marker.isin(" ", "+") | ((line == "") & ~after_end), 1).otherwise(0)
    p1 = lines.select(
        "*",
        is_hdr.alias("is_hdr"),
        own_old.alias("own_old"), own_new.alias("own_new"),
        F.sum(is_hdr.cast("int")).over(w).alias("hunk_no"),
        F.sum(own_old).over(w).alias("cum_old"),
        F.sum(own_new).over(w).alias("cum_new"),
        F.when(is_hdr, F.regexp_extract(line, HUNK_RE, 1).cast("long")).alias("h_src_start"),
        F.when(is_hdr, _len_group(line, 2)).alias("h_src_len"),
        F.when(is_hdr, F.regexp_extract(line, HUNK_RE, 3).cast("long")).alias("h_tgt_start"),
        F.when(is_hdr, _len_group(line, 4)).alias("h_tgt_len"),
    )
    hdr = F.col("is_hdr")
    p2 = p1.select(
        "*",
        F.last(F.when(hdr, F.col("cum_old")), True).over(w).alias("_base_old"),
        F.last(F.when(hdr, F.col("cum_new")), True).over(w).alias("_base_new"),
        F.last("h_src_start", True).over(w).alias("src_start"),
        F.last("h_src_len", True).over(w).alias("src_len"),
        F.last("h_tgt_start", True).over(w).alias("tgt_start"),
        F.last("h_tgt_len", True).over(w).alias("tgt_len"),
    )
    used_old = F.col("cum_old") - F.col("own_old") - F.col("_base_old")
    used_new = F.col("cum_new") - F.col("own_new") - F.col("_base_new")
    is_body = ((F.col("hunk_no") > 0) & ~hdr & ~after_end & ((used_old < F.col("src_len")) | (used_new < F.col("tgt_len"))))
    p2 = p2.withColumn("is_body", F.coalesce(is_body, F.lit(False)))
    body = F.col("is_body")
    is_src = ~body & ~hdr & line.startswith("--- ")
    is_tgt = ~body & ~hdr & line.startswith("+++ ")
    p3 = p2.select(
        "*",
        is_src.alias("is_src_hdr"),
        is_tgt.alias("is_tgt_hdr"),
        F.sum(is_src.cast("int")).over(w).alias("file_no"),
        F.last(F.when(is_src, _path(line)), True).over(w).alias("source_file"),
        # a new source line ends the target before it
        F.last(F.when(is_src | is_tgt, F.struct(F.when(is_tgt, _path(line)).alias("path"))), True).over(w)["path"].alias("target_file"),
    )
    return p3.select(
        id_col, *keep, "pos", "line",
        F.when(body, F.when(line == "", F.lit(" ")).otherwise(marker)).alias("marker"),
        F.when(body, F.substring(line, 2, 1 << 30)).alias("value"),
        "is_hdr", "is_body", "hunk_no", "file_no", "src_start", "src_len", "tgt_start", "tgt_len",
        "source_file", "target_file", "is_src_hdr", "is_tgt_hdr",
    )


def parse_status(parsed: DataFrame, id_col: str = "patch_id", colocated_by: str | None = None) -> DataFrame:
    """``(id, parse_ok)``: every hunk stands under a file header and uses its counts up exactly (PCH-1).

    A text without a hunk (empty, NULL or no diff at all) parses, to no files.
    """
    keys = ([colocated_by] if colocated_by else []) + [id_col]
    hunks = parsed.groupBy(*keys, "hunk_no").agg(
        F.max(F.when(F.col("is_hdr"), F.col("src_len"))).alias("_s"), F.max(F.when(F.col("is_hdr"), F.col("tgt_len"))).alias("_t"),
        F.count_if(F.col("is_body") & F.col("marker").isin(" ", "-")).alias("_old"),
        F.count_if(F.col("is_body") & F.col("marker").isin(" ", "+")).alias("_new"),
        F.bool_and(F.when(F.col("is_hdr"), F.col("source_file").isNotNull() & F.col("target_file").isNotNull())).alias("_headed"))
    sound = F.when(F.col("hunk_no") > 0, (F.col("_s") == F.col("_old")) & (F.col("_t") == F.col("_new")) & F.coalesce("_headed", F.lit(False)))
    return hunks.groupBy(*keys).agg(F.coalesce(F.bool_and(sound), F.lit(True)).alias("parse_ok"))


def is_modified(source_file: Column, target_file: Column) -> Column:
    """Neither side is ``/dev/null`` (PCH-2; see :func:`empty_range` for the other sign of an added or removed file)."""
    return (source_file != DEV_NULL) & (target_file != DEV_NULL)


def empty_range() -> Column:
    """A hunk that starts at ``-0,0`` or ``+0,0``: as the only one of a file it adds or removes the file (PCH-2)."""
    return ((F.col("src_start") == 0) & (F.col("src_len") == 0)) | ((F.col("tgt_start") == 0) & (F.col("tgt_len") == 0))


def clean_path(source_file: Column) -> Column:
    """Drop a leading ``a/`` (PCH-3)."""
    return F.regexp_replace(source_file, r"^a/", "")


def _whole_files(rows: DataFrame, id_col: str, colocated_by: str | None) -> DataFrame:
    """``modified`` for rows that carry ``is_hdr``, ranges and files: decided on all hunks of the (patch, file)."""
    w = Window.partitionBy(*([colocated_by] if colocated_by else []), id_col, "file_no")
    alone = (F.count_if("is_hdr").over(w) == 1) & (F.count_if(F.col("is_hdr") & empty_range()).over(w) == 1)
    return rows.withColumn("modified", is_modified(F.col("source_file"), F.col("target_file")) & ~alone)


def patch_files(parsed: DataFrame, id_col: str = "patch_id", colocated_by: str | None = None) -> DataFrame:
    """One row per file of each patch (taken at its ``+++`` line, where both paths are known)."""
    rows = _whole_files(parsed.where("is_tgt_hdr OR is_hdr"), id_col, colocated_by)
    return rows.where("is_tgt_hdr").select(id_col, "file_no", "source_file", "target_file", clean_path(F.col("source_file")).alias("path"), "modified")


def patch_hunks(parsed: DataFrame, id_col: str = "patch_id", colocated_by: str | None = None) -> DataFrame:
    """One row per hunk: source range ``[src_start, src_start + src_len)`` (PCH-4)."""
    return (_whole_files(parsed.where("is_hdr"), id_col, colocated_by)
            .select(id_col, "file_no", "hunk_no", clean_path(F.col("source_file")).alias("path"),
                    "src_start", "src_len", "tgt_start", "tgt_len",
                    (F.col("src_start") + F.col("src_len")).alias("src_end"), "modified"))


def patch_stats(parsed: DataFrame, id_col: str = "patch_id", code_only: bool = True,
                colocated_by: str | None = None, skip_unparsable: bool = True) -> DataFrame:
    """Per patch: files, edits (hunks), changed lines, added import lines (AGG-1).

    Only modified files count, and only ``.py`` ones when ``code_only``.
    A patch keeps a row (zeros when nothing qualifies) unless it does not parse
    (:func:`parse_status`); ``skip_unparsable=False`` keeps those too.

    Lines are counted by hunk, hunks by file, files by patch, all in the partitioning
    of the lines; whether the patch parses comes out of the same counts.
    """
    keys = ([colocated_by] if colocated_by else []) + [id_col]
    named = is_modified(F.col("source_file"), F.col("target_file"))
    if code_only:
        named = named & F.col("source_file").endswith(".py")
    named = F.coalesce(named, F.lit(False))
    is_hdr, marker = F.col("is_hdr"), F.col("marker")
    imported = F.lit(False)
    for p in IMPORT_PREFIXES:
        imported = imported | F.col("value").startswith(p)
    hunks = parsed.groupBy(*keys, "file_no", "hunk_no").agg(
        F.count_if(named & F.col("is_tgt_hdr")).alias("_files"), F.count_if(named & is_hdr).alias("_edits"),
        F.count_if(named & marker.isin("+", "-")).alias("_lines"), F.count_if(named & (marker == "+") & imported).alias("_imports"),
        F.count_if(is_hdr).alias("_hunks"), F.count_if(is_hdr & empty_range()).alias("_empty"),
        F.max(F.when(is_hdr, F.col("src_len"))).alias("_s"), F.max(F.when(is_hdr, F.col("tgt_len"))).alias("_t"),
        F.count_if(marker.isin(" ", "-")).alias("_old"), F.count_if(marker.isin(" ", "+")).alias("_new"),
        F.bool_and(F.when(is_hdr, F.col("source_file").isNotNull() & F.col("target_file").isNotNull())).alias("_headed"))
    sound = (F.col("_hunks") == 0) | ((F.col("_s") == F.col("_old")) & (F.col("_t") == F.col("_new")) & F.col("_headed"))
    names = ["files", "edits", "lines", "imports"]
    files = hunks.groupBy(*keys, "file_no").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names], F.sum("_hunks").alias("_hunks"), F.sum("_empty").alias("_empty"),
                                                F.bool_and(sound).alias("_sound"))
    counted = ~((F.col("_hunks") == 1) & (F.col("_empty") == 1))
    out = files.groupBy(*keys).agg(*[F.sum(F.when(counted, F.col(f"_{n}")).otherwise(0)).cast("long").alias(f"num_{n}") for n in names], F.bool_and("_sound").alias("_ok"))
    if skip_unparsable:
        out = out.where("_ok")
    return out.select(id_col, "num_files", "num_edits", "num_lines", "num_imports")


def collapse_blank_before_hunks(patch: Column) -> Column:
    """Remove blank lines in front of every ``@@`` (PCH-6); one pass suffices."""
    return F.regexp_replace(patch, r"\n{2,}@@", "\n@@")


def fit_check(parsed: DataFrame, file_lines: DataFrame, id_col: str = "patch_id",
              relaxed: bool = False, instance_col: str | None = None) -> DataFrame:
    """Does every hunk's old side equal the file at the stated lines? (PCH-8, JN-9).

    ``file_lines(path, line_no, line)`` 1-based.  Line ``i`` of a hunk's old
    side (its context and removed lines) must equal file line
    ``src_start + i``; ``relaxed`` compares after ``rtrim``.  Only the files a
    patch touches are read (``left_semi`` on the touched paths).  With
    ``instance_col`` (a column of both sides) a path means a file of the patch's
    own instance.  Returns ``(id, fits)`` for every patch with at least one hunk.
    """
    own = [instance_col] if instance_col else []
    old = parsed.where(F.col("is_body") & F.col("marker").isin(" ", "-"))
    w = Window.partitionBy(id_col, "hunk_no").orderBy("pos")
    old = old.select(id_col, *own, "hunk_no", "value", clean_path(F.col("source_file")).alias("path"),
                     (F.col("src_start") + F.row_number().over(w) - 1).alias("line_no"))
    touched = old.select(*own, "path").distinct()
    fl = file_lines.join(touched, [*own, "path"], "left_semi").select(*own, "path", "line_no", F.col("line").alias("_file_line"))
    j = old.join(fl, [*own, "path", "line_no"], "left")
    a, e = F.col("_file_line"), F.col("value")
    eq = (F.rtrim(a) == F.rtrim(e)) if relaxed else (a == e)
    hunks = parsed.where("is_hdr").select(id_col).distinct()
    per = j.groupBy(id_col).agg(F.bool_and(F.coalesce(eq, F.lit(False))).alias("fits"))
    # a patch whose hunks have no old side (pure additions) fits trivially
    return hunks.join(per, id_col, "left").select(id_col, F.coalesce("fits", F.lit(True)).alias("fits"))


_HUNK_BYTES = re.compile(rb"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@")


def fold_patch(patch: bytes | None, code_only: bool = True) -> tuple[int, int, int, int, bool]:
    """Files, edits, changed lines, imports and whether the text parses: one pass over the lines of one patch.

    It carries what is left of the current hunk, the current file and its counts; these
    join the totals when the next file starts, unless one empty range adds or removes the file.
    """
    lines = (patch or b"").split(b"\n")
    if not lines[-1]:  # what follows the final line feed is no line
        lines.pop()
    imports = tuple(b"+" + p.encode() for p in IMPORT_PREFIXES)
    old_left = new_left = 0
    source, headed, keep, ok = None, False, False, True
    total, now, hunks, empty = [0, 0, 0, 0], [0, 0, 0, 0], 0, 0  # files, edits, lines, imports

    def close():
        if hunks != 1 or empty != 1:
            total[:] = map(sum, zip(total, now))

    for line in lines:
        mark = line[:1]
        head = _HUNK_BYTES.match(line) if mark == b"@" else None
        if head:
            at, n, to, m = head.groups()
            ok = ok and old_left == new_left == 0 and source is not None and headed
            old_left, new_left = 1 if n is None else int(n), 1 if m is None else int(m)
            hunks += 1
            empty += (int(at) == 0 and old_left == 0) or (int(to) == 0 and new_left == 0)
            now[1] += keep
        elif old_left > 0 or new_left > 0:
            if mark == b" " or not mark:
                old_left, new_left = old_left - 1, new_left - 1
            elif mark == b"-":
                old_left -= 1
                now[2] += keep
            elif mark == b"+":
                new_left -= 1
                now[2] += keep
                now[3] += keep and line.startswith(imports)
        elif line.startswith(b"--- "):
            close()
            source, headed, keep = line[4:].split(b"\t", 1)[0], False, False
            now, hunks, empty = [0, 0, 0, 0], 0, 0
        elif line.startswith(b"+++ "):
            null = DEV_NULL.encode()
            keep = source is not None and source != null and line[4:].split(b"\t", 1)[0] != null and (not code_only or source.endswith(b".py"))
            headed = True
            now[0] += keep
    close()
    return (*total, ok and old_left == new_left == 0)


def patch_stats_fold(patches: DataFrame, id_col: str = "patch_id", patch_col: str = "patch",
                     code_only: bool = True, skip_unparsable: bool = True) -> DataFrame:
    """AGG-1 as one fold per patch row (:func:`fold_patch`): no explode, no shuffle, no sort.

    The rules are those of :func:`parse_patches` + :func:`patch_stats`.  Patches are
    folded in Arrow batches; use it when only the per-patch counts are needed, the
    window parser gives line-level rows.
    """
    names = ["num_files", "num_edits", "num_lines", "num_imports"]
    id_field = patches.schema[id_col]

    def run(batches):
        for batch in batches:
            rows = [fold_patch(t, code_only) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([r[4] for r in rows], pa.bool_())], names=[id_col, *names, "_ok"])

    ship_package(patches.sparkSession)
    schema = StructType([id_field, *[StructField(n, LongType()) for n in names], StructField("_ok", BooleanType())])
    out = patches.select(id_col, F.col(patch_col).cast("binary")).mapInArrow(run, schema)
    if skip_unparsable:
        out = out.where("_ok")
    return out.select(id_col, *names)
