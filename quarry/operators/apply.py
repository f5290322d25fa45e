"""Applying patches to files: is a patch acceptable, and what strict text stands for it (PCH-7, PCH-8, JN-9).

``accepted_patches`` follows three steps for each patch:

1. *relaxed*: every hunk finds its old lines in the file, at the stated line or, failing
   that, at the nearest other place (forward first); blanks at line ends do not count
   and are taken off added lines; a hunk may come without context;
2. *strict*: the change that results is written anew as a diff with three lines of
   context and no blanks to mend, without a last line feed, which is no complete line;
3. *strict with a line feed*: the same text with it.

A patch is accepted as a whole or not at all.  Patches are read row by row in Arrow
batches; their hunks meet the file's lines in one join, one row a (patch, file), where
their places are found and the lines are spliced.  Rows that share an id are read as one
patch, by the window parser.

Limits: a file is taken to end with a line feed; of the white-space repairs only blanks
at line ends are made; the new text carries no ``index`` line and no section names.  An
added file must not exist yet and is no part of the strict text, which names tracked files only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.linediff import edit_blocks, header, hunks_of
from quarry.operators.patches import DEV_NULL, HUNK_RE, clean_path, collapse_blank_before_hunks, parse_patches
from quarry.session import broadcast_if_small, ship_package, shuffled, write_table

CONTEXT = 3
#: Rows that a task holds as Python values at once.
ROWS_AT_ONCE = 256
VARIANTS = ["default", "minimal", "default_no_blank", "minimal_no_blank"]
LINE_END_BLANKS = r"[ \t\r]+$"


def sound_patches(parsed: DataFrame, id_col: str = "patch_id") -> DataFrame:
    """``(id)`` of the patches that can be read to the end: at least one hunk, all counts used up exactly.

    Each ``@@`` line follows its file header or the hunk before it without a gap, each
    hunk changes something, body lines start with a blank, ``+``, ``-`` or ``\\``, and
    the last one has its line feed.
    """
    w = Window.partitionBy(id_col).orderBy("pos")
    is_hdr, marker = F.col("is_hdr"), F.col("marker")
    follows = F.lag(F.col("is_tgt_hdr") | F.col("is_body") | F.col("line").startswith("\\")).over(w)
    rows = parsed.withColumn("_follows", F.coalesce(follows, F.lit(False)))
    hunks = rows.groupBy(id_col, "hunk_no").agg(
        F.bool_or(is_hdr & F.col("_follows") & F.col("source_file").isNotNull() & F.col("target_file").isNotNull()).alias("_headed"),
        (F.max(F.when(is_hdr, F.col("src_len"))) == F.count_if(marker.isin(" ", "-"))).alias("_old"),
        (F.max(F.when(is_hdr, F.col("tgt_len"))) == F.count_if(marker.isin(" ", "+"))).alias("_new"),
        F.bool_or(F.coalesce(marker.isin("+", "-"), F.lit(False))).alias("_changed"),
        F.bool_and(F.coalesce(marker.isin(" ", "+", "-", "\\"), F.lit(True))).alias("_marked"),
        F.max(F.struct("pos", "is_body")).alias("_last"))
    whole = F.col("_headed") & F.col("_old") & F.col("_new") & F.col("_changed") & F.col("_marked")
    return (hunks.groupBy(id_col).agg(F.bool_and((F.col("hunk_no") == 0) | whole).alias("_whole"), F.max("hunk_no").alias("_n"), F.max("_last").alias("_l"))
            .where("_whole AND _n > 0 AND NOT _l.is_body").select(id_col))


def _hunks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hunk: its file, stated lines and its body in order."""
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_body") & F.col("marker").isin(" ", "+", "-"), F.struct("pos", "marker", "value")))),
                       lambda x: F.struct(x["marker"].alias("marker"), x["value"].alias("value")))
    return parsed.where("hunk_no > 0").groupBy(*keys, "hunk_no").agg(
        F.min(F.when(F.col("is_hdr"), F.col("pos"))).alias("pos"),
        *[F.max(F.when(F.col("is_hdr"), F.col(c))).alias(c) for c in ("file_no", "src_start", "src_len", "tgt_start", "tgt_len", "source_file", "target_file")],
        body.alias("body"))


def hunk_places(lines: list[str], old: list[str]) -> list[int]:
    """0-based lines at which a file's ``lines`` hold the old lines of a hunk; both without blanks at line ends."""
    n = len(old)
    return [k for k in range(len(lines) - n + 1) if lines[k] == old[0] and lines[k:k + n] == old] if n else []


def _place(done: list[tuple[int, int, int]], hunk: dict, n: int) -> int | None:
    """0-based line of the file at which a hunk goes, after the hunks ``done`` (at, old length, new length)."""
    size = sum(b["marker"] != "+" for b in hunk["body"])
    total = n + sum(new - old for _, old, new in done)
    stated = min(max(hunk["tgt_start"] - 1, 0), total)
    if not size:  # nothing to find: the stated line, in the file's own count
        shift = 0
        for at, old, new in done:
            if at + shift + new <= stated:
                shift += new - old
            elif at + shift < stated:
                return None
        return stated - shift
    best = None
    for at in hunk["places"] or ():
        if any(at < d + old and d < at + size for d, old, _ in done):
            continue
        now = at + sum(new - old for d, old, new in done if d + old <= at)
        if hunk["src_start"] == 0 and now != 0:
            continue
        key = (abs(now - stated), now < stated, at)
        best = min(best or key, key)
    return best[2] if best else None


def splice(lines: list[str], hunks: list[dict]) -> list[tuple[int, int, list[str]]] | None:
    """The edits ``(from, to, lines put there)`` that the hunks make of a file, or None where one has no place.

    Lines both taken out and put back are no edit.
    """
    done: list[tuple[int, int, int]] = []
    edits = []
    for hunk in hunks:
        at = _place(done, hunk, len(lines))
        if at is None:
            return None
        want = [b["value"] for b in hunk["body"] if b["marker"] != "+"]
        old = lines[at:at + len(want)]
        exact = old == want
        if not exact and [x.rstrip(" \t\r") for x in old] != [x.rstrip(" \t\r") for x in want]:  # hashes met by chance
            return None
        new = [b["value"] if b["marker"] == " " and exact else b["value"].rstrip(" \t\r") for b in hunk["body"] if b["marker"] != "-"]
        done = sorted([*done, (at, len(want), len(new))])
        edits += [(at + i0, at + i1, new[j0:j1]) for i0, i1, j0, j1 in edit_blocks(old, new)]
    out: list[tuple[int, int, list[str]]] = []
    for i0, i1, put in sorted(edits, key=lambda e: e[:2]):
        if out and out[-1][1] == i0:  # two hunks that touch
            out[-1] = (out[-1][0], i1, out[-1][2] + put)
        else:
            out.append((i0, i1, put))
    return out


#: A hunk as it moves to its file: the body's lines, with their marks, in one text.
_HUNK = "struct<hunk_no:bigint,src_start:bigint,tgt_start:bigint,body:string>"


def _rstripped(lines: list[str]) -> list[str]:
    return [x if x is None else x.rstrip(" \t\r") for x in lines]


def _strict_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, file_no, fits, text)`` from ``(keys, file_no, path, kind, lines, hunks)``; the text of a file that keeps its lines is empty."""
    key_types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def one(kind, path, lines, hunks):
        if kind == "added":
            return lines is None, ""
        if lines is not None:
            bare = _rstripped(lines)
            hunks = [h | {"body": [{"marker": x[0], "value": x[1:]} for x in h["body"].split("\n")]} for h in hunks]
            hunks = [h | {"places": hunk_places(bare, _rstripped([b["value"] for b in h["body"] if b["marker"] != "+"]))} for h in hunks]
        edits = None if lines is None else splice(lines, hunks)
        if edits is None or kind == "removed" and edits != [(0, len(lines), [])]:
            return False, ""
        parts = hunks_of(lines, edits, CONTEXT)
        if not parts:
            return True, ""
        head = [f"diff --git a/{path} b/{path}", *(["deleted file mode 100644"] if kind == "removed" else []), f"--- a/{path}",
                "+++ /dev/null" if kind == "removed" else f"+++ b/{path}"]
        body = [x for h in parts for x in (header(h["old"], h["new"], h["lines"]), *h["lines"])]
        return True, "\n".join(head + body)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(k, ROWS_AT_ONCE)
                no, path, kind, lines, hunks = (some.column(c) for c in ("file_no", "path", "kind", "lines", "hunks"))
                got = [one(*r) for r in zip(kind.to_pylist(), path.to_pylist(), lines.to_pylist(), hunks.to_pylist())]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keys], no, pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string())],
                                                 names=[*keys, "file_no", "fits", "text"])

    ship_package(rows.sparkSession)
    return rows.select(*keys, "file_no", "path", "kind", "lines", "hunks").mapInArrow(run, f"{key_types}, file_no long, fits boolean, text string")


_HEAD = re.compile(HUNK_RE.replace(r"\d", "[0-9]"))


def read_patch(patch: str | None) -> tuple[list[dict], list[tuple[int, str]], bool]:
    """The hunks of one patch, its other lines by position, and whether it is sound (:func:`sound_patches`).

    The rules are those of :func:`quarry.operators.patches.parse_patches`, for a text that is alone under its id.
    """
    lines = (patch or "").split("\n")
    hunks: list[dict] = []
    other: list[tuple[int, str]] = []
    source = target = now = None
    file_no, follows, body = 0, False, False
    for pos, line in enumerate(lines):
        mark, ended = line[:1], not line and pos == len(lines) - 1
        head = _HEAD.match(line) if mark == "@" else None
        if head:
            at, n, to, m = head.groups()
            now = {"hunk_no": len(hunks) + 1, "pos": pos, "file_no": file_no, "src_start": int(at), "src_len": 1 if n is None else int(n), "tgt_start": int(to),
                   "tgt_len": 1 if m is None else int(m), "source_file": source, "target_file": target, "body": [],
                   "headed": follows and source is not None and target is not None, "marked": True}
            old_left, new_left = now["src_len"], now["tgt_len"]
            hunks.append(now)
            body = follows = False
            continue
        body = now is not None and not ended and (old_left > 0 or new_left > 0)
        if now is not None and not ended:
            old_left -= mark in (" ", "-", "")
            new_left -= mark in (" ", "+", "")
        if body:
            if mark in ("", " ", "+", "-"):
                now["body"].append((mark or " ", line[1:]))
            elif mark != "\\":
                now["marked"] = False
        else:
            other.append((pos, line))
            if line.startswith("--- "):
                file_no, source, target = file_no + 1, line[4:].split("\t", 1)[0], None
            elif line.startswith("+++ "):
                target = line[4:].split("\t", 1)[0]
        follows = body or line.startswith(("+++ ", "\\"))

    def whole(h):
        marks = [mark for mark, _ in h["body"]]
        plus, minus = marks.count("+"), marks.count("-")
        return h["headed"] and h["marked"] and plus + minus > 0 and h["src_len"] == len(marks) - plus and h["tgt_len"] == len(marks) - minus

    return hunks, other, bool(hunks) and not body and all(map(whole, hunks))


def touched_files(hunks: list[dict]) -> list[tuple]:
    """``(file_no, path, kind, hunks)`` for each path that the hunks name."""
    files: dict[str, list] = {}
    for h in hunks:
        added, removed = h["source_file"] == DEV_NULL, h["target_file"] == DEV_NULL
        path = re.sub("^b/", "", h["target_file"]) if added else re.sub("^a/", "", h["source_file"])
        files.setdefault(path, []).append(("added" if added else "removed" if removed else "modified", h))
    return [(min(h["file_no"] for _, h in found), path, min(kind for kind, _ in found),
             [{"hunk_no": h["hunk_no"], "src_start": h["src_start"], "tgt_start": h["tgt_start"], "body": "\n".join(mark + value for mark, value in h["body"])} for _, h in found])
            for path, found in files.items()]


def _files_of_rows(patches: DataFrame, keys: list[str], patch_col: str) -> DataFrame:
    """``(keys, file_no, path, kind, hunks)`` of the sound patches, each alone under its id: read row by row, nothing is moved."""
    schema = T.StructType([*[patches.schema[c] for c in keys], *T.StructType.fromDDL(f"file_no long, path string, kind string, hunks array<{_HUNK}>").fields])
    hunk = pa.struct([("hunk_no", pa.int64()), ("src_start", pa.int64()), ("tgt_start", pa.int64()), ("body", pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(k, ROWS_AT_ONCE)
                at, got = [], []
                for i, text in enumerate(some.column(len(keys)).to_pylist()):
                    hunks, _, sound = read_patch(text)
                    found = touched_files(hunks) if sound else []
                    got += found
                    at += [i] * len(found)
                columns = [list(c) for c in zip(*got)] or [[]] * 4
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(at, pa.int64())) for c in range(len(keys))], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                                                  pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(hunk))], names=schema.names)

    ship_package(patches.sparkSession)
    return patches.select(*keys, patch_col).mapInArrow(run, schema)


def _files_of_shared(patches: DataFrame, id_col: str, keys: list[str], patch_col: str) -> DataFrame:
    """The same for rows that share their ids: the rows of an id are read as one patch."""
    moved = patches.select(*keys, patch_col).repartition(id_col)
    parsed = parse_patches(moved, id_col, patch_col, keep=tuple(c for c in keys if c != id_col))
    sound = parsed.join(sound_patches(parsed, id_col), id_col, "left_semi")
    removed, added = F.col("target_file") == DEV_NULL, F.col("source_file") == DEV_NULL
    hunks = _hunks(sound, keys).select(
        *keys, "hunk_no", "file_no", "src_start", "tgt_start", "body", F.when(added, "added").when(removed, "removed").otherwise("modified").alias("kind"),
        F.when(added, F.regexp_replace("target_file", "^b/", "")).otherwise(clean_path(F.col("source_file"))).alias("path"))
    body = F.array_join(F.transform("body", lambda b: F.concat(b["marker"], b["value"])), "\n")
    return hunks.groupBy(*keys, "path").agg(
        F.min("file_no").cast("long").alias("file_no"), F.min("kind").alias("kind"),
        F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("hunk_no", "src_start", "tgt_start")], body.alias("body")).cast(_HUNK))).alias("hunks")
    ).select(*keys, "file_no", "path", "kind", "hunks")


#: Patches below which only the files that they touch are gathered.
FEW_PATCHES = 20_000


def _counted(patches: DataFrame, id_col: str) -> tuple[int, DataFrame | None]:
    """The number of rows, and the ids that several rows share (None where there are none); reads the ids only."""
    ids = patches.select(id_col).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    n, shared = ids.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count_if(F.col("_rows") > 1)).first()
    return n, write_table(ids.where("_rows > 1").select(id_col), "shared_ids") if shared else None


def accepted_patches(patches: DataFrame, file_lines: DataFrame, id_col: str = "patch_id", patch_col: str = "patch",
                     instance_col: str | None = None, group_col: str | None = None, counted: tuple[int, DataFrame | None] | None = None) -> DataFrame:
    """``(id, accepted)`` for every patch: the strict text, or NULL where the patch is not acceptable.

    ``file_lines(path, line_no, line)``, 1-based; with ``instance_col`` (a column of
    both sides) a path means a file of the patch's own instance.  With ``group_col`` the accepted
    patches only, as ``(group, id, accepted)``, the rows of a group in one partition.
    ``counted``: what :func:`_counted` says of the ids, where the caller knows it.
    """
    own = [instance_col] if instance_col else []
    keys = [id_col, *([group_col] if group_col else []), *own]
    n, shared = counted or _counted(patches, id_col)
    rows = patches.select(*keys, patch_col).where(F.col(id_col).isNotNull())
    if shared is None:
        per_file = _files_of_rows(rows, keys, patch_col)
    else:
        shared = broadcast_if_small(shared)
        per_file = _files_of_rows(rows.join(shared, id_col, "left_anti"), keys, patch_col).unionByName(
            _files_of_shared(rows.join(shared, id_col, "left_semi"), id_col, keys, patch_col))
    if n <= FEW_PATCHES:
        per_file = write_table(per_file, "patch_hunks")
        file_lines = file_lines.join(broadcast_if_small(per_file.select(*own, "path").distinct()), [*own, "path"], "left_semi")
    # the lines that lie together are gathered before they move: one row a file
    files = file_lines.groupBy(*own, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    done = _strict_files(shuffled(per_file).join(files, [*own, "path"], "left"), keys[:2] if group_col else [id_col])
    if group_col:
        done = done.repartition(group_col)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("file_no", "text")))), lambda x: x["text"]), "\n")
    whole = done.groupBy(*([group_col] if group_col else []), id_col).agg(F.bool_and("fits").alias("_fits"), text.alias("_text")).where("_fits AND _text != ''")
    # without its last line feed the strict text is cut short (step 2), with it it stands for itself (step 3)
    whole = whole.select(*([group_col] if group_col else []), id_col, F.concat("_text", F.lit("\n")).alias("accepted"))
    return whole if group_col else patches.select(id_col).join(whole, id_col, "left")


def _minimal_hunk(src: int, src_len: int, tgt: int, tgt_len: int, body: list[tuple[str, str]]) -> str:
    """A hunk's text without context, split where lines stay; empty where it changes nothing."""
    old, new = ([value for marker, value in body if marker != mark] for mark in "+-")
    out = []
    for i0, i1, j0, j1 in edit_blocks(old, new):
        lines = ["-" + x for x in old[i0:i1]] + ["+" + x for x in new[j0:j1]]
        # a stated empty range names the line before it
        out += [header(src - bool(src_len) + i0, tgt - bool(tgt_len) + j0, lines), *lines]
    return "\n".join(out)


def minimal_text(patch: str | None) -> str:
    """What :func:`minimal_patches` makes of a patch that is alone under its id."""
    hunks, other, _ = read_patch(patch)
    pieces = [(h["pos"], _minimal_hunk(h["src_start"], h["src_len"], h["tgt_start"], h["tgt_len"], h["body"])) for h in hunks]
    return "\n".join(x for _, x in sorted([*other, *[p for p in pieces if p[1]]]))


def minimal_patches(parsed: DataFrame, id_col: str = "patch_id") -> DataFrame:
    """``(id, patch)``: hunks without context, split where lines stay; lines both removed and added again stay too (PCH-7).

    Each hunk is aligned by a longest common subsequence of its old and new lines.  A
    hunk that changes nothing is dropped; all other lines are kept in order.
    """
    hunks = _hunks(parsed, [id_col]).select(id_col, "pos", "src_start", "src_len", "tgt_start", "tgt_len", "body")
    id_type = parsed.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.slice().to_pylist()
            texts = [_minimal_hunk(r["src_start"], r["src_len"], r["tgt_start"], r["tgt_len"], [(b["marker"], b["value"]) for b in r["body"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(texts, pa.string())], names=[id_col, "pos", "_t"])

    ship_package(parsed.sparkSession)
    pieces = hunks.mapInArrow(run, f"{id_col} {id_type}, pos int, _t string").where("_t != ''")
    other = parsed.where(~F.col("is_body") & ~F.col("is_hdr")).select(id_col, F.col("pos").cast("int").alias("pos"), F.col("line").alias("_t"))
    lines = other.unionByName(pieces).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "_t"))).alias("_l"))
    return lines.select(id_col, F.array_join(F.transform("_l", lambda x: x["_t"]), "\n").alias("patch"))


def variant_texts(patch: str | None) -> list[tuple[int, str]]:
    """``(number, text)`` of the variants of a patch; one that equals an earlier variant is none."""
    minimal = minimal_text(patch)
    texts = [patch, minimal, patch and _collapsed(patch), _collapsed(minimal)]
    return [(k, x) for k, x in enumerate(texts) if x is not None and texts.index(x) == k]


def _collapsed(text: str) -> str:
    """:func:`collapse_blank_before_hunks` of one text."""
    return re.sub(r"\n{2,}@@", "\n@@", text)


def _variants_of_rows(base: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _ord, patch)``: the variants of each row's text, beside each other, of patches that are alone under their ids."""
    schema = T.StructType([*[base.schema[c] for c in keys], T.StructField("_ord", T.IntegerType()), T.StructField("patch", T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(k, ROWS_AT_ONCE)
                got = [(i, *v) for i, text in enumerate(some.column(len(keys)).to_pylist()) for v in variant_texts(text)]
                at = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(at) for c in range(len(keys))], pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
                                                 names=schema.names)

    ship_package(base.sparkSession)
    return base.select(*keys, "_p").mapInArrow(run, schema)


def _variants_of_shared(base: DataFrame, id_col: str, own: list[str]) -> DataFrame:
    """The same for rows that share their ids: these are read as one patch, variant by variant, and keep all of theirs."""
    moved = base.select(id_col, F.col("_p").alias("patch")).repartition(id_col)
    minimal = minimal_patches(parse_patches(moved, id_col, "patch"), id_col).withColumnRenamed("patch", "_m")
    both = base.join(minimal, id_col, "left").withColumn("_m", F.coalesce("_m", F.lit("")))
    texts = F.array(F.col("_p"), F.col("_m"), collapse_blank_before_hunks(F.col("_p")), collapse_blank_before_hunks(F.col("_m")))
    return both.select(id_col, *own, texts.alias("_texts")).select(id_col, *own, F.posexplode("_texts").alias("_ord", "patch"))


def first_valid_variant(patches: DataFrame, file_lines: DataFrame, id_col: str = "patch_id", patch_col: str = "patch",
                        instance_col: str | None = None) -> DataFrame:
    """``(id, variant, valid_patch)``: the first variant that is accepted, with the accepted text; NULLs when none is.

    Variants, in order: as it stands, minimal hunks, and both without blank lines
    before ``@@``.  All variants of all patches are checked in one plan (a variant is a row, and
    one that equals an earlier variant of its patch is none).

    Patches become variants, and these hunks, row by row; texts move to their files and,
    as accepted texts, back to their ids.
    """
    own = [instance_col] if instance_col else []
    base = patches.select(id_col, *own, F.col(patch_col).alias("_p")).where(F.col(id_col).isNotNull())
    n, shared = _counted(patches, id_col)
    if shared is None:
        tries = _variants_of_rows(base, [id_col, *own])
    else:
        few = broadcast_if_small(shared)
        tries = _variants_of_rows(base.join(few, id_col, "left_anti"), [id_col, *own]).unionByName(_variants_of_shared(base.join(few, id_col, "left_semi"), id_col, own))
        shared = shared.crossJoin(patches.sparkSession.range(len(VARIANTS)).select(F.col("id").alias("_ord")))
        shared = shared.select(_variant_id(id_col).alias("_vid"))
    tries = tries.withColumn("_vid", _variant_id(id_col))
    accepted = accepted_patches(tries.select("_vid", id_col, *own, "patch"), file_lines, "_vid", "patch", instance_col, id_col, (n, shared))
    number = F.substring_index("_vid", "#", -1).cast("int")
    best = accepted.groupBy(id_col).agg(F.min_by(F.struct(number.alias("_ord"), "accepted"), number).alias("_b"))
    names = F.array(*[F.lit(x) for x in VARIANTS])
    return patches.select(id_col).join(best, id_col, "left").select(
        id_col, F.when(F.col("_b").isNotNull(), F.get(names, F.col("_b._ord"))).alias("variant"), F.col("_b.accepted").alias("valid_patch"))


def _variant_id(id_col: str) -> Column:
    return F.concat_ws("#", F.col(id_col).cast("string"), F.col("_ord").cast("string"))
