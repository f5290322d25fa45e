"""Code elements of Python files (ELM-1..ELM-10, SCH-8..SCH-12, AGG-10).

Split of work:

* **Python, one job** (:func:`extract_elements`, ``mapInPandas``): parse
  each file with the standard ``ast`` module and emit one row per element
  with the line spans of its parts — signature, full text, comments above
  and below.  Files that do not parse come out as one ``raw`` row.
* **Python, a file at a time** (:func:`element_displays`): every display level is
  put together from numbered part texts, a class's and a module's from those of
  their children.  Spark brings a file's spans and its content together before.

Element rules (taken by the extractor): top-level ``def`` / ``class`` /
``import`` / assignment to a name; ``def`` and name assignments directly in
a top-level class.  Nested, conditional and ``async def`` items are not
taken.  The same name twice: every occurrence is a row (module display
shows both); lookups take the last (``max_by`` on ``ord``), and members of
the last class of a name only.
"""

from __future__ import annotations

import ast
from bisect import bisect_left
from functools import cached_property
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship_package, shuffled, spread

# Comment markers skipped in comment runs; display levels.
EXCLUDE_COMMENTS = ["TODO", "FIXME"]
DOCSTRING_TOKENS = ['"""', "'''"]
LEVELS = ["signature", "minimal", "moderate", "full"]
#: Element rows that a task holds in Python before it hands them on; a file's rows stay together.
ROWS_AT_ONCE = 4096

ELEMENT_SCHEMA = T.StructType([
    T.StructField("instance_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("kind", T.StringType()),          # module / raw
    T.StructField("elem_type", T.StringType()),     # module function class method constant import
    T.StructField("elem_name", T.StringType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("parent_ord", T.IntegerType()),   # position of the parent class, -1 at the top
    T.StructField("live", T.BooleanType()),         # False: member of a class that is defined again below
    T.StructField("ord", T.IntegerType()),          # position in the parent's ordering
    T.StructField("start_line", T.IntegerType()),   # 1-based node line
    T.StructField("end_line", T.IntegerType()),
    T.StructField("sig_lo", T.IntegerType()), T.StructField("sig_hi", T.IntegerType()),     # 0-based inclusive
    T.StructField("full_lo", T.IntegerType()), T.StructField("full_hi", T.IntegerType()),
    T.StructField("upper_lo", T.IntegerType()), T.StructField("upper_hi", T.IntegerType()),
    T.StructField("lower_lo", T.IntegerType()), T.StructField("lower_hi", T.IntegerType()),
    T.StructField("n_lines", T.IntegerType()),
])


# ----------------------------------------------------------------------------- Python part
_SOLID, _BLANK, _DECORATOR, _COMMENT, _SKIPPED = range(5)


def _class_of(stripped: str) -> int:
    """Class of a line: blank, decorator, comment, comment with a skipped marker, or solid text."""
    if not stripped:
        return _BLANK
    if stripped[0] == "@":
        return _DECORATOR
    if stripped[0] == "#":
        return _SKIPPED if any(m in stripped for m in EXCLUDE_COMMENTS) else _COMMENT
    return _SOLID


class _Source:
    """A file's lines, classed once; every span of an element is looked up in sorted positions.

    ``dense`` lists the lines that are neither blank nor decorators.  Doc-string
    marks are noted by line: a line *opens* when it starts with a mark, *closes*
    when it ends with one, and is *bare* when it is a mark and nothing else.
    """

    def __init__(self, content: str):
        text = [ln.strip() for ln in content.split("\n")]
        marks = tuple(DOCSTRING_TOKENS)
        self.size = len(text)
        self.classes = [_class_of(s) for s in text]
        self.colons = [i for i, s in enumerate(text) if s.endswith(":")]
        self.opens = [i for i, s in enumerate(text) if s.startswith(marks)]
        self.closes = [i for i, s in enumerate(text) if s.endswith(marks)]
        self.bare = {i for i, s in enumerate(text) if s in marks}
        self.dense = [i for i, c in enumerate(self.classes) if c not in (_BLANK, _DECORATOR)]

    @staticmethod
    def _next(positions: list[int], at: int, otherwise: int) -> int:
        k = bisect_left(positions, at)
        return positions[k] if k < len(positions) else otherwise

    def signature(self, first: int) -> tuple[int, int]:
        """From the definition's line to the next line that ends in a colon."""
        return first, self._next(self.colons, first, self.size - 1)

    def above(self, first: int, docstrings: bool) -> tuple[int | None, int | None]:
        """Comment run, or closing doc string, right above line ``first``."""
        k = bisect_left(self.dense, first)
        if not k:
            return None, None
        nearest, found = self.dense[k - 1], []
        run = k
        while run and self.classes[self.dense[run - 1]] in (_COMMENT, _SKIPPED):
            run -= 1
        found += [i for i in self.dense[run:k] if self.classes[i] == _COMMENT]
        if docstrings and nearest in self._closing:
            # a bare mark at the end closes; the mark that opens stands above it
            limit = nearest if nearest in self.bare else nearest + 1
            j = bisect_left(self._dense_opens, limit)
            found += [self._dense_opens[j - 1] if j else self.dense[0], nearest]
        return (min(found), max(found)) if found else (None, None)

    @cached_property
    def _closing(self) -> set[int]:
        return set(self.closes)

    @cached_property
    def _dense_opens(self) -> list[int]:
        return [i for i in self.opens if self.classes[i] not in (_BLANK, _DECORATOR)]

    def below(self, lo: int, hi: int, comments: bool) -> tuple[int | None, int | None]:
        """Comment run, or doc string, that begins at line ``lo`` of the lines ``lo..hi``."""
        if lo > hi:
            return None, None
        found = []
        if comments:
            run = takewhile(lambda i: self.classes[i] in (_COMMENT, _SKIPPED), range(lo, hi + 1))
            found += [i for i in run if self.classes[i] == _COMMENT]
        k = bisect_left(self.opens, lo)
        if k < len(self.opens) and self.opens[k] == lo:
            found += [lo, min(hi, self._next(self.closes, lo + 1 if lo in self.bare else lo, hi))]
        return (min(found), max(found)) if found else (None, None)


def _assigned_name(node: ast.stmt) -> str | None:
    """Name that a plain or annotated assignment binds; its first target."""
    target = node.targets[0] if isinstance(node, ast.Assign) else getattr(node, "target", None) if isinstance(node, ast.AnnAssign) else None
    return target.id if isinstance(target, ast.Name) else None


def _element_rows(instance_id, filename, content):
    """Rows for one file (the ``ast`` walk of ELM-1); only ``.py`` files are parsed."""
    source = _Source(content)
    n = source.size
    base = dict.fromkeys(f.name for f in ELEMENT_SCHEMA.fields) | dict(
        instance_id=instance_id, filename=filename, kind="module", elem_type="module", elem_name=filename, parent_name="", parent_ord=-1,
        live=True, ord=0, start_line=1, end_line=n, full_lo=0, full_hi=n - 1, n_lines=n)
    try:
        tree = ast.parse(content) if filename.endswith(".py") else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is None:
        return [base | dict(kind="raw")]
    header = source.below(0, n - 1, comments=True)
    rows = [base | dict(lower_lo=header[0], lower_hi=header[1])]

    def add(node, etype, name, ord_, parent="", parent_ord=-1):
        first, last = node.lineno - 1, node.end_lineno - 1
        defined, bound = etype in ("function", "method", "class"), etype == "constant"
        none = (None, None)
        sig = source.signature(first) if defined else none
        up = source.above(first, docstrings=not bound) if etype != "import" else none
        # below a definition: what follows its first line that ends in a colon (its first line if none does)
        low = source.below(last + 1, n - 1, comments=False) if bound else source.below(
            (sig[1] if sig[1] <= last else first) + 1, last, comments=True) if defined else none
        rows.append(base | dict(
            elem_type=etype, elem_name=name, parent_name=parent, parent_ord=parent_ord, ord=ord_, start_line=node.lineno, end_line=node.end_lineno,
            sig_lo=sig[0], sig_hi=sig[1], full_lo=first, full_hi=last, upper_lo=up[0], upper_hi=up[1], lower_lo=low[0], lower_hi=low[1]))

    def members(body, function, parent="", parent_ord=-1):
        """(node, element type, name) of the elements directly in a body."""
        for node in body:
            if isinstance(node, ast.FunctionDef):
                yield node, function, node.name
            elif (name := _assigned_name(node)) is not None:
                yield node, "constant", name
            elif not parent and isinstance(node, ast.ClassDef):
                yield node, "class", node.name
            elif not parent and isinstance(node, (ast.Import, ast.ImportFrom)):
                yield node, "import", ast.unparse(node)

    last_class: dict[str, int] = {}
    for k, (node, etype, name) in enumerate(members(tree.body, "function")):
        add(node, etype, name, k)
        if etype == "class":
            last_class[name] = k
            for j, (sub, sub_type, sub_name) in enumerate(members(node.body, "method", name)):
                add(sub, sub_type, sub_name, j, name, k)
    for row in rows:
        # a class defined again hides the members of the earlier one from lookups
        row["live"] = not row["parent_name"] or last_class[row["parent_name"]] == row["parent_ord"]
    return rows


def element_frames(batches):
    """Element rows of batches of files, in frames of about ``ROWS_AT_ONCE`` rows."""
    cols = [f.name for f in ELEMENT_SCHEMA.fields]

    def frame(rows):
        return pd.DataFrame(rows, columns=cols).astype({c: "Int32" for c in cols if ELEMENT_SCHEMA[c].dataType == T.IntegerType()})

    for pdf in batches:
        out = []
        for inst, fn, content in zip(pdf["instance_id"], pdf["filename"], pdf["content"]):
            out.extend(_element_rows(inst, fn, content or ""))
            if len(out) >= ROWS_AT_ONCE:
                yield frame(out)
                out = []
        yield frame(out)


def extract_elements(files: DataFrame) -> DataFrame:
    """``files(instance_id, filename, content)`` -> element rows (ELM-1..ELM-6)."""
    # the Python stage is CPU bound: never let it run on fewer tasks than cores
    return spread(files.select("instance_id", "filename", "content")).mapInPandas(element_frames, ELEMENT_SCHEMA)


# ----------------------------------------------------------------------------- displays
#: Columns of an element that its displays are cut from, and those that a display row keeps.
_SPANS = ["kind", "elem_type", "elem_name", "parent_name", "parent_ord", "live", "ord", "start_line", "end_line",
          "sig_lo", "sig_hi", "full_lo", "full_hi", "upper_lo", "upper_hi", "lower_lo", "lower_hi"]
_KEPT = ["kind", "elem_type", "elem_name", "parent_name", "live", "ord", "start_line", "end_line"]
#: Files whose elements a task holds as Python values at once, and characters of displays that it holds before it hands them on.
FILES_AT_ONCE, CHARS_AT_ONCE = 64, 1 << 23


def _cat(*parts: str | None) -> str | None:
    return None if None in parts else "".join(parts)


def _children(found: list[tuple[int | None, str | None]]) -> str:
    """Displays of the children in their order, an empty line between two of them."""
    if not found:
        return "\n"
    found.sort(key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or ""))
    return "\n".join(d for _, d in found if d is not None) + "\n"


def _file_displays(elements: list[tuple], contents: list[str | None], numbered: bool):
    """``(element, level, display)`` of one file's elements (tuples of ``_SPANS``); a file that is there twice gives each of them twice."""
    cut = []
    for content in contents:
        lines = shown = None if content is None else content.split("\n")
        if numbered and lines is not None:
            width = len(str(len(lines)))
            shown = [f"{k:>{width}} |{x}" for k, x in enumerate(lines, 1)]

        def part(lo, hi):
            """``display_content`` of the lines ``lo..hi`` (0-based, inclusive); '' when absent."""
            if lo is None:
                return ""
            return None if shown is None or hi is None else "\n".join(shown[lo:hi + 1]) + "\n"

        for e in elements:
            sig, full, up, low = part(e[9], e[10]), part(e[11], e[12]), part(e[13], e[14]), part(e[15], e[16])
            cut.append((e, sig, full, up, low, content))
    children: dict[tuple, list] = {}   # by class (name, position) and level, modules under (level,)
    out = []

    def shown_at(e, levels):
        out.extend((e, level, display) for level, display in zip(LEVELS, levels))
        if e[3] == "":
            for level, display in zip(LEVELS, levels):
                children.setdefault((level,), []).append((e[6], display))
        elif e[3] is not None and e[4] is not None and e[1] != "class":
            for level, display in zip(LEVELS, levels):
                children.setdefault((e[3], e[4], level), []).append((e[6], display))

    for e, sig, full, up, low, _ in cut:
        if e[1] in ("function", "method"):
            head = _cat(up, sig, low)
            shown_at(e, (sig, head, head, _cat(up, full)))
        elif e[1] == "constant":
            around = _cat(up, full, low)
            shown_at(e, (full, around, around, around))
        elif e[1] == "import":
            shown_at(e, (full,) * 4)
    inside = {k: _children(v) for k, v in children.items() if len(k) == 3}
    for e, sig, full, up, low, _ in cut:
        if e[1] == "class":
            signature, moderate = (_cat(sig, low, inside.get((e[2], e[6], level), "\n")) for level in ("signature", "moderate"))
            shown_at(e, (signature, _cat(up, sig, low), moderate, _cat(up, full)))
    tops = {level: _children(children.get((level,), [])) for level in LEVELS}
    for e, sig, full, up, low, content in cut:
        if e[1] == "module":
            levels = (content,) * 4 if e[0] == "raw" else (tops["signature"], low, _cat(low, tops["moderate"]), full)
            out.extend((e, level, display) for level, display in zip(LEVELS, levels))
    return out


def element_displays(elements: DataFrame, files: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per (element, level) with its display text (ELM-7).

    ``files(instance_id, filename, content)`` supplies the lines; the
    element rows carry only spans, so the text is cut here.  Spans and contents meet
    once, a row a file, and all displays of a file are written beside each other; nothing
    is moved after that.
    """
    at = ["instance_id", "filename"]
    spans = elements.groupBy(*at).agg(F.collect_list(F.struct(*_SPANS)).alias("_e"))
    texts = files.select(*at, "content").repartition(*at).groupBy(*at).agg(F.collect_list(F.struct("content")).alias("_f"))
    schema = T.StructType([*[elements.schema[c] for c in (*at, *_KEPT)], T.StructField("display_level", T.StringType()), T.StructField("display", T.StringType())])

    def run(batches):
        for batch in batches:
            fields = batch.column("_e").type.value_type
            types = [batch.schema.field(c).type for c in at] + [fields.field(c).type for c in _KEPT]
            names = [*at, *_KEPT, "display_level", "display"]

            def table(rows):
                columns = [list(c) for c in zip(*rows)] or [[]] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string(), pa.string()])], names=names)

            rows, chars = [], 0
            for k in range(0, batch.num_rows, FILES_AT_ONCE):
                some = batch.slice(k, FILES_AT_ONCE)
                lists = some.column("_e")
                flat = lists.flatten()
                every = list(zip(*[flat.field(c).to_pylist() for c in _SPANS]))
                done = 0
                for inst, name, n, texts in zip(some.column(at[0]).to_pylist(), some.column(at[1]).to_pylist(), lists.value_lengths().to_pylist(), some.column("_f").to_pylist()):
                    for e, level, display in _file_displays(every[done:done + n], [x["content"] for x in texts], numbered):
                        rows.append((inst, name, e[0], e[1], e[2], e[3], e[5], e[6], e[7], e[8], level, display))
                        chars += len(display or "")
                        if len(rows) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                            yield table(rows)
                            rows, chars = [], 0
                    done += n
            yield table(rows)

    ship_package(elements.sparkSession)
    return shuffled(spans).join(texts, at).select(*at, "_e", "_f").mapInArrow(run, schema)


def latest_by_name(displays: DataFrame, keys=("instance_id", "filename", "elem_type", "parent_name", "elem_name", "display_level")) -> DataFrame:
    """Dict semantics: the last definition of a repeated name wins; members only of the last class of a name (ELM-2)."""
    return displays.where("live").groupBy(*keys).agg(F.max_by("display", "ord").alias("display"), F.max("ord").alias("ord"))


def indexed() -> Column:
    """The displays that :func:`index_rows` reads."""
    etype, level = F.col("elem_type"), F.col("display_level")
    return ((etype == "module") & level.isin("minimal", "moderate", "full")) | ((F.col("kind") == "raw") & (level == "full")) | (
        etype.isin("function", "class") & (F.col("parent_name") == "") & (level == "minimal"))


def index_rows(displays: DataFrame) -> DataFrame:
    """Rows that go into the search index (ELM-8, TXT-3).

    Modules at minimal / moderate / full, top-level functions and classes at
    minimal (last definition per name), raw files once with level ''.
    Methods, constants and imports are not indexed.
    """
    d = displays
    mods = d.where((F.col("elem_type") == "module") & (F.col("kind") == "module") & F.col("display_level").isin("minimal", "moderate", "full"))
    raw = d.where((F.col("kind") == "raw") & (F.col("display_level") == "full")).withColumn("display_level", F.lit(""))
    fc = d.where(F.col("elem_type").isin("function", "class") & (F.col("parent_name") == "") & (F.col("display_level") == "minimal"))
    fc = latest_by_name(fc).withColumn("kind", F.lit("module"))
    cols = ["instance_id", "filename", "elem_name", "parent_name", "elem_type", "display_level", "display"]
    raw = raw.withColumn("elem_type", F.when(F.col("filename").endswith(".py"), "module")
                         .when(F.col("filename").contains("README"), "readme").otherwise("other"))
    return (mods.select(*cols).unionByName(fc.select(*cols)).unionByName(raw.select(*cols))
            .withColumnRenamed("display", "content"))


def element_counts(elements: DataFrame) -> DataFrame:
    """Module / raw file counts (AGG-10)."""
    return elements.where(F.col("elem_type") == "module").groupBy("instance_id", "kind").agg(F.count(F.lit(1)).alias("n"))
