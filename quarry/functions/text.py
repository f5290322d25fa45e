"""Text Column helpers: clean-up, tokenising, term counts, tagging, HTML.

All helpers take and return ``Column`` objects built from built-in functions,
so they run in the JVM (no Python per row).
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# ASCII punctuation replaced by a space in a full-text query.
QUERY_PUNCTUATION = string.punctuation  # !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# Substrings of filename / element name that make a row exact-only (not embedded).
EXACT_ONLY_PATTERNS = ["test", "example"]
# Display level whose rows are never embedded.
EXACT_ONLY_LEVEL = "full"
# Element types that the "code" filter drops, and the path part it drops.
NON_CODE_TYPES = ["readme", "other"]
NON_CODE_PATH_LIKE = "%tests%"
# HTML elements removed with their content before text extraction.
HTML_DROP_ELEMENTS = ["script", "style", "head", "nav", "footer"]
# Character entities decoded after tag removal; ``&amp;`` must stay last.
HTML_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
# Page text limit (characters).
PAGE_TEXT_LIMIT = 45_000

# Term pattern: a run of letters or digits (Unicode aware).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TOKEN_RUN = r"[\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_query(col) -> Column:
    """Every ASCII punctuation character becomes a space (TXT-4)."""
    return F.translate(_c(col), QUERY_PUNCTUATION, " " * len(QUERY_PUNCTUATION))


def strip_ws(col) -> Column:
    """``str.strip()``: leading and trailing Unicode white space (TXT-7)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


#: Combining diacritical marks (one Unicode block): what folding takes off a letter.
DIACRITICS = range(0x0300, 0x0370)


@functools.cache
def fold_table() -> tuple[str, str]:
    """``(letters + marks, bases)`` for ``translate``: each letter that decomposes into one base and diacritics.

    Read off Unicode's canonical decompositions: the letter stands for its base, and
    the marks, which have no counterpart in ``bases``, are removed.
    """
    letters, bases = [], []
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        base, *marks = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c)[:1] not in ("", "<") else c
        if marks and ord(base) not in DIACRITICS and all(ord(m) in DIACRITICS for m in marks):
            letters.append(c)
            bases.append(base)
    return "".join(letters) + "".join(map(chr, DIACRITICS)), "".join(bases)


def fold(col) -> Column:
    """Letters without their diacritics, composed or combining; texts in ASCII pass untouched."""
    c = _c(col)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *fold_table())).otherwise(c)


def tokenize(col) -> Column:
    """Lower-cased runs of letters / digits without diacritics (TXT-5): ``Café`` gives ``cafe``.

    ``regexp_extract_all`` returns exactly the non-empty runs, so no
    per-token lambda is needed to drop the empty parts a ``split`` leaves.
    """
    return F.regexp_extract_all(fold(F.lower(F.coalesce(_c(col), F.lit("")))), F.lit(TOKEN_RUN), 0)


def with_term_counts(df, tokens_col: str, out_col: str):
    """Add ``out_col: array<struct<term, tf>>`` counted from ``tokens_col`` without a shuffle.

    Sort the tokens, mark the positions where the term changes, and take the
    distance to the next change as the count.  O(n log n) per row, JVM only,
    so postings never need a ``groupBy(id, term)`` exchange.  The sorted
    array and the change points are separate projections: a lambda that
    referenced an un-materialised array expression would re-evaluate it for
    every element.  Callers explode the result with ``explode_outer``: a
    plain ``explode`` of an attribute makes the optimizer infer a
    ``size(...) > 0`` filter and push it below these projections, inlining
    the whole array pipeline into the filter.
    """
    s, st = f"_{out_col}_s", f"_{out_col}_st"
    sc = F.col(s)
    n = F.size(sc)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = (
        df.withColumn(s, F.sort_array(F.col(tokens_col)))
        .withColumn(st, F.filter(idx, lambda i: (i == 0) | (F.get(sc, i) != F.get(sc, i - 1))))
        .withColumn(out_col, F.transform(
            F.col(st),
            lambda p, j: F.struct(
                F.get(sc, p).alias("term"),
                (F.coalesce(F.get(F.col(st), j + 1), n) - p).cast("long").alias("tf"),
                (j == 0).alias("first"),
            )))
    )
    return out.drop(s, st)


def exact_only(filename, elem_name, display_level) -> Column:
    """True when a row is searchable by text only (TXT-2)."""
    cond = F.lit(False)
    for p in EXACT_ONLY_PATTERNS:
        cond = cond | F.coalesce(_c(filename).contains(p), F.lit(False)) | F.coalesce(_c(elem_name).contains(p), F.lit(False))
    return cond | (F.coalesce(_c(display_level), F.lit("")) == EXACT_ONLY_LEVEL)


def raw_elem_type(filename) -> Column:
    """Element type of a raw file: ``.py`` module, README, else other (TXT-3)."""
    f = _c(filename)
    return F.when(f.endswith(".py"), "module").when(f.contains("README"), "readme").otherwise("other")


def decode_references(text) -> Column:
    """Numeric and named character references as their characters, in one pass; unknown ones stay."""
    named = F.create_map(*[F.lit(x) for kv in sorted(name2codepoint.items()) for x in (kv[0], chr(kv[1]))])

    def decoded(part):
        name = F.regexp_extract(part, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8))
        code = F.when(name.startswith("#"), digits.try_cast("int"))
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.when(~name.startswith("#"), F.try_element_at(named, name)))
        return F.when(char.isNull(), part).otherwise(F.concat(char, F.substring(part, F.length(name) + F.lit(3), F.length(part))))

    t = _c(text)
    return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, r"(?=&[#a-zA-Z])"), decoded), "")).otherwise(t)


def html_to_text(html, limit: int | None = None) -> Column:
    """Text of ``<body>`` without script/style/head/nav/footer, comments, tags (TXT-9/10).

    An unclosed body, comment or dropped element ends with the page.  ``limit``
    (``PAGE_TEXT_LIMIT`` for parity) cuts the text; by default it is whole.
    """
    inner = F.regexp_extract(_c(html), r"(?is)<body\b[^>]*>(.*)", 1)
    closed = F.regexp_extract(inner, r"(?is)^(.*)</body\s*>", 1)
    t = F.when(inner.rlike(r"(?i)</body\s*>"), closed).otherwise(inner)
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "")
    for el in HTML_DROP_ELEMENTS:
        t = F.regexp_replace(t, rf"(?is)<{el}\b[^>]*>.*?(?:</{el}\s*>|\z)", "")
    t = decode_references(F.regexp_replace(t, r"<[^>]*>", ""))
    if limit is not None:
        t = F.substring(t, 1, limit)
    return t


def count_char(col, ch: str) -> Column:
    """Occurrences of one character (``str.count``)."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def self_referential(repo, text) -> Column:
    """Repo base name (after the last ``/``, lower) occurs in lower(text) (FLT-4)."""
    base = F.lower(F.element_at(F.split(_c(repo), "/"), -1))
    return F.lower(_c(text)).contains(base)


def excluded_url(url) -> Column:
    """URL on an excluded host: contains ``/github.com`` (FLT-5)."""
    return _c(url).contains("/github.com")
