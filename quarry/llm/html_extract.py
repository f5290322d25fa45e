"""Main text of web pages: flat text blocks and a decision tree.

A page is cut at its block-level tags into a flat list of text blocks.  Each is
described by its word count and link density, those of its neighbours, its tag,
and what its nearest telling container is (article or main; or menu, header,
footer, sidebar, notice, advert, form, comments).  A decision tree, grown on the
blocks of the hand-labelled pages in :mod:`quarry.llm.html_samples`, says which
blocks are main text.

A class or id that says what an element has or lacks (``has-sidebar``, ``no-comments``)
says nothing of what it is.  Where no block lies in a main container and under a tenth
of the words lie outside frames, a container that only its class or id names a frame,
and that holds over half of the words, is the page's wrapper and says nothing either.

Scripts, styles and other markup without text are skipped.  Character references
are decoded, white space inside a block becomes one space, and the kept blocks
are joined in page order by a line feed; nothing else is dropped or capped.

Defined results: null or empty html, and a page without main text, give an empty
text and 0 characters; unclosed tags end with their container or the page (after
an unclosed object, select, svg and the like the page is read on);
repeated rows give repeated rows; null ids and urls stay null; other columns are
ignored; pages may have any length and are read in parts of a batch; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_of, columns_of, map_rows, slices
from quarry.llm.html_samples import PAGES
from quarry.llm.trees import Tree, fit_tree

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg annotation annotation-xml head title iframe object textarea select canvas audio video".split())
#: Of these, without an end tag, browsers read the rest of the page as raw text.
UNCLOSED_TO_END = frozenset(("script", "style", "textarea", "iframe"))
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr
math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mfenced menclose mmultiscripts mprescripts none""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that name what they hold.
MAIN_TAGS = frozenset(("article", "main"))
FRAME_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of class, id and role that name boilerplate or main text.
FRAME_WORDS = frozenset("""ad ads advert adverts advertisement adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
breadcrumbs pagination pager footer contentinfo sidebar aside complementary widget widgets related recommended cookie cookies consent gdpr notice
notices notification alert popup modal dialog overlay comment comments disqus discussion reply replies respond reviews form login signup search
newsletter subscribe subscription share sharing social toolbar topbar masthead header copyright legal tags disclaimer""".split())
MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent".split())
#: First words of a name that tells what an element has, not what it is.
HAS_WORDS = frozenset("has have with without no not hide show".split())
_WORD = re.compile(r"[a-z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    tag: str
    zone: int
    named: int  # number of the container whose class or id alone makes the zone a frame, else 0


def _zone(tag: str, attributes: str, inside: int) -> int | None:
    """1: main text, -1: frame, -2: frame by class, id or role only, None: says nothing."""
    if tag in MAIN_TAGS:
        return 1
    if tag in FRAME_TAGS:
        return -1
    if tag == "header":  # of the page a frame, of an article its headline
        return None if inside == 1 else -1
    if attributes and tag not in ("body", "html"):
        found = 0
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            for value in (a or b or c).split():
                words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                if words and words[0] in HAS_WORDS:
                    continue
                if not FRAME_WORDS.isdisjoint(words):
                    return -2
                if not MAIN_WORDS.isdisjoint(words):
                    found = 1
        if found:
            return 1
    return None


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, its wrappers left out of account."""
    silent: set[int] = set()
    while True:
        blocks = _read(page, silent)
        total = sum(b.words for b in blocks)
        outside = sum(b.words for b in blocks if b.zone == 0)
        if any(b.zone > 0 for b in blocks) or 10 * outside >= total:
            return blocks
        held: dict[int, int] = {}
        for b in blocks:
            if b.named:
                held[b.named] = held.get(b.named, 0) + b.words
        wrapper = max(held, key=held.__getitem__, default=0)
        if 2 * held.get(wrapper, 0) <= total:
            return blocks
        silent.add(wrapper)


def _read(page: str, silent: set[int]) -> list[Block]:
    """The blocks, with the containers of the numbers in ``silent`` (in order of opening) saying nothing."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open containers, and the zone and naming container before each
    zone, named, opened, links, tag = 0, 0, 0, 0, "body"
    unclosed: set[str] = set()  # elements of RAW without an end tag in the rest of the page
    parts: list[tuple[str, bool]] = []

    def close():
        if parts:
            words = " ".join("".join(p for p, _ in parts).split())
            if words:
                n = words.count(" ") + 1
                linked = sum(len(p.split()) for p, in_link in parts if in_link)
                out.append(Block(words, n, min(1.0, linked / n), tag, zone, named))
            parts.clear()

    pos, end, find = 0, len(page), _TOKEN.search
    while pos < end:
        m = find(page, pos)
        if m is None:
            parts.append((entities.unescape(page[pos:]), links > 0))
            break
        if m.start() > pos:
            parts.append((entities.unescape(page[pos:m.start()]), links > 0))
        pos = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            if m.group().startswith("<![CDATA["):
                parts.append((m.group()[9:].removesuffix("]]>"), links > 0))
            continue
        name, closing, attributes = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if name in INLINE and not (attributes and not closing and name in ("span", "label") and _zone(name, attributes, zone)):
            if name == "a":
                links = 0 if closing else 1
            elif name in ("br", "wbr", "img"):
                parts.append((" " if name != "wbr" else "", links > 0))
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                done = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
                if done:
                    pos = done.end()
                elif name in UNCLOSED_TO_END:
                    pos = end
                else:  # what follows is read as the page
                    unclosed.add(name)
            continue
        close()
        links = 0
        if name in VOID or name in RAW:
            continue
        if not closing:
            tag = name
            opened += 1
            said = _zone(name, attributes, zone)
            if said == -2 and opened in silent:
                said = None
            if attributes and _HIDDEN.search(attributes) and name not in ("body", "html"):
                said = -1
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                _, zone, named = stack.pop()  # closed by its next sibling
            if not attributes.endswith("/"):
                stack.append((name, zone, named))
                if said is not None:
                    zone, named = max(said, -1), opened if said == -2 else 0
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, zone, named = stack[k]
                    del stack[k:]
                    break
                if name == "p" and stack[k][0] in ("article", "main", "div", "section", "body", "li", "td"):
                    break  # a stray </p> closes nothing outside
            tag = stack[-1][0] if stack else "body"
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Word count and link density of each block and its neighbours, its tag and its container."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], dtype=float)
    density = np.array([b.link_density for b in blocks])
    zone = np.array([b.zone for b in blocks], dtype=float)
    has_main = float((zone > 0).any())
    before = lambda a, fill: np.concatenate([[fill], a[:-1]]) if n else a
    after = lambda a, fill: np.concatenate([a[1:], [fill]]) if n else a
    return np.column_stack([
        zone, np.full(n, has_main), words, density, before(words, 0), before(density, 1), after(words, 0), after(density, 1),
        np.array([b.tag in _HEADINGS for b in blocks], dtype=float), np.array([b.tag == "li" for b in blocks], dtype=float)])


#: Variants of each labelled page in the table.
VARIANTS = 24


@functools.cache
def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of every block of the labelled pages, and of variants of these pages.

    What a container says holds for short and long blocks in any order: a variant
    scales the words of each block that lies in a telling container by up to ten, either
    way, and deals these blocks anew.  Blocks outside keep their words and their place.
    """
    rnd = random.Random(1)
    xs, ys = [], []
    for page in PAGES:
        blocks = blocks_of(page)
        labels = [float("§" in b.text) for b in blocks]
        for k in range(VARIANTS + 1):
            told = [i for i, b in enumerate(blocks) if b.zone]
            places = told if not k else rnd.sample(told, len(told))
            order = list(range(len(blocks)))
            for at, i in zip(told, places):
                order[at] = i
            made = [replace(blocks[i], words=max(1, round(blocks[i].words * 10 ** rnd.uniform(-1, 1)))) if k and blocks[i].zone else blocks[i] for i in order]
            xs.append(features(made))
            ys.append(np.array([labels[i] for i in order]))
    return np.concatenate(xs), np.concatenate(ys)


@functools.cache
def block_tree() -> Tree:
    return fit_tree(*labelled_table(), max_depth=7)


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = tree.predict(features(blocks)) > 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each page."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    tree = block_tree()

    def run(batches):
        for batch in slices(batches, 500):
            kind = pa.schema([("page_id", batch.column(0).type), ("url", batch.column(1).type), ("text", pa.string()), ("n_chars", pa.int64())])
            texts = [main_text(h, tree) for h in columns_of(batch, "html")[0]]
            yield batch_of(kind, batch.column(0), batch.column(1), texts, [len(t) for t in texts])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return map_rows(rows, run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
