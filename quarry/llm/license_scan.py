"""License scans: a trained paragraph classifier with confirmation by templates.

Each line of a text is a paragraph.  A sparse logistic regression (one output a
licence family and one for other text) over hashed word 1- to 3-grams gives class
probabilities.  It learns from the notices in :mod:`quarry.llm.license_texts`,
varied by rule, and from other sentences: the ones listed there and paragraphs of
a bounded sample of documents that hold no notice's three-word sequence.  The
probability needed is calibrated on held-out other paragraphs, so that none of
them passes; what looks like a notice but stays below it is ``unknown``.  A
prediction is confirmed when the paragraph shares enough three-word sequences
with a template of the family; otherwise it is ``unknown`` too.

Only paragraphs with a 2- or 3-gram of the notices, or a word of theirs that
speaks for a family, are scored.  A notice inside a longer paragraph is outweighed
there, so runs of the notices' 3-grams in it are scored too, in overlapping windows
of at most SCALES words, the longest first; what they name is cut to the run that
matches the family.  A paragraph of at most the longest window whose own name no
window contradicts is one notice; otherwise its windows' spans are the notices.

The sample is cut: of each sampled document the first SAMPLE_PARAGRAPHS paragraphs
are learned from, and of these the first SAMPLE_CHARS characters.  Texts that are
scanned are read whole.

Defined results: null and empty texts have no paragraphs and no families;
paragraphs may have any length; repeated rows give repeated rows; null ids stay
null; other columns are ignored; an empty table gives no rows (and the model
learns from the listed sentences alone).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_of, columns_of, map_rows, mix64, slices, text_or_empty
from quarry.llm.license_texts import OTHER, TEMPLATES

BITS = 16
#: Documents (those with the least hash of their id) whose paragraphs serve as other text, and paragraphs of each.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 400, 5, 2000
#: Share of the shorter side's three-word sequences that paragraph and template must have in common.
CONFIRM = 0.5
MARGIN = 0.05
#: Words of the windows in long paragraphs; fewer than LEAST words get their neighbours as context.
SCALES, LEAST = (96, 48, 24, 12), 12
#: More words than this between two 3-grams of the notices end a run.
GAP = 6
_WORD = re.compile(r"[a-z0-9]+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def grams(words: list[str]) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the 1-, 2- and 3-grams."""
    h1 = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    h2 = mix64(h1[:-1] * np.uint64(3) + h1[1:] * np.uint64(5) + np.uint64(1))
    h3 = mix64(h2[:-1] * np.uint64(7) + h1[2:] * np.uint64(11) + np.uint64(2))
    return h1, h2, h3


def _slots(words: list[str], hashes: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    return np.unique(np.concatenate(hashes or grams(words)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _threes(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:], words[2:])) or frozenset([tuple(words)])


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: np.ndarray     # (slots, families + 1), the last column is other text
    bias: np.ndarray
    needed: float
    cue: frozenset          # 2- and 3-gram hashes of the templates, and those of their words that speak for a family
    templates: tuple[tuple[frozenset, ...], ...]

    def probabilities(self, words: list[str], hashes: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        s = _slots(words, hashes)
        z = self.weights[s].sum(axis=0) / max(1.0, np.sqrt(len(s))) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def label(self, words: list[str], hashes: tuple[np.ndarray, ...] | None = None) -> tuple[str, float]:
        """(family, ``unknown`` or empty; probability) of a paragraph, whose grams may be given."""
        p = self.probabilities(words, hashes)
        k = int(p.argmax())
        if k == len(self.families):
            return "", float(p[k])
        if p[k] >= self.needed:
            mine = _threes(words)
            if any(len(mine & t) >= CONFIRM * min(len(mine), len(t)) for t in self.templates[k]):
                return self.families[k], float(p[k])
        return "unknown", float(p[k])

    def named(self, words: list[str], lo: int, hi: int) -> tuple[str, float] | None:
        """Family and probability of a window, scored with some words around it or, if it covers half of a template, alone."""
        more = max(0, LEAST - (hi - lo))
        a = max(0, lo - (more + 1) // 2)
        family, p = self.label(words[a:max(hi, min(len(words), a + LEAST))])
        if family not in ("", "unknown"):
            return family, p
        p = self.probabilities(words[lo:hi])
        k = int(p.argmax())
        if k < len(self.families) and p[k] >= self.needed and self._covers(k, words[lo:hi]):
            return self.families[k], float(p[k])
        return None

    def _covers(self, k: int, words: list[str]) -> bool:
        mine = _threes(words)
        return any(len(mine & t) >= CONFIRM * len(t) for t in self.templates[k])

    def spans(self, words: list[str], hits: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, family or ``unknown``, probability) of the notices among the words.

        ``hits`` are the rising positions of the templates' 3-grams.
        """
        found, taken, tried = [], np.zeros(len(words), dtype=bool), set()
        for scale in SCALES:
            for run in _runs(hits[~taken[hits]]):
                lo, hi = int(run[0]), int(run[-1]) + 3
                for a in range(lo, max(lo + 1, hi - scale // 2), scale // 2):
                    b = min(hi, a + scale)
                    inside = run[np.searchsorted(run, a):np.searchsorted(run, b - 2)]
                    if (a, b) in tried or taken[inside].all():
                        continue
                    tried.add((a, b))
                    got = self.named(words, a, b)
                    if got is None:
                        continue
                    k = self.families.index(got[0])
                    at = [np.array([i for i in range(a, b - 2) if any(tuple(words[i:i + 3]) in t for t in f)], dtype=int) for f in self.templates]
                    rival = max(len(x) for j, x in enumerate(at) if j != k)
                    cut = (a, b) != (lo, hi) or taken[max(0, a - GAP):b + GAP].any()
                    if rival > len(at[k]) or rival == len(at[k]) and cut:
                        continue  # words that families share, cut from what tells them apart, or two notices
                    parts = _runs(at[k])
                    longest = max(map(len, parts), default=0)
                    for part in parts:
                        c, d = int(part[0]), int(part[-1]) + 3
                        if len(part) == longest or self._covers(k, words[c:d]):
                            found.append((c, d, *got))
                            taken[c:d] = True
        near = taken.copy()
        for c, d, *_ in found:
            near[max(0, c - GAP):d + GAP] = True
        for run in _runs(hits[~taken[hits]]):
            lo, hi = int(run[0]), int(run[-1]) + 3
            if not near[lo:hi].any():
                a = max(0, lo - (max(0, LEAST - (hi - lo)) + 1) // 2)
                family, p = self.label(words[a:max(hi, min(len(words), a + LEAST))])
                if family == "unknown":
                    found.append((lo, hi, family, p))
        merged: list[tuple[int, int, str, float]] = []
        for x in sorted(found):
            if merged and merged[-1][2] == x[2] and x[0] - merged[-1][1] <= GAP:
                last = merged.pop()
                x = (last[0], max(last[1], x[1]), x[2], max(last[3], x[3]))
            merged.append(x)
        return merged


def _runs(at: np.ndarray) -> list[np.ndarray]:
    return np.split(at, np.flatnonzero(np.diff(at) > GAP + 3) + 1) if len(at) else []


def _varied(rng: np.random.Generator, words: list[str], other: list[list[str]]) -> list[str]:
    """A notice cut to a part, with words lost, or inside other text."""
    n = len(words)
    take = int(rng.integers(max(3, n // 2), n + 1)) if n > 4 else n
    lo = int(rng.integers(0, n - take + 1))
    out = [w for w in words[lo:lo + take] if rng.random() > 0.05]
    if rng.random() < 0.4:
        frame = other[int(rng.integers(0, len(other)))][:8]
        out = frame + out if rng.random() < 0.5 else out + frame
    return out


def fit(other_paragraphs: list[str], seed: int = 7, copies: int = 24, epochs: int = 60, rate: float = 2.0, l2: float = 1e-5) -> Model:
    """Softmax regression by gradient descent; every third other paragraph is held out for the calibration."""
    rng = np.random.default_rng(seed)
    families = tuple(TEMPLATES)
    notices = [[words_of(t) for t in TEMPLATES[f]] for f in families]
    known = frozenset(x for f in notices for t in f for x in _threes(t))
    sampled = [w for w in map(words_of, other_paragraphs) if len(w) >= 3 and known.isdisjoint(_threes(w))]
    other = [words_of(t) for t in OTHER] + sampled
    learn = [w for i, w in enumerate(other) if i < len(OTHER) or i % 3]
    held = [w for i, w in enumerate(other) if i >= len(OTHER) and i % 3 == 0]
    x, y = [], []
    for k, texts in enumerate(notices):
        for t in texts:
            x.append(_slots(t))
            y.append(k)
            for _ in range(copies):
                v = _varied(rng, t, other)
                if len(v) >= 2:
                    x.append(_slots(v))
                    y.append(k)
    x += [_slots(w) for w in learn]
    y += [len(families)] * len(learn)
    y = np.array(y)
    rows = np.repeat(np.arange(len(x)), [len(s) for s in x])
    slots = np.concatenate(x)
    used, at = np.unique(slots, return_inverse=True)
    value = 1 / np.sqrt(np.array([len(s) for s in x]))[rows]
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(used)))
    row_starts = np.searchsorted(rows, np.arange(len(x)))
    classes = len(families) + 1
    truth = np.eye(classes)[y]
    share = truth.mean(axis=0)
    weight = (1 / (classes * share))[y][:, None] / len(x)
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    for _ in range(epochs):
        z = np.add.reduceat(w[at] * value[:, None], row_starts) + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - truth) * weight
        per = g[rows] * value[:, None]
        w -= rate * classes * (np.add.reduceat(per[order], starts) + l2 * w)
        b -= rate * g.sum(axis=0)
    weights = np.zeros((1 << BITS, classes), dtype=np.float32)
    weights[used] = w
    single = np.unique(np.concatenate([grams(t)[0] for f in notices for t in f]))
    for_family = weights[(single & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    single = single[for_family[:, :-1].max(axis=1) > np.maximum(0, for_family[:, -1])]
    cue = frozenset(np.concatenate([single, *(np.concatenate(grams(t)[1:]) for f in notices for t in f)]).tolist())
    model = Model(families, weights, b.astype(np.float32), 0.0, cue, tuple(tuple(_threes(t) for t in f) for f in notices))
    highest = max([float(model.probabilities(v)[:-1].max()) for v in held], default=0.0)
    return Model(families, weights, model.bias, min(0.9, max(0.3, highest + MARGIN)), cue, model.templates)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the listed sentences and paragraphs of at most SAMPLE_DOCS documents.

    Ids are made distinct first, and of the rows of a repeated id one, that with the least
    paragraphs, is taken before anything comes to the driver.
    """
    chosen = docs.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    paragraphs = F.slice(F.filter(F.split(text_or_empty(text_col), "\n"), lambda x: F.trim(x) != ""), 1, SAMPLE_PARAGRAPHS)
    texts = docs.select(F.col(id_col).alias("id"), F.transform(paragraphs, lambda x: F.substring(x, 1, SAMPLE_CHARS)).alias("p"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("p").alias("p")).select(F.explode("p").alias("p")).collect()
    return fit(sorted({r.p for r in rows}))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, start, length, family, probability, paragraph_text)``: one row per paragraph that looks like a notice.

    ``paragraph`` counts the text's lines from 0, ``start`` and ``length`` are in code points.
    """
    schema = _id_type(docs, id_col) + ", paragraph long, start long, length long, family string, probability double, paragraph_text string"
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), _scanner(docs, model, False), schema)


def scan_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_paragraphs, n_notices, n_unknown, families)`` of every document; families are joined by commas."""
    schema = _id_type(docs, id_col) + ", n_paragraphs long, n_notices long, n_unknown long, families string"
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), _scanner(docs, model, True), schema)


def _id_type(docs: DataFrame, id_col: str) -> str:
    return "doc_id " + docs.schema[id_col].dataType.simpleString()


def notices(text: str, model: Model, cues: np.ndarray):
    """(number of paragraphs, [(paragraph, start, length, family, probability)]) of a text."""
    lines = text.split("\n")
    words, count = [], 0
    starts, at = [], 0
    for line in lines:
        w = words_of(line)
        if w:
            count += 1
        words.append(w)
        starts.append(at)
        at += len(line) + 1
    flat = [w for line in words for w in line]
    if len(flat) < 2:
        return count, []
    sizes = np.array([len(w) for w in words])
    owner, first = np.repeat(np.arange(len(lines)), sizes), np.cumsum(sizes) - sizes
    h1, h2, h3 = grams(flat)
    hit1 = np.flatnonzero(_among(cues, h1))
    hit2 = np.flatnonzero(_among(cues, h2) & (owner[:-1] == owner[1:]))
    hit3 = np.flatnonzero(_among(cues, h3) & (owner[:-2] == owner[2:])) if len(h3) else hit2[:0]
    found = []
    for k in np.unique(np.concatenate([owner[hit1], owner[hit2], owner[hit3]])).tolist():
        if len(words[k]) < 2:
            continue
        lo, end = int(first[k]), int(first[k] + sizes[k])
        family, p = model.label(words[k], (h1[lo:end], h2[lo:end - 1], h3[lo:max(lo, end - 2)]))
        hits = hit3[np.searchsorted(hit3, lo):np.searchsorted(hit3, end)] - lo
        inner = model.spans(words[k], hits) if len(words[k]) > LEAST and len(hits) else []
        if family in ("", "unknown"):
            replaced = bool(inner)
        else:
            names = {x[2] for x in inner}
            replaced = not names <= {family, "unknown"} or len(words[k]) > SCALES[0] and family in names
        if replaced:
            ends = _word_ends(lines[k])
            for c, d, name, q in inner:
                found.append((k, starts[k] + ends[c][0], ends[d - 1][1] - ends[c][0], name, q))
        elif family:
            found.append((k, starts[k], len(lines[k]), family, p))
    return count, found


def _word_ends(line: str) -> list[tuple[int, int]]:
    """Where each of the line's words starts and ends, in code points of the line as it is."""
    low = line.lower()
    ends = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(line):
        return ends
    source = [i for i, c in enumerate(line) for _ in c.lower()]  # some letters are longer in lower case
    return [(source[a], source[b - 1] + 1) for a, b in ends]


def _among(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def _scanner(docs: DataFrame, model: Model, summed: bool):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        cues = np.array(sorted(m.cue), dtype=np.uint64)
        for batch in slices(batches, 2000):
            ids, texts = columns_of(batch, "doc_id", "text")
            found = [notices(t, m, cues) for t in texts]
            if summed:
                kind = pa.schema([("doc_id", batch.column(0).type)] + [(n, pa.int64()) for n in ("n_paragraphs", "n_notices", "n_unknown")] + [("families", pa.string())])
                names = [[x[3] for x in f] for _, f in found]
                yield batch_of(kind, batch.column(0), [n for n, _ in found], [sum(x != "unknown" for x in f) for f in names],
                               [f.count("unknown") for f in names], [",".join(sorted(set(f) - {"unknown"})) for f in names])
            else:
                kind = pa.schema([("doc_id", batch.column(0).type), ("paragraph", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                                  ("family", pa.string()), ("probability", pa.float64()), ("paragraph_text", pa.string())])
                rows = [(i, k, s, n, f, p, t[s:s + n]) for i, t, (_, got) in zip(ids, texts, found) for k, s, n, f, p in got]
                if rows:
                    yield batch_of(kind, *zip(*rows))
    return run
