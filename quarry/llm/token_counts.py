"""Exact token counts of every prefix of a text, by dynamic programming.

Within one match of the splitting pattern (a piece), the encoding of a prefix
ends in the only token ``t`` that fits: the encoding of the bytes before ``t``
is known, and its last token and ``t`` must be the encoding of their joined
bytes.  So one pass over the bytes gives the count at every prefix, and counts
of pieces add up.  The table of prefix counts answers how many tokens any
prefix has and where a token budget cuts the text, without encoding again.

Prefixes end at code points.  A prefix that ends inside a run of white space or
inside ``'re`` splits there as that prefix alone would, which the table follows,
so a count may fall by a token where the next character completes a longer match.

Defined results: null text counts as empty; an empty text has no tokens;
repeated rows give repeated rows; null ids stay null; other columns are ignored;
texts may have any length; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import TreeEncoder, broadcast_vocabulary, encoder_of
from quarry.llm.common import batch_of, columns_of, map_rows, slices, text_or_empty

_RUN = regex.compile(r"\s{2,}")
#: Contractions of three characters: their first two characters alone are two pieces.
_SPLIT = ("'re", "'ve", "'ll")
#: Distinct units, pieces and token pairs that a worker remembers; beyond, they are worked out each time.
REMEMBER = 200_000


class _Units(dict):
    """Steps of the units of a text split at single spaces; None where a unit's ends are no sure cuts."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> bytes | None:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        c = self.counter
        if unit.isascii() and unit.isalpha():
            value = c.steps(" " + unit)
        elif _RUN.search(unit):
            return None
        else:
            value = b"".join([c.steps(p) for p in c.encoder.pattern.findall(" " + unit)])
        if len(self) < REMEMBER and len(unit) < 48:
            self[unit] = value
        return value


class PrefixCounter:
    def __init__(self, encoder: TreeEncoder):
        self.encoder = encoder
        self.ranks, self.special = encoder.ranks, encoder.special
        self.longest = max(map(len, self.ranks))
        self.states: dict[bytes, tuple[int, int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.units = _Units(self)
        self.pairs: dict[int, bool] = {}

    def _pair(self, a: int, b: int) -> bool:
        key = a << 24 | b
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.encoder.core.encode_single_piece(self.encoder.bytes_of[a] + self.encoder.bytes_of[b]) == [a, b]
            if len(self.pairs) < REMEMBER:
                self.pairs[key] = ok
        return ok

    def piece_bytes(self, data: bytes) -> list[int]:
        """Token count of data[:i] for i = 1..len(data), as one piece."""
        n, get, longest = len(data), self.ranks.get, self.longest
        short = n <= 48
        known = self.states if short else {}
        row: list[tuple[int, int]] = [(-1, 0)]  # (last token, count) of each prefix
        for i in range(1, n + 1):
            state = known.get(data[:i]) if short else None
            if state is None:
                for j in range(max(0, i - longest), i):
                    t = get(data[j:i])
                    if t is not None and (j == 0 or self._pair(row[j][0], t)):
                        state = (t, row[j][1] + 1)
                        break
                if short and len(known) < 2 * REMEMBER:
                    known[data[:i]] = state
            row.append(state)
        return [c for _, c in row[1:]]

    def piece(self, piece: str) -> list[int]:
        """The counts at the code points of a piece."""
        counts = self.piece_bytes(piece.encode())
        if len(counts) != len(piece):
            at, ends = -1, []
            for c in piece:
                at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                ends.append(at)
            counts = [counts[e] for e in ends]
        if piece in _SPLIT:
            counts[1] = 2
        return counts

    def steps(self, piece: str) -> bytes:
        """The change of the count at each code point of a piece, as signed bytes."""
        known = self.pieces.get(piece)
        if known is None:
            last, known = 0, bytearray()
            for c in self.piece(piece):
                known.append((c - last) & 255)
                last = c
            known = bytes(known)
            if len(self.pieces) < REMEMBER and len(piece) < 48:
                self.pieces[piece] = known
        return known

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at each code point of a text without special strings."""
        parts = [self.steps(p) for p in self.encoder.pattern.findall(text)]
        counts = np.cumsum(np.frombuffer(b"".join(parts), dtype=np.int8), dtype=np.int64)
        for m in _RUN.finditer(text):
            s, e = m.span()
            counts[s:e] = (counts[s - 1] if s else 0) + np.array(self.piece(m.group()))
        return counts

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.ordinary(text)
        head = self.ordinary(first)
        try:
            tail = np.frombuffer(b"".join(map(self.units.__getitem__, rest)), dtype=np.int8)
        except TypeError:  # a unit whose ends are no sure cuts
            return self.ordinary(text)
        return np.concatenate([head, np.cumsum(tail, dtype=np.int64) + head[-1]])

    def counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for i = 1..len(text); special strings are one token once they are whole."""
        split = self.encoder.split_special
        if split is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, base, parts = [], 0, split.split(text)
        for k in range(0, len(parts), 2):
            part, special = parts[k], parts[k + 1] if k + 1 < len(parts) else ""
            got = self.ordinary(part + special[:-1])
            out.append(base + got)
            base += int(got[len(part) - 1]) if part else 0
            if special:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out)


def tokens_at(counts: np.ndarray, n: int) -> int:
    """Tokens of the first ``n`` code points."""
    return int(counts[min(n, len(counts)) - 1]) if n and len(counts) else 0


def fit_length(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_COUNTERS: dict[int, PrefixCounter] = {}


def counter_of(raw: bytes, pattern: str) -> PrefixCounter:
    enc = encoder_of(raw, pattern)
    if id(enc) not in _COUNTERS:
        _COUNTERS[id(enc)] = PrefixCounter(enc)
    return _COUNTERS[id(enc)]


def count_tokens(docs: DataFrame, path: str, pattern: str, budget: int, id_col: str = "doc_id", text_col: str = "text",
                 keep_prefixes: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, fit_chars, over_limit)`` read off each text's prefix table.

    ``fit_chars`` is the longest prefix (code points) within ``budget`` tokens.  With
    ``keep_prefixes`` the table itself comes along as ``prefix_counts``, little-endian
    32-bit counts after each code point.
    """
    raw = broadcast_vocabulary(docs.sparkSession, path)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_bytes long, n_tokens long, fit_chars long, over_limit boolean" + ", prefix_counts binary" * keep_prefixes

    def run(batches):
        counter = counter_of(raw.value, pattern)
        for batch in slices(batches, 2000):
            kind = pa.schema([(id_col, batch.column(0).type)] + [(n, pa.int64()) for n in ("n_bytes", "n_tokens", "fit_chars")]
                             + [("over_limit", pa.bool_())] + [("prefix_counts", pa.binary())] * keep_prefixes)
            texts, sizes = columns_of(batch, "text", "size")
            n, fit, stored = [], [], []
            for text in texts:
                counts = counter.counts(text)
                n.append(tokens_at(counts, len(text)))
                fit.append(fit_length(counts, budget))
                if keep_prefixes:
                    stored.append(counts.astype("<i4").tobytes())
            yield batch_of(kind, batch.column(0), sizes, n, fit, [x > budget for x in n], *[stored] * keep_prefixes)

    text = text_or_empty(text_col)
    return map_rows(docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("size")), run, schema)
