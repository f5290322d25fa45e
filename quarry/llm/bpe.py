"""Byte-level BPE vocabularies and exact encoding of whole texts.

A vocabulary file is read once on the driver (a bounded file of a few MB) and
broadcast; workers build the encoder from the bytes and keep it.

``TreeEncoder`` encodes by a monoid tree reduction: a long text is halved until
its parts are short, the parts are encoded, and neighbours are joined by
re-encoding a window around the seam that grows until the tokens outside it
cannot change:

* A position whose left character is not white space and whose right character
  is a space or line feed is a cut of the splitting pattern whatever surrounds
  it (no alternative of the pattern matches across it).  Tokens never cross a
  cut, so a window between two such positions settles the seam.
* Without such a position nearby (one endless word), the merge works inside a
  piece on bytes: a sequence of tokens is the encoding of its bytes when each
  adjacent pair of tokens is the encoding of that pair's bytes.  The window
  grows until its outer pairs pass that test.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from array import array

import numpy as np
import regex
import tiktoken
from pyspark.sql import SparkSession

#: Texts up to this many characters are leaves of the tree, encoded in one call; longer ones are halved.
LEAF_CHARS = 512
#: Pieces (matches of the pattern) up to this many bytes are merged in one call.
LEAF_BYTES = 1024

_CUT = re.compile(r"\S[ \n]")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in .json vocabularies: bytes that print stand for themselves, the others for 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def parse_vocabulary(raw: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte strings, special tokens) of a rank file or a byte-level .json file."""
    if raw.lstrip()[:1] != b"{":
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}, {}
    j = json.loads(raw)
    special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
    byte = _byte_alphabet()
    ranks = {bytes(byte[c] for c in tok): i for tok, i in j["model"]["vocab"].items() if tok not in special}
    return ranks, special


class TreeEncoder:
    """Whole-text encoder of one vocabulary; ids come as numpy uint32 arrays."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], pattern: str):
        self.ranks, self.special = ranks, special
        self.enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.core = self.enc._core_bpe
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    # -- texts ---------------------------------------------------------------
    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of an ordinary text, special strings read as plain text."""
        return self._tree(text, 0, len(text))

    def encode_with_special(self, text: str) -> np.ndarray:
        """Ids of a text whose special strings become their own ids."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.encode(text)
        parts = [np.array([self.special[p]], dtype=np.uint32) if p in self.special else self.encode(p)
                 for p in self.split_special.split(text)]
        return np.concatenate(parts)

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        if a == mid or b == mid:
            return np.concatenate([left, right])
        drop_left, drop_right = len(self._window(text[a:mid])), len(self._window(text[mid:b]))
        return np.concatenate([left[:len(left) - drop_left], self._window(text[a:b]), right[drop_right:]])

    def _cut_before(self, text: str, lo: int, mid: int) -> int:
        """The last sure cut at or before mid; lo if there is none."""
        size = 32
        while True:
            start = max(lo, mid - size)
            last = None
            for m in _CUT.finditer(text, start, mid):
                last = m
            if last is not None:
                return last.start() + 1
            if start == lo:
                return lo
            size *= 2

    def _cut_after(self, text: str, mid: int, hi: int) -> int:
        """The first sure cut at or after mid; hi if there is none."""
        m = _CUT.search(text, mid - 1, hi)
        return m.start() + 1 if m else hi

    def _window(self, text: str) -> np.ndarray:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        return np.concatenate([self.piece(m.group().encode()) for m in self.pattern.finditer(text)])

    # -- one piece -------------------------------------------------------------
    def piece(self, data: bytes) -> np.ndarray:
        if len(data) <= LEAF_BYTES:
            return np.array(self.core.encode_single_piece(data), dtype=np.uint32)
        mid = len(data) // 2
        return self._join_piece(self.piece(data[:mid]), self.piece(data[mid:]))

    def _join_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = 4
        while True:
            kl, kr = min(k, len(left)), min(k, len(right))
            seam = self.decode(left[len(left) - kl:]) + self.decode(right[:kr])
            if kl == len(left) and kr == len(right) or len(seam) <= LEAF_BYTES:
                mid = np.array(self.core.encode_single_piece(seam), dtype=np.uint32)
            else:
                half = len(seam) // 2
                mid = self._join_piece(self.piece(seam[:half]), self.piece(seam[half:]))
            if (kl == len(left) or self.pair_holds(int(left[-kl - 1]), int(mid[0]))) and (
                    kr == len(right) or self.pair_holds(int(mid[-1]), int(right[kr]))):
                return np.concatenate([left[:len(left) - kl], mid, right[kr:]])
            k *= 2

    def pair_holds(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        return self._pair(a, b)

    @functools.lru_cache(1 << 17)  # noqa: B019  one encoder lives as long as its worker
    def _pair(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    # -- back to bytes -----------------------------------------------------------
    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: halves are decoded and concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return self.core.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class UnitCache(dict):
    """Ids (bytes, little-endian uint32) of the units of a text split at single spaces.

    A unit is a space and the characters up to the next one.  Where neither end of
    those characters is white space, the unit starts and ends at sure cuts, so its
    ids do not depend on its neighbours; None marks the others.  The cache holds
    the first ``limit`` distinct units; further ones are encoded each time.
    """

    def __init__(self, encoder: TreeEncoder, limit: int = 120_000):
        super().__init__()
        self.encoder, self.limit = encoder, limit

    def __missing__(self, unit: str):
        if not unit or unit[0].isspace() or unit[-1].isspace() or len(unit) > LEAF_CHARS:
            return None
        core = self.encoder.core
        if unit.isascii() and unit.isalpha():
            ids = core.encode_single_piece(b" " + unit.encode())
        else:
            ids = core.encode_ordinary(" " + unit)
        value = array("I", ids).tobytes()
        if len(self) < self.limit:
            self[unit] = value
        return value

    def encode(self, text: str) -> bytes:
        """Ids of an ordinary text; texts with odd spacing go through the tree."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and len(first) <= LEAF_CHARS:
            head = array("I", self.encoder.core.encode_ordinary(first)).tobytes()
            try:
                return head + b"".join(map(self.__getitem__, rest))
            except TypeError:  # a unit without ids of its own
                pass
        return self.encoder.encode(text).astype("<u4").tobytes()

    def encode_with_special(self, text: str) -> bytes:
        e = self.encoder
        if e.split_special is None or not any(s in text for s in e.special):
            return self.encode(text)
        return b"".join(array("I", [e.special[p]]).tobytes() if p in e.special else self.encode(p)
                        for p in e.split_special.split(text))


_ENCODERS: dict[str, TreeEncoder] = {}
_UNITS: dict[str, UnitCache] = {}


def encoder_of(raw: bytes, pattern: str) -> TreeEncoder:
    """The worker's encoder of a vocabulary's bytes, built once a process."""
    key = hashlib.md5(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(*parse_vocabulary(raw), pattern)
        _UNITS[key] = UnitCache(_ENCODERS[key])
    return _ENCODERS[key]


def units_of(raw: bytes, pattern: str) -> UnitCache:
    encoder_of(raw, pattern)
    return _UNITS[hashlib.md5(raw + pattern.encode()).hexdigest()]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The file's bytes for the workers; a vocabulary is a few MB whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
