"""BPE encoding and decoding of whole texts with a backtracking encoder.

A merge vocabulary where each token has one merge, and each merge comes after
those of its two parts, encodes a piece (one match of the splitting pattern) in
the only way in which every two neighbours are *compatible*: no merge that takes
the end of the left token and the start of the right one would have come before
both had grown.  So the encoder walks the piece once:

* an Aho-Corasick pass gives the longest token at the start and after each longest
  token; where all neighbours are compatible, this is the encoding;
* otherwise a second pass gives the longest token from each byte on, and a token is
  taken when it is compatible with the one before it, else the longest shorter token
  with the same start is tried;
* where none is left the walk steps back over the last token and marks the
  position dead.  A position dies once, so the walk is linear in the piece.

Compatibility comes from the tokens' *edges*: the parts at a token's right (left)
end with the rank of the merge that consumed each.  The answers fill a table as
pairs turn up.  Tokens that the merges never give (their own bytes encode
otherwise) are found by the same rule and left out of the automaton.

Decoding reads an offset table: the bytes of all tokens in one array, and where
each begins.

Every text is encoded and decoded in the task that reads it: one Arrow-batched
stage, no shuffle, memory in proportion to the batch.

Defined results: a null text counts as empty; an empty text has no ids;
repeated rows give repeated rows; null ids stay null; other columns are ignored,
whatever their names; texts and pieces may have any length; an empty table gives
an empty table.  Special strings inside texts become their own ids, as the
tokenizers library does by default, and come back as those strings.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import _byte_alphabet, broadcast_vocabulary
from quarry.llm.common import batch_of, columns_of, map_rows, slices, text_or_empty

#: Distinct units of text and token pairs that a worker remembers; further ones are worked out each time.
REMEMBER_UNITS = 200_000
REMEMBER_PAIRS = 500_000
#: Longer units are not remembered (characters).
LONGEST_REMEMBERED = 48
#: Rank of what no merge consumes.
NEVER = 1 << 60


class MergeVocabulary:
    """Tokens, merges and their compatibility, of one byte-level .json vocabulary."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        byte = _byte_alphabet()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own = {as_bytes(s): i for s, i in vocab.items() if s not in self.special}
        self.bytes_of = {i: b for b, i in own.items()}
        #: (left id, right id) -> rank of their merge
        self.rank: dict[tuple[int, int], int] = {}
        #: id -> (rank, left id, right id) of the merge that makes it
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            new = vocab[left + right]
            if new in self.made or any(p in self.made and self.made[p][0] >= rank or p not in self.made and len(self.bytes_of[p]) > 1 for p in (a, b)):
                raise ValueError(f"merge {rank} is out of order or makes a token anew: the encoding would not be unique")
            self.rank[a, b] = rank
            self.made[new] = (rank, a, b)
        self.pairs: dict[int, bool] = {}
        self._edges()
        self._offsets()

    def _edges(self) -> None:
        """Right and left edges of each token that the merges do give, and the automaton of those tokens.

        An edge lists (part, rank of the merge that consumed it), the whole token first.
        """
        self.right = {i: [(i, NEVER)] for i, b in self.bytes_of.items() if len(b) == 1}
        self.left = {i: [(i, NEVER)] for i in self.right}
        for token, (rank, a, b) in sorted(self.made.items(), key=lambda kv: kv[1][0]):
            if a in self.right and b in self.right and self._meet(a, b, rank):
                self.right[token] = [(token, NEVER), (b, rank), *self.right[b][1:]]
                self.left[token] = [(token, NEVER), (a, rank), *self.left[a][1:]]
        self.id_of = {self.bytes_of[t]: t for t in self.right}
        self.size = [len(self.bytes_of.get(t, b"")) for t in range(max(self.right) + 1)]
        #: the longest shorter token with the same start; -1: none
        self.shorter = [-1] * len(self.size)
        self.automaton = ahocorasick.Automaton()
        for data, token in self.id_of.items():
            self.automaton.add_word(data.decode("latin-1"), token)
            self.shorter[token] = next((self.id_of[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.id_of), -1)
        self.automaton.make_automaton()

    def _meet(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of rank under ``before`` reaches across the seam of ``a`` and ``b``.

        A merge (x, y) reaches across when x is still the end of ``a`` and y the start of
        ``b`` at its rank; among equal pairs the leftmost goes first, so at x's own rank x
        is gone already and at y's own rank y is still there.
        """
        rank = self.rank
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                m = rank.get((x, y))
                if m is not None and m < before and m < x_gone and m <= y_gone:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._meet(a, b)
            if len(self.pairs) < REMEMBER_PAIRS:
                self.pairs[key] = known
        return known

    def _offsets(self) -> None:
        """Offset table: ``blob[offset[i]:offset[i + 1]]`` are the bytes of id ``i``."""
        byte = _byte_alphabet()
        own = dict(self.bytes_of)
        for s, i in self.special.items():
            own[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        top = max(own, default=-1) + 1
        self.blob = np.frombuffer(b"".join(own.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(own.get(i, b"")) for i in range(top)])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        end = np.cumsum(size)
        if not len(ids):
            return b""
        return self.blob[np.repeat(start - (end - size), size) + np.arange(end[-1])].tobytes()

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        text = data.decode("latin-1")
        pairs, before, greedy = self.pairs, -1, []
        for _, token in self.automaton.iter_long(text):
            if before >= 0:
                fits = pairs.get(before << 32 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    return self._backtrack(text)
            greedy.append(token)
            before = token
        return greedy

    def _backtrack(self, text: str) -> list[int]:
        n, size, shorter, compatible, known = len(text), self.size, self.shorter, self.compatible, self.pairs.get
        longest = [0] * n
        for end, token in self.automaton.iter(text):
            longest[end + 1 - size[token]] = token  # ends rise, so the longest comes last
        dead = bytearray(n + 1)
        taken: list[int] = []
        pos, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = pos + size[token]
                if not dead[end]:
                    fits = before < 0 or known(before << 32 | token)
                    if fits or fits is None and compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                if end == n:
                    return taken
                pos, before, token = end, token, longest[end]
            else:
                dead[pos] = 1
                token = taken.pop()
                pos -= size[token]
                before = taken[-1] if taken else -1


class _Units(dict):
    """Ids (bytes, little-endian uint32) of the units of a text split at single spaces: a space and what follows up to the next one.

    The splitting pattern matches across no position between a character that is not
    white space and a space, so a unit whose characters neither start nor end with
    white space is encoded alone; None marks the others.
    """

    def __init__(self, vocabulary: MergeVocabulary, findall):
        super().__init__()
        self.vocabulary, self.findall = vocabulary, findall
        self.marks = {c: self.whole(c) for c in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        encode = self.vocabulary.encode_piece
        return b"".join([array("I", encode(piece.encode())).tobytes() for piece in self.findall(text)])

    def __missing__(self, unit: str) -> bytes | None:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        if unit.isalpha():
            ids = array("I", self.vocabulary.encode_piece((" " + unit).encode())).tobytes()
        elif unit[-1] in self.marks and unit[:-1].isalpha():  # the word is remembered, not each of its endings
            return self[unit[:-1]] + self.marks[unit[-1]]
        else:
            ids = self.whole(" " + unit)
        if len(self) < REMEMBER_UNITS and len(unit) <= LONGEST_REMEMBERED:
            self[unit] = ids
        return ids


class BacktrackEncoder:
    """Whole texts to ids (numpy uint32) and back."""

    def __init__(self, raw: bytes, pattern: str):
        self.vocabulary = MergeVocabulary(raw)
        self.units = _Units(self.vocabulary, regex.compile(pattern).findall)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def encode(self, text: str) -> np.ndarray:
        known = self.vocabulary.special
        if self.special is None or not any(s in text for s in known):
            ids = self._plain(text)
        else:
            ids = b"".join([array("I", [known[p]]).tobytes() if p in known else self._plain(p) for p in self.special.split(text)])
        return np.frombuffer(ids, dtype="<u4")

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.units.whole(first) + b"".join(map(self.units.__getitem__, rest))
            except TypeError:  # a unit without ids of its own
                pass
        return self.units.whole(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.decode(ids).decode("utf-8", "replace")


_ENCODERS: dict[str, BacktrackEncoder] = {}


def encoder_of(raw: bytes, pattern: str) -> BacktrackEncoder:
    """The worker's encoder of a vocabulary's bytes, built once a process."""
    key = hashlib.md5(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BacktrackEncoder(raw, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     digests_only: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: each document's ids and the text that they give back.

    With ``digests_only``: ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8) in place of the two.
    """
    raw = broadcast_vocabulary(docs.sparkSession, path)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string")

    def digest(data: str) -> str:
        return hashlib.sha256(data.encode()).hexdigest()

    def run(batches):
        enc = encoder_of(raw.value, pattern)
        for batch in slices(batches, 1000):
            texts, = columns_of(batch, "text")
            n, left, right = [], [], []
            for text in texts:
                ids = enc.encode(text)
                back = enc.decode(ids)
                n.append(len(ids))
                left.append(digest(str(ids.tolist())[1:-1].replace(" ", "")) if digests_only else ids)
                right.append(digest(back) if digests_only else back)
            kinds = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests_only else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
            yield batch_of(pa.schema([(id_col, batch.column(0).type), ("n_tokens", pa.int64()), *kinds]), batch.column(0), n, left, right)

    return map_rows(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, decoded)``; null ids decode to the empty text."""
    raw = broadcast_vocabulary(encoded.sparkSession, path)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder_of(raw.value, pattern)
        for batch in slices(batches, 1000):
            ids, = columns_of(batch, "ids")
            yield batch_of(pa.schema([(id_col, batch.column(0).type), ("decoded", pa.string())]), batch.column(0), [enc.decode(np.array(x or [], dtype=np.int64)) for x in ids])

    return map_rows(encoded.select(F.col(id_col), F.col("ids")), run, f"{id_col} {id_type}, decoded string")
