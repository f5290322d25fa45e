"""Operators 2, 4 and 5 against the tokenizer libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, byte_bpe, packing, token_counts

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RAW_JSON = open(P.path("byte_bpe_50k.json"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'s", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "<|", "\xa0",
         "\x1c", " ", " word", "🙂", "\r\n", "'''", "don't", " 'll "]


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def some_texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    long = ["".join(rnd.choice(PARTS) for _ in range(9000)), "a" * 20000, "ab" * 9000, " " * 20000, "\n" * 9000 + "x", "é" * 9000, "a b" * 7000,
            "".join(rnd.choice("abcdefgh") for _ in range(20000))]
    return made + long


def test_vocabularies_agree():
    ranks, special = bpe.parse_vocabulary(RAW_JSON)
    assert ranks == RANKS and special == {"<|endoftext|>": 50256}


def test_tree_equals_library():
    enc = bpe.encoder_of(RAW, P.PATTERN)
    for text in some_texts():
        ids = enc.encode(text)
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60))
def test_joins_at_every_seam(parts):
    """Small leaves: every seam of the tree is joined by windows."""
    text = "".join(parts)
    enc = bpe.encoder_of(RAW, P.PATTERN)
    leaf, piece = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = 3, 4
    try:
        got = enc.encode(text).tolist()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = leaf, piece
    assert got == TIKTOKEN.encode_ordinary(text)


def test_units_equal_library():
    units = bpe.units_of(RAW_JSON, P.PATTERN)
    for text in some_texts():
        assert np.frombuffer(units.encode_with_special(text), "<u4").tolist() == ids_of(text)


def test_every_prefix_count():
    counter = token_counts.counter_of(RAW_JSON, P.PATTERN)
    for text in some_texts()[:120]:
        counts = counter.counts(text)
        assert counts.tolist() == [len(ids_of(text[:i])) for i in range(1, len(text) + 1)]
        for budget in (0, 1, 5, 10 ** 6):
            fits = [i for i in range(len(text) + 1) if (counts[i - 1] if i else 0) <= budget]
            assert token_counts.fit_length(counts, budget) == max(fits)


def rows(spark, with_extra=True):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "the cat's hat  <|endoftext|>\n x"), (4, "the cat's hat  <|endoftext|>\n x"), (None, "é日本 🙂"),
             (5, " ".join(f"word{i % 97}" for i in range(30000))), (6, "x" * 5000)]
    made = [(i, t, 9, "q", b"z") for i, t in texts]
    df = spark.createDataFrame(made, "doc_id long, text string, n_tokens int, worker string, ids binary")
    return df, texts


@pytest.mark.parametrize("empty", [False, True])
def test_encode_query(spark, empty):
    df, texts = rows(spark)
    df, texts = (df.limit(0), []) if empty else (df, texts)
    got = byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests_only=True).collect()
    want = []
    for i, t in texts:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decode_documents(spark):
    df, texts = rows(spark)
    enc = byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = byte_bpe.decode_documents(enc, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(i), t or "") for i, t in texts)


def test_count_query(spark):
    df, texts = rows(spark)
    got = token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN, 512, keep_prefixes=True).collect()
    want = [(i, len((t or "").encode()), len(ids_of(t or "")), len(ids_of(t or "")) > 512) for i, t in texts]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        counts = np.frombuffer(r.prefix_counts, "<i4")
        assert token_counts.tokens_at(counts, len(counts)) == r.n_tokens
    assert token_counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN, 512).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 409, 682, 683, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 123457])
def test_cut_lengths(n):
    pieces = packing.cut_lengths(n)
    assert sum(p for p, _ in pieces) == n
    for length, k in pieces:
        assert 0 < length * k <= 2048 and (length * k * 128 >= 2048 * 127 - 128 * k)


def check_packed(got, texts, capacity):
    got = [r.asDict() for r in got]
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    total = 0
    for i, t in {(i, t) for i, t in texts}:
        ids = np.array([*ids_of(t or ""), 1], "<u4")
        copies = sum((a, b) == (i, t) for a, b in texts)
        total += len(ids) * copies
        spans = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[(i, len(ids))])
        covered = [0] * len(ids)
        for s, n, crc in spans:
            assert crc == zlib.crc32(ids[s:s + n].tobytes())
            for k in range(s, s + n):
                covered[k] += 1
        assert set(covered) == {copies}
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sum(r["length"] for r in got) == total
    return padding, total


@pytest.mark.parametrize("parts,fan_in", [(1, 256), (3, 2), (7, 2)])
def test_packing(spark, parts, fan_in):
    df, texts = rows(spark)
    # every (id, length) pair must be unique for the check
    got = packing.pack_documents(df.repartition(parts), P.path("byte_bpe_50k.json"), P.PATTERN, fan_in=fan_in).collect()
    padding, total = check_packed(got, texts, 2048)
    assert padding <= total / 64


def test_packing_many_documents(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice(["a", "the", "word", "x1", "!"]) for _ in range(rnd.randint(0, 900)))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN, fan_in=2, keep_ids=True).collect()
    padding, total = check_packed(got, texts, 2048)
    assert padding <= total / 100
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_packing_empty(spark):
    df, _ = rows(spark)
    assert packing.pack_documents(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
