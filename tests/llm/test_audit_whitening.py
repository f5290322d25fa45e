"""Operators 11 to 13 against brute force and the tokenizers library."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import PARTS, RAW_JSON, TOKENIZER, ids_of, rows, some_texts

from quarry.llm import backtrack_bpe, filter_audit, queries, whitening

SMOKE = "/root/testdata/sf0.001"


# -- op12 ---------------------------------------------------------------------

def test_backtracking_equals_library():
    enc = backtrack_bpe.encoder_of(RAW_JSON, P.PATTERN)
    for text in some_texts():
        ids = enc.encode(text)
        assert ids.tolist() == ids_of(text)
        assert enc.decode(ids) == text == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(alphabet="aeinorst ", max_size=80)))
def test_backtracking_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert backtrack_bpe.encoder_of(RAW_JSON, P.PATTERN).encode(text).tolist() == ids_of(text)


def small_vocabulary(merges):
    vocab = {c: i for i, c in enumerate("abc")}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    return json.dumps({"model": {"vocab": vocab, "merges": [list(m) for m in merges]}}).encode()


def by_merging(piece, merges):
    """Merge by merge, leftmost first."""
    parts = list(piece)
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if parts[k] == a and parts[k + 1] == b:
                parts[k:k + 2] = [a + b]
            k += 1
    return parts


def test_tokens_that_the_merges_never_give():
    """'abc' = ('a', 'bc') comes last, but 'ab' is merged first in its own bytes: it must never be taken."""
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("a", "a"), ("aa", "aa"), ("ab", "ab")]
    v = backtrack_bpe.MergeVocabulary(small_vocabulary(merges))
    names = {i: b.decode() for i, b in v.bytes_of.items()}
    assert "abc" not in {names[i] for i in v.right}
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            piece = "".join(letters)
            assert [names[i] for i in v.encode_piece(piece.encode())] == by_merging(piece, merges), piece


def test_unordered_merges_are_refused():
    with pytest.raises(ValueError):
        backtrack_bpe.MergeVocabulary(small_vocabulary([("ab", "c"), ("a", "b")]))


def test_nothing_is_remembered(monkeypatch):
    monkeypatch.setattr(backtrack_bpe, "REMEMBER_UNITS", 0)
    monkeypatch.setattr(backtrack_bpe, "REMEMBER_PAIRS", 0)
    enc = backtrack_bpe.BacktrackEncoder(RAW_JSON, P.PATTERN)
    for text in some_texts()[:60]:
        assert enc.encode(text).tolist() == ids_of(text)


@pytest.mark.parametrize("empty", [False, True])
def test_backtracking_query(spark, empty):
    df, texts = rows(spark)
    df, texts = (df.limit(0), []) if empty else (df, texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = backtrack_bpe.encode_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN, digests_only=True).collect()
    want = [(i, len(ids_of(t or "")), sha(",".join(map(str, ids_of(t or "")))), sha(t or "")) for i, t in texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    enc = backtrack_bpe.encode_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN)
    back = backtrack_bpe.decode_documents(enc, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(i), t or "") for i, t in texts)


# -- op11 ---------------------------------------------------------------------

def whitened_plainly(vectors, components=4):
    """{id: (deviation, whitened row)}, n, explained by plain floating point over the distinct integer vectors."""
    x = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {i: (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), (row - s / n) @ u / np.sqrt(e)) for i, row in x.items()}, n, e / np.trace(v)


def check_whitening(got, vectors, components=4):
    want, n, explained = whitened_plainly(vectors, components)
    assert len(got) == components * len(want)
    signs = {}
    for r in sorted(got, key=lambda r: (r.component, str(r.vec_id))):
        deviation, w = want[r.vec_id]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        value = w[r.component - 1]
        if abs(value) > 1e-6:
            assert signs.setdefault(r.component, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
        assert abs(abs(value) - abs(r.whitened)) < 1e-6


def test_whitening_query(spark):
    got = queries.op11_embedding_whitening(spark, SMOKE).collect()
    check_whitening(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()])
    assert dict(queries.op11_embedding_whitening(spark, SMOKE).dtypes)["deviation"] == "bigint"


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(5)
    sound = [(i, rnd.normal(size=6).tolist()) for i in range(80)] + [(900 + i, [0.25] * 6) for i in range(300)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] + [0.0] * 5), (2004, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in sound + odd], "vec_id long, embedding array<double>, component string, n int").repartition(5)
    check_whitening(whitening.whiten(df).collect(), sound)
    assert whitening.whiten(df.filter("vec_id >= 2000")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [2.0, 0.5])], "vec_id long, embedding array<float>")
    assert sorted((r.component, r.vec_id is None) for r in whitening.whiten(null_id).collect()) == [(1, False), (1, True), (1, True), (2, False), (2, True), (2, True)]


def test_whitening_by_length_and_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 3.0])], "vec_id int, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert len(got) == 2 * 2 + 2 * 3
    assert got[1, 1].whitened is None and got[1, 1].explained is None and got[1, 1].identity_error is None and got[1, 1].n == 1
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 2].whitened is None and got[3, 1].identity_error < 1e-12


def test_exact_square_sums():
    rnd = random.Random(2)
    for top in (10, 1 << 30, 1 << 45, 1 << 51, 1 << 58, 1 << 80):
        u = [[rnd.randint(-top, top) for _ in range(3)] for _ in range(1500)]
        kind = object if top > 1 << 60 else np.int64
        assert whitening.column_square_sums(np.array(u, dtype=kind)) == [sum(r[k] ** 2 for r in u) for k in range(3)]
    for value in (0, 1, -1, 10 ** 15, -(10 ** 47) - 3, 10 ** 60 + 7):
        assert sum(d * whitening.DIGIT ** k for k, d in enumerate(whitening.digits(value))) == value


def test_integers_at_the_ends_of_a_long(spark):
    vectors = [(1, [1e300, 0.5]), (2, [-1e300, 0.25]), (3, [1e15, -3.0]), (4, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(vectors, "vec_id int, embedding array<double>"), components=1).collect()
    x = {1: [2 ** 63 - 1, 128], 2: [-2 ** 63, 64], 3: [256 * 10 ** 15, -768], 4: [0, 512]}
    s = [sum(v[k] for v in x.values()) for k in range(2)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    assert max(want.values()) >= 10 ** 38 > min(want.values())
    assert {r.vec_id: None if r.deviation is None else int(r.deviation) for r in got} == {i: v if v < 10 ** 38 else None for i, v in want.items()}
    assert all(r.identity_error < 1e-9 for r in got)


# -- op13 ---------------------------------------------------------------------

def audit_plainly(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
               "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        fails.append((lang or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), sum(f in x[1] for x in mine) - len(removed), sum(x[1] == {f} for x in mine),
                                                    sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def some_documents():
    rnd = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "#tag", "a|b", "é", "x"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rnd.choice(words[7:]) for _ in range(rnd.choice([5, 230, 400]))) for _ in range(25)]
    texts += [" ".join(rnd.choice(words[:4]) for _ in range(250)), "", None, " \t\n", "word " * 30000, "A" * 300, "\x0b".join(words)]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", "de", None])) for i in range(150)]
    docs += [(7, "twice", "en"), (7, "twice", "en"), (7, "twice", "fr"), (7, "other", "en"), (None, "twice", "en"), (9, "twice", "en"), (None, None, "en")]
    docs += [(2000 + i % 40, "hot copy", "en") for i in range(200)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(7, 1, 0), (7, None, 1), (None, 1, 1), (2003, 1, 1), (99999, 1, 1)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


@pytest.mark.parametrize("block, few", [(20_000, 1_000_000), (16, 1_000_000), (16, 0)])
def test_audit(spark, block, few):
    docs, labels = some_documents()
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, lang string, n int, bits string").repartition(6)
    lab = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in filter_audit.audit(d, lab, block=block, few=few).collect()}
    assert got == audit_plainly(docs, labels)


def test_audit_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, lab).count() == 0
    one = spark.createDataFrame([(1, None, None)], d.schema)
    got = filter_audit.audit(one, lab).collect()
    assert len(got) == 600 and {(r.part, r.removed + r.kept + r.redundant >= 0) for r in got} == {("", True)}
    assert sum(r.removed for r in got) == 120
