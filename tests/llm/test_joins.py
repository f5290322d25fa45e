"""Operators 3 and 10 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from quarry.llm import lattice, ngram_join
from quarry.llm.components import components


def reach(n, pairs):
    """Least index reachable from each."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    root = reach(600, pairs)
    assert got == {i: root[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(df.limit(0)).count() == 0


# -- n-gram Jaccard ------------------------------------------------------------

def plain_sets(texts, k=5):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    texts = [None, "", "  \n", "One two", "one TWO", "one two three four five", "É ä", "é ä"]
    passage = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(20, 200))]
        if rnd.random() < 0.5:
            base = base[:40] + passage + base[40:]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w = w[:int(len(w) * rnd.uniform(0.7, 1))]
            texts.append(rnd.choice([" ", "\n", " \t"]).join(w))
    texts += [texts[10]] * 30
    return texts


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 6)
    texts = corpus()
    sets = plain_sets(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = reach(len(texts), pairs)
    rows = [(i * 3, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[12], 0, "x"), (30, texts[10], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, digest string").repartition(4)
    got = sorted([tuple(r) for r in ngram_join.jaccard_components(df, block=block).collect()], key=str)
    want = [(i * 3, len(sets[i]), root[i] * 3) for i in range(len(texts))] + [(None, len(sets[12]), None), (30, len(sets[10]), root[10] * 3)]
    assert got == sorted(want, key=str)


def test_keep_one_each_of_rows_that_share_an_id(spark):
    t = {k: " ".join(f"{k}{i}" for i in range(20)) for k in "abcdef"}
    near = t["e"] + " more"
    rows = [(5, t["b"]), (30, t["b"]), (30, t["a"]), (40, t["c"]), (40, t["d"]), (40, t["d"]), (50, t["e"]), (50, near), (60, near), (70, ""), (70, " "), (70, ""), (71, None), (None, t["a"]), (None, t["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((str(r.doc_id), r.text) for r in ngram_join.keep_one_each(df).collect()), key=str)
    of_50 = [x for x in got if x[0] == "50"]
    assert len(of_50) == 1 and of_50[0][1] in (t["e"], near)
    assert [x for x in got if x[0] != "50"] == sorted([("5", t["b"]), ("30", t["a"]), ("40", t["c"]), ("40", t["d"]), ("70", ""), ("70", " "), ("71", None), ("None", t["a"]), ("None", t["a"])], key=str)


def test_keep_one_each(spark):
    texts = corpus()
    sets = plain_sets(texts)
    root = reach(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
                              and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(None, "a b", "y"), (9, texts[9], "y")], "doc_id long, text string, _kept_id string")
    kept = ngram_join.keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i in range(len(texts)) if root[i] == i] + [None], key=str)


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(df).count() == 0 and ngram_join.keep_one_each(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(only).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmap_bound_is_an_upper_bound():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 500, rnd.integers(1, 300)).astype(np.uint64))
        b = np.unique(rnd.integers(0, 500, rnd.integers(1, 300)).astype(np.uint64))
        bits = [ngram_join._unpacked([ngram_join.signature(s, ngram_join.bits_for(len(s)))], 256)[0] for s in (a, b)]
        bound = (len(a) + len(b) - np.abs(bits[0] - bits[1]).sum()) / 2
        assert len(np.intersect1d(a, b)) <= bound


# -- lattice ---------------------------------------------------------------------

def test_nearest_e8_point():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, 8)) * 2
    p = lattice.nearest_e8(x)
    assert ((p * 2) % 1 == 0).all() and ((p.sum(axis=1) % 2) == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # covering radius
    for v in lattice._neighbours():
        assert (d <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


def vectors():
    rnd = np.random.default_rng(5)
    out, labels = [], []
    for k in range(60):
        base = rnd.standard_normal(64)
        for _ in range(rnd.integers(1, 8)):
            noise = rnd.standard_normal(64)
            noise -= noise @ base / (base @ base) * base
            angle = np.arccos(rnd.uniform(0.985, 1))
            out.append(base / np.linalg.norm(base) * np.cos(angle) + noise / np.linalg.norm(noise) * np.sin(angle))
            labels.append(k % 3)
    out += [out[0]] * 5
    labels += [labels[0]] * 5
    return [v.astype(np.float32) for v in out], labels


@pytest.mark.parametrize("block", [1024, 4])
def test_lattice(spark, block):
    vs, labels = vectors()
    n = len(vs)
    x = np.stack([v.astype(np.float64) for v in vs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    pairs = [(i, j) for i in range(n) for j in range(i) if labels[i] == labels[j] and s[i, j] >= 0.98]
    odd = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [None] * 64, 1), (n + 4, vs[0].tolist(), None), (n + 5, [], 1),
           (n + 6, [float("inf")] + [1.0] * 63, 1), (n + 7, [1.0, 2.0], 1)]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(vs, labels))] + odd
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, copies int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df, block=block).collect()}
    links = [0] * n
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert len(got) == len(rows)
    for i, *_ in odd:
        assert got[i] == (0, i, True)
    found = sum(got[i][0] for i in range(n))
    assert all(got[i][0] <= links[i] for i in range(n)) and found >= 0.97 * sum(links)
    if found == sum(links):
        root = reach(n, pairs)
        assert all(got[i][1] == root[i] for i in range(n))


def test_lattice_recall_at_the_threshold():
    """Pairs at cosine 0.98 exactly, in random directions: the hardest ones to meet."""
    rnd = np.random.default_rng(2)
    a = rnd.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rnd.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    salt = np.zeros(2000, dtype=np.uint64)
    meet = lattice._first_meeting(lattice.cells(a, salt, lattice.TABLES, lattice.PROBES, lattice.SCALE),
                                  lattice.cells(b, salt, lattice.TABLES, lattice.PROBES, lattice.SCALE))
    assert (meet != np.uint64(2 ** 64 - 1)).mean() >= 0.99


def test_lattice_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
