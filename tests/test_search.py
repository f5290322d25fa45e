import math
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.index import build_text_index
from quarry.operators.search import bm25_search, l1_search

CORPUS = [
    (1, "i1", "pkg/a.py", "f", "function", "def parse tree tree node"),
    (2, "i1", "pkg/b.py", "g", "function", "tree walker visits node"),
    (3, "i1", "docs/README.md", "README", "readme", "parse the tree docs"),
    (4, "i1", "pkg/tests/test_a.py", "t", "function", "parse tree test"),
    (5, "i1", "pkg/a.py", "f", "function", "def parse tree tree node"),   # duplicate element key of id 1
    (6, "i2", "x/c.py", "h", "class", "unrelated words only"),
    (7, "i1", "pkg/c.py", "k", "class", ""),
]


def toks(t):
    return [x for x in re.split(r"[^0-9a-zà-ÿ]+", (t or "").lower()) if x]


def brute_bm25(rows, query, k1=1.2, b=0.75):
    docs = {r[0]: toks(r[2]) + toks(r[5]) for r in rows}
    n = len(docs)
    avg = sum(len(d) for d in docs.values()) / n
    q = Counter(toks(query.translate(str.maketrans(string.punctuation, " " * len(string.punctuation)))))
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        if not q or any(t not in tf for t in q):
            continue
        s = 0.0
        for t, qtf in q.items():
            df = sum(1 for dd in docs.values() if t in dd)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            idf = 1e-6 if idf <= 0 else idf
            s += qtf * idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg))
        out[i] = -s
    return out


def content_df(spark):
    return spark.createDataFrame(
        [(i, inst, fn, name, "", et, "", 0, c) for i, inst, fn, name, et, c in CORPUS],
        "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, "
        "display_level string, split_idx long, content string")


def test_bm25_matches_brute_force(spark):
    c = content_df(spark)
    idx = build_text_index(c)
    queries = ["parse tree", "tree tree", "node!!", "...", "missing", "parse, tree; docs"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(queries)], "query_id long, text string")
    got = bm25_search(idx, c, q, k=10, per_instance=False, dedup=False, score_round=None).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.query_id, {})[r.id] = r.score
    for i, t in enumerate(queries):
        want = brute_bm25(CORPUS, t)
        assert set(by_q.get(i, {})) == set(want), t
        for d, s in want.items():
            assert abs(by_q[i][d] - s) < 1e-9


def test_bm25_dedup_filters_and_k(spark):
    c = content_df(spark)
    idx = build_text_index(c)
    q = spark.createDataFrame([(0, "parse tree")], "query_id long, text string")
    r = bm25_search(idx, c, q, k=5, per_instance=False).orderBy("rank").collect()
    keys = [(x.filename, x.elem_name) for x in r]
    assert len(keys) == len(set(keys))                # id 5 collapsed into id 1
    r2 = bm25_search(idx, c, q, k=5, per_instance=False, elem_type="code", in_dirs=["pkg"]).collect()
    assert {x.id for x in r2} <= {1, 5}                 # readme, tests/ dropped
    r3 = bm25_search(idx, c, q, k=1, per_instance=False).collect()
    assert len(r3) == 1


def test_bm25_per_instance(spark):
    c = content_df(spark)
    idx = build_text_index(c)
    q = spark.createDataFrame([(0, "i2", "words"), (1, "i1", "words")], "query_id long, instance_id string, text string")
    r = bm25_search(idx, c, q, k=5, per_instance=True).collect()
    assert [(x.query_id, x.id) for x in r] == [(0, 6)]


def test_l1_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, "A" if i < 25 else "B", f"f{i // 3}.py", f"e{i}", "", "function", "", 0, vecs[i].tolist()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, instance_id string, filename string, elem_name string, parent_name string, "
                                         "elem_type string, display_level string, split_idx long, embedding array<float>")
    qv = rng.normal(size=(3, 8))
    q = spark.createDataFrame([(0, "A", qv[0].tolist()), (1, "B", qv[1].tolist()), (2, "A", qv[2].tolist())],
                              "query_id long, instance_id string, qvec array<double>")
    got = l1_search(corpus, q, k=4, dedup=False).orderBy("query_id", "rank").collect()
    for qi, inst in [(0, "A"), (1, "B"), (2, "A")]:
        ids = [i for i in range(40) if (i < 25) == (inst == "A")]
        d = {i: float(np.abs(vecs[i].astype(np.float64) - qv[qi]).sum()) for i in ids}
        want = sorted(ids, key=lambda i: (round(d[i], 6), i))[:4]
        assert [r.id for r in got if r.query_id == qi] == want
    by_file = l1_search(corpus, q, k=4, dedup_by_file=True).collect()
    for qi in range(3):
        files = [r.filename for r in by_file if r.query_id == qi]
        assert len(files) == len(set(files))


def test_accents_do_not_matter(spark):
    rows = [(1, "a.py", "un café noir"), (2, "b.py", "a cafe"), (3, "c.py", "tea")] + [(k, f"{k}.py", "filler words") for k in range(10, 20)]
    c = spark.createDataFrame([(i, "i", f, f, "", "module", "", 0, t) for i, f, t in rows], content_df(spark).schema)
    q = spark.createDataFrame([(1, "cafe"), (2, "CAFÉ"), (3, "café")], "query_id long, text string")
    got = {(r.query_id, r.id) for r in bm25_search(build_text_index(c), c, q, per_instance=False).collect()}
    assert got == {(k, i) for k in (1, 2, 3) for i in (1, 2)}


def test_directories_of_each_query(spark):
    from quarry.operators.search import in_query_dirs
    paths = ["pkg/a.py", "pkg/tests/b.py", "PKG/c.py", "docs/x.md", "p_g/d.py", "pxg/e.py", "%/f", "", "dé/g"]
    dirs = [(1, "pkg/"), (1, "docs"), (2, "P_G"), (3, ""), (4, "%"), (5, None), (6, "none/"), (7, "pkg/"), (7, "pkg"), (8, "dé"), (9, "%tests")]
    rows = spark.createDataFrame([(q, i, p) for q in range(1, 11) for i, p in enumerate(paths)], "query_id long, id long, filename string")
    d = spark.createDataFrame(dirs, "query_id long, dir string")
    for wild in (False, True):
        def inside(p, x):
            if not wild:
                return p.lower().startswith(x.lower())
            return re.match("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in x.lower()), p.lower(), re.S) is not None
        own = {q: [x for k, x in dirs if k == q and x is not None] for q in range(1, 11)}
        want = {(q, i) for q in range(1, 11) for i, p in enumerate(paths) if not own[q] or any(inside(p, x) for x in own[q])}
        got = [(r.query_id, r.id) for r in in_query_dirs(rows, d, wild).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    c = content_df(spark)
    q = spark.createDataFrame([(1, "parse tree"), (2, "parse tree")], "query_id long, text string")
    t = spark.createDataFrame([(1, "docs/"), (1, "pkg/tests/")], "query_id long, dir string")
    got = {(r.query_id, r.id) for r in bm25_search(build_text_index(c), c, q, per_instance=False, dedup=False, in_dirs=t).collect()}
    assert got == {(1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (2, 5)}
    vec = spark.createDataFrame([(i, "i", p, "e", "", "function", 0, [float(i)]) for i, p in enumerate(paths)],
                                "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, split_idx long, embedding array<double>")
    qv = spark.createDataFrame([(1, "i", [0.0]), (2, "i", [0.0])], "query_id long, instance_id string, qvec array<double>")
    near = {(r.query_id, r.id) for r in l1_search(vec, qv, k=2, in_dirs=spark.createDataFrame([(1, "docs"), (1, "pxg")], "query_id long, dir string")).collect()}
    assert near == {(1, 3), (1, 5), (2, 0), (2, 1)}


def test_pivots_leave_the_answer_and_most_rows_out(spark):
    from quarry.operators import search
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 20
    vecs = [(i, "hot" if i % 3 else f"i{i % 5}", f"f{i // 2}", "e", "", "function", 0, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(1500)]
    vecs += [(5000 + i, "hot", "same", "e", "", "function", 0, centres[0].tolist()) for i in range(40)] + [(6000, "hot", "exact", "e", "", "function", 0, [])]
    c = spark.createDataFrame(vecs, "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, split_idx long, embedding array<double>")
    q = spark.createDataFrame([(k, "hot" if k < 6 else "i1", (centres[k % 12] + 0.1).tolist()) for k in range(8)] + [(99, "none", [0.0] * 8)],
                              "query_id long, instance_id string, qvec array<double>")
    pivots = search.choose_pivots(c, 6)
    stored = c.withColumn("pivot_distances", search.pivot_distances("embedding", pivots))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    for k, dedup in ((4, True), (30, False), (4000, False)):
        want = rows(l1_search(c, q, k=k, dedup=dedup))
        assert rows(l1_search(stored, q, k=k, dedup=dedup, pivots=pivots)) == want
    cand = stored.where("size(embedding) > 0")
    tested = search.pivot_candidates(cand, q, pivots, 12).count()
    assert tested < 0.3 * cand.join(q, "instance_id").count()


def test_salted_blocks_give_the_same_rows(spark, monkeypatch):
    from quarry.operators import search
    rng = np.random.default_rng(3)
    c = spark.createDataFrame([(i, "hot" if i % 4 else "b", f"f{i}", "e", "", "function", 0, rng.normal(size=4).tolist()) for i in range(300)],
                              "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, split_idx long, embedding array<double>")
    q = spark.createDataFrame([(k, "hot" if k % 2 else "b", rng.normal(size=4).tolist()) for k in range(6)], "query_id long, instance_id string, qvec array<double>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    want = rows(l1_search(c, q, k=5))
    monkeypatch.setattr(search, "broadcast_if_small", lambda df: df)
    pivots = search.choose_pivots(c, 3)
    stored = c.withColumn("pivot_distances", search.pivot_distances("embedding", pivots))
    assert rows(l1_search(c, q, k=5, block_rows=20)) == want == rows(l1_search(stored, q, k=5, pivots=pivots, block_rows=20))


def test_documents_of_many_splits_move_before_their_tokens(spark, tmpdir_path):
    from quarry.plans.search_plans import postings
    docs = spark.createDataFrame([(i, f"a b {i}", "en", "s", 5) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(16).write.parquet(tmpdir_path + "/documents.parquet")
    plan = postings(spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Generate")  # below every explode
