"""What queries move and write: texts once, postings that are asked for only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import apply, search
from quarry.operators.elements import element_displays, extract_elements, index_rows, indexed
from quarry.operators.index import build_text_index
from quarry.operators.lookup import exact_lookups, looked_up
from quarry.operators.patches import parse_patches
from quarry.session import write_table


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Reused)Exchange \w*hashpartitioning|(?<!Reused)Exchange hashpartitioning", plan))


SRC = "import os\n\n\ndef f(x):\n    return x\n\n\nclass A:\n    # note\n    def get(self):\n        return 1\n\n    B = 2\n\n\ndef f(y):\n    return y\n"


def sources(spark):
    return spark.createDataFrame([("i", "m.py", SRC), ("i", "n.py", SRC.replace("A:", "Z:")), ("j", "m.py", SRC), ("j", "bad.py", "def (:\n"), ("k", "twice.py", SRC), ("k", "twice.py", SRC),
                                  (None, "m.py", SRC)], "instance_id string, filename string, content string")


def test_displays_move_a_file_once(spark):
    """F1 staged_lookup: displays were exploded by level and joined with their children, so texts were shuffled five times."""
    files = sources(spark)
    elements = write_table(extract_elements(files), "elements")
    d = element_displays(elements, files, numbered=True)
    assert shuffles(d) == 2
    got = {(r.instance_id, r.filename, r.elem_type, r.elem_name, r.ord, r.display_level): r.display for r in d.where("instance_id != 'k'").collect()}
    assert got["i", "m.py", "class", "A", 2, "moderate"] == " 8 |class A:\n 9 |    # note\n 9 |    # note\n10 |    def get(self):\n\n13 |    B = 2\n\n"
    assert got["i", "n.py", "module", "n.py", 0, "signature"].startswith(" 2 |import os\n".replace("2", "1") + "\n 4 |def f(x):\n")
    assert got["j", "bad.py", "module", "bad.py", 0, "minimal"] == "def (:\n"
    assert d.where("instance_id IS NULL").count() == 0
    # a file that is there twice gives each of its elements four times (twice in the elements, twice in the files)
    assert d.where("instance_id = 'k' AND elem_type = 'class'").groupBy("display_level").count().collect()[0][1] == 4


@pytest.mark.parametrize("in_file", [False, True])
def test_displays_that_are_read_are_enough(spark, in_file):
    """F1 staged_lookup: all levels were written, a third of them is read."""
    files = sources(spark).where("instance_id != 'k'")
    d = write_table(element_displays(extract_elements(files), files, numbered=True), "displays")
    q = spark.createDataFrame([(1, "i", "function", "f", None, None, "m.py", None, None), (2, "i", "method", None, "A", "get", "m.py", None, None), (3, "j", "class", None, "A", None, "m.py", None, None),
                               (4, "i", "file", None, None, None, "n.py", 2, -1)],
                              "query_id int, instance_id string, query_kind string, fn_name string, class_name string, method_name string, filename string, line_start long, line_end long")
    rows = lambda x: sorted(map(tuple, x.collect()))
    hits = rows(exact_lookups(q, d, files, in_file=in_file))
    assert hits == rows(exact_lookups(q, d.where(looked_up()), files, in_file=in_file)) and {h[0] for h in hits} == {1, 2, 3, 4}
    assert rows(index_rows(d)) == rows(index_rows(d.where(indexed())))
    assert d.where(looked_up()).count() + d.where(indexed()).count() < d.count()


def test_many_queries_read_asked_postings_only(spark, monkeypatch):
    """F1 staged_lookup: with more queries than may be broadcast, three joins shuffled all postings."""
    c = spark.createDataFrame([(k, f"r{k % 3}", f"pkg/f{k}.py", f"f{k}", "", "function", 0, f"def part{k} one two three {'get' if k % 2 else 'put'}") for k in range(60)],
                              "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, split_idx long, content string")
    index = build_text_index(c).materialize()
    q = spark.createDataFrame([(k, f"r{k % 3}", f"part{k} get") for k in range(0, 60, 5)] + [(100, "r1", "absent get"), (101, "r2", "get two"), (102, "r0", "...")], "query_id long, instance_id string, text string")
    rows = lambda x: sorted((r.query_id, r.id, round(r.score, 9)) for r in x.collect())
    want = {per: rows(search.bm25_scores(index, q, per_instance=per)) for per in (True, False)}
    assert len(want[True]) > 10
    written = {}
    asked_terms = {f"part{k}" for k in range(0, 60, 5)} | {"absent", "get", "two"}

    def written_down(df, name):
        written[name] = (out := write_table(df, name))
        return out

    monkeypatch.setattr(search, "write_table", written_down)
    for bound in (search.TERM_HASHES, 1):  # hashes broadcast, or too many of them
        monkeypatch.setattr(search, "TERM_HASHES", bound)
        monkeypatch.setattr(search, "broadcast_if_small", lambda df, most=2, b=bound: F.broadcast(df) if most == b > 1 else df)
        for per in (True, False):
            assert rows(search.bm25_scores(index, q, per_instance=per)) == want[per]
            assert {r.term for r in written["asked_postings"].select("term").collect()} <= asked_terms


def test_copies_are_told_by_the_scored_rows(spark):
    """F1 staged_lookup: every scored pair was joined with the content by id to learn its file."""
    rows = spark.createDataFrame([(k, "i", f"f{k % 3}.py", "function", f"e{k}", "", 0, [float(k), 1.0]) for k in range(9)],
                                 "id long, instance_id string, filename string, elem_type string, elem_name string, parent_name string, split_idx long, embedding array<double>")
    q = spark.createDataFrame([(1, "i", [0.0, 1.0]), (2, "i", [8.0, 1.0])], "query_id long, instance_id string, qvec array<double>")
    files = lambda **o: sorted((r.query_id, r.rank, r.filename, r.id) for r in search.l1_search(rows, q, k=2, dedup_first=True, **o).collect())
    assert files() == files(content=rows) == [(1, 1, "f0.py", 0), (1, 2, "f1.py", 1), (2, 1, "f2.py", 8), (2, 2, "f1.py", 7)]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(search.l1_search(rows, q, k=2, dedup_first=True)) < joins(search.l1_search(rows, q, k=2, dedup_first=True, content=rows))


HEAD = "--- a/f\n+++ b/f\n"
ODD = [None, "", "no patch", "\n", HEAD, HEAD + "@@ -2 +2 @@\n-b\n+B", HEAD + "@@ -1,2 +1,2 @@\n\n-b\n+B\n", HEAD + "@@ -1,2 +1 @@\n-- x\n--- y\n+++ z\n", "@@ -1 +1 @@\n-a\n+b\n",
       HEAD + "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline\n", HEAD + "@@ -1,3 +1,3 @@\n a\n@@ -2 +2 @@\n-b\n+c\n", HEAD + "@@ -1 +1 @@\n a\n", HEAD + "@@ -1,2 +1,2 @@\n-a\nx\n+b\n c\n",
       "--- a/f\t2020\n+++ b/f\t2021\n@@ -1 +1 @@ part\n-a\n+b\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n", "--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+x\n+\n", HEAD + "\n\n@@ -1 +1 @@\n-a\n+b\n\n\n@@ -3 +3 @@\n-c\n+d\n",
       HEAD + "@@ -1 +1 @@\n-a\n+b\n" + HEAD + "@@ -3 +3 @@\n-c\n+d\n", HEAD + "@@ -1 +1 @@\r\n-a\r\n+b\r\n", "--- a/f\n@@ -1 +1 @@\n-a\n+b\n", HEAD + "--- a/q\n@@ -1 +1 @@\n-a\n+b\n", HEAD + "@@ -1 +1 @@\n-\u00e9\U0001f600\n+\u2028\n"]


def test_a_patch_read_alone_is_read_as_by_the_parser(spark):
    """F2 patch_first_valid: texts, variants, hunks, files and line windows were shuffled 15 times and written three times."""
    rnd = random.Random(5)
    pieces = ["--- a/f", "+++ b/f", "@@ -1,2 +1,2 @@", "@@ -2 +2 @@", " a", "-b", "+B", "", "\\ no", "--- gone", "+++ plus", "x", "@@ bad", "+", "-"]
    texts = ODD + ["\n".join([*HEAD.split("\n")[:2], *rnd.choices(pieces, k=rnd.randint(1, 9)), ""][: rnd.randint(3, 12)]) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "patch_id long, patch string")
    parsed = parse_patches(frame)
    sound = {r.patch_id for r in apply.sound_patches(parsed).collect()}
    minimal = {r.patch_id: r.patch for r in apply.minimal_patches(parsed).collect()}
    assert len(sound) > 8
    for k, text in enumerate(texts):
        assert apply.read_patch(text)[2] == (k in sound), text
        assert apply.minimal_text(text) == minimal.get(k, ""), text
    order = lambda d: sorted((r.patch_id, r.path, r.file_no, r.kind, [tuple(h) for h in r.hunks]) for r in d.collect())
    assert order(apply._files_of_rows(frame, ["patch_id"], "patch")) == order(apply._files_of_shared(frame, "patch_id", ["patch_id"], "patch"))


def test_many_patches_write_no_tables(spark, monkeypatch):
    """F2 patch_first_valid: variants, hunks and files were tables; rows that share an id are still read as one patch."""
    lines = spark.createDataFrame([("one", "f", k, x) for k, x in enumerate("abcde", 1)] + [("two", "f", 1, "z"), (None, "f", 1, "a")], "instance_id string, path string, line_no int, line string")
    good = HEAD + "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"
    rows = [(1, "one", good), (2, "two", good), (3, "one", good.replace(" c", " wrong")), (4, "one", good.replace("@@ -1", "\n@@ -1")), (5, None, good), (6, "one", None), (7, "one", good), (7, "one", good), (None, "one", good),
            (8, "one", good + "--- a/g\n+++ b/g\n@@ -1 +1 @@\n-a\n+b\n"), (9, "one", good + "--- /dev/null\n+++ b/new\n@@ -0,0 +1 @@\n+x\n"), (10, "one", HEAD + "@@ -9 +9 @@\n-d  \n+D  \n")]
    frame = spark.createDataFrame(rows, "patch_id long, instance_id string, patch string")
    written = []
    monkeypatch.setattr(apply, "write_table", lambda df, name: written.append(name) or write_table(df, name))
    got = {}
    for few in (1000, 0):
        monkeypatch.setattr(apply, "FEW_PATCHES", few)
        written.clear()
        got[few] = sorted(((r.patch_id or 0, r.variant, r.valid_patch) for r in apply.first_valid_variant(frame, lines, instance_col="instance_id").collect()), key=str)
    assert got[0] == got[1000] and written == ["shared_ids"]
    assert sorted((k, v) for k, v, _ in got[0] if v) == [(1, "default"), (3, "minimal"), (4, "default_no_blank"), (9, "default"), (10, "default")] and len(got[0]) == len(rows)
    once = frame.where("patch_id NOT IN (7)")
    written.clear()
    plan = apply.first_valid_variant(once, lines, instance_col="instance_id")
    assert not written and shuffles(plan) <= 6
