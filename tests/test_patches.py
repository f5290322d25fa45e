from pyspark.sql import functions as F

from quarry.operators.patches import (collapse_blank_before_hunks, parse_patches, patch_files, patch_hunks,
                                      patch_stats)

PATCH = """diff --git a/pkg/m.py b/pkg/m.py
--- a/pkg/m.py
+++ b/pkg/m.py
@@ -30 +31,2 @@
--- gone
+import os
+++ plus
@@ -40,3 +41,3 @@ def f():
 keep
-old
+from x import y
 keep
diff --git a/docs/r.md b/docs/r.md
--- a/docs/r.md
+++ b/docs/r.md
@@ -1,1 +1,1 @@
-a
+b
diff --git a/pkg/new.py b/pkg/new.py
--- /dev/null
+++ b/pkg/new.py
@@ -0,0 +1,1 @@
+import sys
diff --git a/pkg/old.py b/pkg/old.py
--- a/pkg/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-x = 1
-y = 2
"""


def _parsed(spark, patches):
    df = spark.createDataFrame(patches, "patch_id string, patch string")
    return parse_patches(df)


def test_parse_edges(spark):
    p = _parsed(spark, [("p1", PATCH)])
    hunks = sorted((r.path, r.src_start, r.src_len, r.tgt_start, r.tgt_len) for r in patch_hunks(p).collect())
    assert hunks == sorted([("pkg/m.py", 30, 1, 31, 2), ("pkg/m.py", 40, 3, 41, 3), ("docs/r.md", 1, 1, 1, 1),
                            ("/dev/null", 0, 0, 1, 1), ("pkg/old.py", 1, 2, 0, 0)])
    files = {r.path: r.modified for r in patch_files(p).collect()}
    assert files == {"pkg/m.py": True, "docs/r.md": True, "/dev/null": False, "pkg/old.py": False}
    body = [(r.marker, r.value) for r in p.where("is_body").orderBy("pos").collect()]
    assert body[:3] == [("-", "-- gone"), ("+", "import os"), ("+", "++ plus")]   # header look-alikes are body


def test_stats(spark):
    p = _parsed(spark, [("p1", PATCH), ("empty", ""), ("none", None)])
    s = {r.patch_id: (r.num_files, r.num_edits, r.num_lines, r.num_imports) for r in patch_stats(p).collect()}
    # only modified .py files: pkg/m.py -> 2 hunks, lines: 3 + 2 changed, imports: 'import os', 'from x import y'
    assert s["p1"] == (1, 2, 5, 2)
    assert s["empty"] == (0, 0, 0, 0) and s["none"] == (0, 0, 0, 0)
    s_all = {r.patch_id: r.num_files for r in patch_stats(p, code_only=False).collect()}
    assert s_all["p1"] == 2


def test_collapse(spark):
    r = spark.createDataFrame([("a\n\n\n@@ x\n\n@@ y",)], "p string").select(collapse_blank_before_hunks(F.col("p")).alias("c")).first()
    assert r.c == "a\n@@ x\n@@ y"


def test_minimal_and_first_valid(spark):
    from quarry.operators.apply import first_valid_variant, minimal_patches
    p = "--- a/f.py\n+++ b/f.py\n@@ -1,3 +1,3 @@\n wrong\n-b\n+B\n c\n"
    parsed = _parsed(spark, [("p", p)])
    m = minimal_patches(parsed).first().patch
    assert m == "--- a/f.py\n+++ b/f.py\n@@ -2 +2 @@\n-b\n+B\n"
    lines = spark.createDataFrame([("f.py", 1, "a"), ("f.py", 2, "b"), ("f.py", 3, "c")], "path string, line_no int, line string")
    blank = "--- a/f.py\n+++ b/f.py\n\n\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"
    bad = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,2 @@\n-x\n+y\n z\n"
    got = {r.patch_id: r.variant for r in first_valid_variant(
        spark.createDataFrame([("p", p), ("g", blank.replace("\n\n\n", "\n")), ("n", blank), ("b", bad)], "patch_id string, patch string"), lines).collect()}
    assert got == {"p": "minimal", "g": "default", "n": "default_no_blank", "b": None}


def test_fold_equals_windows(spark):
    import random
    from quarry.operators.patches import patch_stats_fold
    rnd = random.Random(3)
    parts = ["--- a/m.py", "+++ b/m.py", "--- /dev/null", "+++ /dev/null", "+++ b/n.md", "@@ -1,2 +1,2 @@", "@@ -0,0 +1 @@", "@@ -3 +0,0 @@", "@@ -4 +4 @@ f", " x", "-y",
             "+import z", "+from q", "", "noise", "\\ No newline at end of file"]
    sound = ["--- a/m.py\n+++ b/m.py\n", "@@ -1,2 +1,2 @@\n x\n-y\n+z\n", "@@ -5 +5 @@\n-y\n+import z\n", "@@ -0,0 +1 @@\n+new\n", "--- a/o.py\n+++ b/o.py\n", "@@ -1 +0,0 @@\n-x\n", "--- a/r.md\n+++ b/r.md\n"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "\n"]) for _ in range(300)]
    texts += [sound[0] + "".join(rnd.choice(sound) for _ in range(rnd.randint(0, 7))) for _ in range(300)] + [PATCH, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "patch_id long, patch string")
    parsed = parse_patches(df)
    for skip in (True, False):
        a = {tuple(r) for r in patch_stats(parsed, skip_unparsable=skip).collect()}
        b = {tuple(r) for r in patch_stats_fold(df, skip_unparsable=skip).select("patch_id", "num_files", "num_edits", "num_lines", "num_imports").collect()}
        assert a == b
        assert len(a) == len(texts) if not skip else 200 < len(a) < len(texts)


def test_one_empty_range_adds_or_removes_the_file(spark):
    head = "--- a/m.py\n+++ b/m.py\n"
    added, removed, two = head + "@@ -0,0 +1 @@\n+x\n", head + "@@ -1 +0,0 @@\n-x\n", head + "@@ -0,0 +1 @@\n+x\n@@ -5 +6 @@\n-x\n+y\n"
    p = _parsed(spark, [("a", added), ("r", removed), ("t", two)])
    assert {r.patch_id: (r.num_files, r.num_edits) for r in patch_stats(p).collect()} == {"a": (0, 0), "r": (0, 0), "t": (1, 2)}
    assert {r.patch_id: r.modified for r in patch_files(p).collect()} == {"a": False, "r": False, "t": True}
    assert [r.modified for r in patch_hunks(p).orderBy("patch_id", "src_start").collect()] == [False, False, True, True]


def test_a_patch_is_split_below_the_generator_and_parts_follow_the_items(spark, tmp_path, monkeypatch):
    """splitting beside the generator ran once a line; merged partitions had tasks sort more lines than memory holds."""
    from quarry.plans import patch_plans
    plan = _parsed(spark, [("p1", PATCH)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "split(" not in plan[:plan.index("Generate ")]
    rows = [(o, 1, o % 5, k, float(k), "A", "O") for o in range(40) for k in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o) for o in range(41)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(patch_plans, "ITEMS_PER_TASK", 10)
    assert patch_plans._instances(spark, str(tmp_path)).rdd.getNumPartitions() == 8
    assert patch_plans.diff_hunks(spark, str(tmp_path)).count() == 80
    assert patch_plans.instance_stats(spark, str(tmp_path)).count() == 41


def test_fold_in_one_pass(spark):
    """the fold was an interpreted expression of some 40 steps a line; ids of any type stay, texts need not be valid UTF-8."""
    from quarry.operators.patches import fold_patch, patch_stats_fold
    assert fold_patch(PATCH.encode()) == (1, 2, 5, 2, True)
    assert fold_patch(PATCH.encode(), code_only=False)[0] == 2
    assert fold_patch(None) == fold_patch(b"") == (0, 0, 0, 0, True)
    assert fold_patch(b"@@ -1 +1 @@\n-a\n+b\n")[4] is False  # no file header
    head = b"--- a/m.py\n+++ b/m.py\n"
    assert fold_patch(head + b"@@ -1 +1 @@\n-\xff\n+\xfe\n") == (1, 1, 2, 0, True)
    assert fold_patch(head + "@@ -١ +1 @@\n".encode()) == (1, 0, 0, 0, True)  # digits are ASCII
    df = spark.createDataFrame([("a", 7, PATCH), (None, 8, None)], "name string, id int, patch string")
    for key in ("name", "id"):
        out = patch_stats_fold(df, key)
        assert out.schema[key].dataType == df.schema[key].dataType and "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {tuple(r)[1:] for r in out.collect()} == {(1, 2, 5, 2), (0, 0, 0, 0)}
