import os

from pyspark.sql import functions as F

from quarry.operators.maintenance import write_files
from quarry.operators.render import file_for_prompt, lookup_range, numbered_lines, offsets_to_lines, range_text
from quarry.sources.files import get_dirs, list_dirs, scan_eval_logs, scan_source_tree
from quarry.sources.rules import rule_matches, rules_from_rows


def py_find_line(text, off):
    cur = 0
    for i, line in enumerate(text.split("\n")):
        cur += len(line)
        if cur >= off:
            return i
    return None


def test_offsets_to_lines(spark):
    texts = ["abc\ndefg\n\nhij", "x", "", "line\r\nnext"]
    offs = [(i, o) for i, t in enumerate(texts) for o in (0, 1, 3, 4, 7, 8, 9, 50)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    o = spark.createDataFrame(offs, "id long, offset long")
    got = {(r.id, r.offset): r.line_idx for r in offsets_to_lines(t, o).collect()}
    assert got == {(i, off): py_find_line(texts[i], off) for i, off in offs}


def test_numbered_and_ranges(spark):
    lines = [f"l{i}" for i in range(1, 13)]
    df = spark.createDataFrame([(lines, 3, 5), (lines, 0, -1), (lines, 20, 30)], "lines array<string>, s int, e int")
    lo, hi = lookup_range(F.col("lines"), F.col("s"), F.col("e"))
    rows = df.select(lo.alias("lo"), hi.alias("hi"), range_text(F.col("lines"), lo, hi).alias("t")).collect()
    assert (rows[0].lo, rows[0].hi) == (0, 12)
    assert rows[0].t.startswith(" 1 |l1\n") and rows[0].t.endswith("12 |l12\n")
    assert (rows[2].lo, rows[2].hi) == (10, 12)
    w = spark.createDataFrame([(["a"], 99)], "l array<string>, s int").select(
        numbered_lines(F.col("l"), F.col("s"), F.lit(2)).alias("t")).first()
    assert w.t == "100 |a\n"          # wider than the pad: never truncated


def test_file_for_prompt(spark):
    df = spark.createDataFrame([("a.py", "x\ny\nz", [(2, 4)])], "p string, c string, r array<struct<start:int,end:int>>")
    t = df.select(file_for_prompt(F.col("p"), F.col("c"), F.col("r"), "LINES_ONLY").alias("t")).first().t
    assert t == "\n-----\nHere is a portion of a.py from line 2 to 3:\n```py\n2 |y\n3 |z\n```\n-----\n"


def test_dir_listing_quirk(spark):
    paths = spark.createDataFrame([("i", "pkg/venv/lib/a.py"), ("i", "venv/b.py"), ("i", "src/__pycache__/c.py"),
                                   ("i", "top.py"), ("i", ".github/x/y.py")], "instance_id string, filename string")
    d = {r.dir: r.depth for r in list_dirs(paths).collect()}
    assert d == {"pkg": 0, "pkg/venv": 1, "src": 0, "src/__pycache__": 1}
    assert {r.dir for r in get_dirs(list_dirs(paths), prefix="pkg", max_depth=0).collect()} == {"pkg"}


def test_scans(spark, tmpdir_path):
    files = spark.createDataFrame([
        ("a.py", "x = 1\n"), ("README.md", "r"), ("notes.txt", "n"), ("venv/v.py", "v"), ("p/__pycache__/m.pyc", "b"),
        ("sub/b.py", "y = 2\n"), ("run1.eval.log", "ALL TESTS PASSED"), ("run2.eval.log", "apply patch failed\nSome tests failed"),
        ("run3.eval.log", "nothing"), ("other.log", "All tests passed")], "filename string, content string")
    write_files(files, tmpdir_path)
    got = {(r.filename, r.kind) for r in scan_source_tree(spark, tmpdir_path, "i").collect()}
    assert got == {("a.py", "module"), ("README.md", "raw"), ("sub/b.py", "module")}
    from quarry.operators.stats import outcome_counts
    counts = {r.outcome: r.n for r in outcome_counts(scan_eval_logs(spark, tmpdir_path)).collect()}
    assert counts == {"success": 1, "test_script_failure": 0, "test_failure": 1, "install_failure": 0,
                      "patch_failure": 0, "unknown": 1}


def test_rules(spark):
    rules = rules_from_rows(spark, [(0, "^a", True, "A"), (1, "b$", False, "B"), (2, "c", None, "C")])
    terms = spark.createDataFrame([("abc",), ("xb",), ("a",), ("abc",)], "term string")
    got = sorted((r.term, r.matches) for r in rule_matches(terms, rules).collect())
    assert got == [("a", "A"), ("abc", "A\n---\nC"), ("abc", "A\n---\nC"), ("xb", "")]


def test_fix_context_and_text_sink(spark, tmpdir_path):
    from quarry.operators.maintenance import write_text_per_instance
    from quarry.operators.render import fix_context
    content = "\n".join(f"line{i}" for i in range(1, 31))
    files = spark.createDataFrame([("i", "a.py", content)], "instance_id string, filename string, content string")
    disp = spark.createDataFrame([("i", "a.py", "moderate", "OVERVIEW\n"), ("i", "a.py", "signature", "SIG\n")],
                                 "instance_id string, filename string, display_level string, display string")
    hunks = spark.createDataFrame([("i", "a.py", 15, 1, 1), ("i", "missing.py", 1, 1, 1)],
                                  "instance_id string, path string, src_start long, src_len long, hunk_no long")
    ctx, unmatched = fix_context(hunks, files, disp)
    text = ctx.first().context
    assert "Overview of a.py:\nOVERVIEW" in text
    assert " 4 |line4\n" not in text and " 5 |line5\n" in text and "25 |line25\n" in text and "26 |line26" not in text
    assert [r.path for r in unmatched.collect()] == ["missing.py"]
    df = spark.createDataFrame([("x", "one"), ("y", "two")], "instance_id string, text string")
    write_text_per_instance(df, tmpdir_path + "/out")
    back = {r.instance_id: r.value for r in spark.read.text(tmpdir_path + "/out").select("value", "instance_id").collect()}
    assert back == {"x": "one", "y": "two"}


def test_ladder_labels_testpatch(spark):
    from quarry.operators.render import brief_label, budget_ladder, test_patch_text
    df = spark.createDataFrame([("a" * 10, "b" * 5, "c"), ("a" * 50, "b" * 50, "c")], "f string, m string, s string")
    got = [r.t for r in df.select(budget_ladder([F.col("f"), F.col("m"), F.col("s")], limit=20).alias("t")).collect()]
    assert got == ["a" * 10, "c"]
    lab = spark.createDataFrame([("method", "m", "C", "x.py"), ("other", "r", "", "README")], "t string, n string, p string, f string") \
        .select(brief_label(F.col("t"), F.col("n"), F.col("p"), F.col("f")).alias("l")).collect()
    assert [r.l for r in lab] == ["Method C.m in x.py", "Content of README"]
    tp = spark.createDataFrame([("--- a\n",), (None,)], "p string").select(test_patch_text(F.col("p")).alias("t")).collect()
    assert [r.t for r in tp] == ["Here the test patch for the issue:\n\n--- a", "No test cases."]


def test_many_logs_are_few_tasks(spark, tmpdir_path):
    """a task read 32 logs, whatever their size, so that tasks grew to hundreds of thousands."""
    from quarry.operators.maintenance import write_files
    from quarry.sources.files import scan_eval_logs
    logs = spark.range(200).selectExpr("concat('run-', id, '.eval.log') AS filename", "concat('ALL TESTS PASSED ', id, '\\n') AS content")
    write_files(logs, f"{tmpdir_path}/logs")
    write_files(logs.limit(1).selectExpr("'ignored.txt' AS filename", "content"), f"{tmpdir_path}/logs")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    scanned = scan_eval_logs(spark, f"{tmpdir_path}/logs")
    assert scanned.rdd.getNumPartitions() <= 2 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert {(r.path, r.content) for r in scanned.collect()} == {(f"run-{k}.eval.log", f"all tests passed {k}\n") for k in range(200)}
