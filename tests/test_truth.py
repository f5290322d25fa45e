"""Cases in which rows used to be lost or wrong: every input row is accounted for."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import decode_references, html_to_text
from quarry.operators.apply import minimal_patches
from quarry.operators.elements import element_displays, extract_elements, latest_by_name
from quarry.operators.inference import RateLimitError, TokenLimitError, call_cached
from quarry.operators.lookup import lookup_with_fallback
from quarry.operators.patches import fit_check, parse_patches, parse_status, patch_stats
from quarry.operators.render import offsets_to_lines
from quarry.operators.replies import parse_query_payload

TWICE = '''class C:
    def a(self):
        pass

    def b(self):
        return 1


class C:
    def b(self):
        return 2
'''


def test_class_defined_twice(spark):
    files = spark.createDataFrame([("i", "m.py", TWICE)], "instance_id string, filename string, content string")
    d = element_displays(extract_elements(files), files)
    classes = {r.ord: r.display for r in d.where("elem_type = 'class' AND display_level = 'signature'").collect()}
    assert "def a" in classes[0] and "def b" in classes[0] and "def a" not in classes[1] and "def b" in classes[1]
    found = latest_by_name(d.where("elem_type = 'method' AND display_level = 'full'")).collect()
    assert [(r.elem_name, "return 2" in r.display) for r in found] == [("b", True)]


COMMENTS = '''"""Header
of the module."""
X = 1
"""about X"""
# TODO later
# note on f

@deco
# closer note
def f(
    a,
):
    # first
    # FIXME not this
    # second
    return a
'''


def test_comment_spans(spark):
    files = spark.createDataFrame([("i", "m.py", COMMENTS)], "instance_id string, filename string, content string")
    rows = {(r.elem_type, r.elem_name): r for r in extract_elements(files).collect()}
    assert (rows["module", "m.py"].lower_lo, rows["module", "m.py"].lower_hi) == (0, 1)
    assert (rows["constant", "X"].upper_lo, rows["constant", "X"].lower_lo, rows["constant", "X"].lower_hi) == (None, 3, 3)
    f = rows["function", "f"]
    assert (f.upper_lo, f.upper_hi) == (5, 8) and (f.sig_lo, f.sig_hi) == (9, 11) and (f.lower_lo, f.lower_hi) == (12, 14)


def test_deeply_nested_file_is_raw(spark):
    files = spark.createDataFrame([("i", "deep.py", "x = " + "(" * 5000 + ")" * 5000), ("i", "ok.py", "y = 1")],
                                  "instance_id string, filename string, content string")
    assert {(r.filename, r.kind) for r in extract_elements(files).collect()} == {("deep.py", "raw"), ("ok.py", "module")}


def _requests(spark, n=12):
    return spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(n)], "key string, prompt string")


@pytest.mark.parametrize("raising", [True, False])
def test_one_bad_text_fails_alone(spark, raising):
    def provider(texts):
        if raising and "text 5" in texts:
            raise TokenLimitError("too long")
        return [TokenLimitError("too long") if t == "text 5" else t.upper() for t in texts]
    answers, cache = call_cached(_requests(spark), None, provider)
    got = {r.key: r.status for r in answers.collect()}
    assert got == {f"k{i}": "token_limit" if i == 5 else "ok" for i in range(12)} and cache.count() == 11


def test_changed_prompt_replaces_the_old_answer(spark):
    up = lambda texts: [t.upper() for t in texts]
    old = spark.createDataFrame([("a", "one")], "key string, prompt string")
    _, cache = call_cached(old, None, up)
    new = spark.createDataFrame([("a", "two"), (None, "free")], "key string, prompt string")
    answers, cache = call_cached(new, cache, up)
    assert answers.count() == 2
    assert [(r.key, r.prompt, r.seq) for r in cache.collect()] == [("a", "two", 1)]


def test_retry_sends_only_the_failed(spark, tmp_path):
    log = str(tmp_path)

    def provider(texts):
        import os
        import uuid
        out = []
        for t in texts:
            first = not any(n.startswith(t.replace(" ", "_") + "-") for n in os.listdir(log))
            open(os.path.join(log, t.replace(" ", "_") + "-" + uuid.uuid4().hex), "w").close()
            out.append(RateLimitError("later") if t == "text 3" and first else t)
        return out
    answers, _ = call_cached(_requests(spark, 6), None, provider, max_attempts=3)
    assert {r.status for r in answers.collect()} == {"ok"} and answers.count() == 6
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert sorted(calls) == sorted([f"text_{i}" for i in range(6)] + ["text_3"])


DIFF = "--- a/m.py\n+++ b/m.py\n@@ -5,2 +5,3 @@\n x\n+new\n y\n"


def test_zero_length_header_names_the_line_before(spark):
    p = spark.createDataFrame([("p", DIFF)], "patch_id string, patch string")
    assert "@@ -5,0 +6 @@" in minimal_patches(parse_patches(p)).first().patch


def test_unparsable_patches_are_skipped(spark):
    broken = "--- a/m.py\n+++ b/m.py\n@@ -1,3 +1,3 @@\n x\n-y\n+z\n"
    headless = "@@ -1 +1 @@\n-y\n+z\n"
    p = spark.createDataFrame([("good", DIFF), ("broken", broken), ("headless", headless), ("none", None)], "patch_id string, patch string")
    parsed = parse_patches(p)
    assert {r.patch_id: r.parse_ok for r in parse_status(parsed).collect()} == {"good": True, "broken": False, "headless": False, "none": True}
    assert {r.patch_id for r in patch_stats(parsed).collect()} == {"good", "none"}


def test_fit_check_by_instance(spark):
    p = spark.createDataFrame([("one", "p1", DIFF)], "instance_id string, patch_id string, patch string")
    lines = spark.createDataFrame([("one", "m.py", 5, "x"), ("one", "m.py", 6, "y"), ("two", "m.py", 5, "other"), ("two", "m.py", 6, "text")],
                                  "instance_id string, path string, line_no int, line string")
    parsed = parse_patches(p, keep=("instance_id",))
    assert [r.fits for r in fit_check(parsed, lines, instance_col="instance_id").collect()] == [True]


def test_pages_keep_their_text(spark):
    rows = [("<body><p>open page", "open page"), ("<body>a<!-- x --></body></html>", "a"), ("<body>b<script>1", "b"),
            ("<body>&#233;&#x1F642;&eacute;&amp;lt;&nosuch;&#0;</body>", "é🙂é&lt;&nosuch;&#0;"), ("<body>" + "x" * 60000 + "</body>", "x" * 60000)]
    df = spark.createDataFrame(rows, "html string, want string")
    assert [r.t for r in df.select(html_to_text(F.col("html")).alias("t")).collect()] == [w for _, w in rows]
    assert spark.range(1).select(decode_references(F.lit("a &lt; b & c")).alias("t")).first().t == "a < b & c"


def test_corrupt_payload_is_kept(spark):
    rows = [("a", '[{"reasoning": "r", "query": {"fn_name": "f"}}]'), ("b", "[{broken"), ("c", "[]")]
    got = {r.reply_id: (r.query_kind, r.reasoning) for r in parse_query_payload(spark.createDataFrame(rows, "reply_id string, content string")).collect()}
    assert got == {"a": ("function", "r"), "b": ("corrupt", "[{broken")}


def test_unknown_kind_is_an_error(spark):
    q = spark.createDataFrame([("q", "i", "unknown")], "query_id string, instance_id string, query_kind string")
    for c in ("fn_name", "class_name", "method_name", "filename", "semantic"):
        q = q.withColumn(c, F.lit("x"))
    q = q.withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1))
    files = spark.createDataFrame([("i", "m.py", TWICE)], "instance_id string, filename string, content string")
    from quarry.operators.index import build_text_index
    rows = spark.createDataFrame([(1, "i", "m.py", "module", "m.py", "x y")], "id long, instance_id string, filename string, elem_type string, elem_name string, content string")
    index = build_text_index(rows)
    with pytest.raises(Exception, match="unknown kind"):
        lookup_with_fallback(q, element_displays(extract_elements(files), files), files, index, rows).collect()


def test_offsets_of_a_long_text(spark):
    """Running order by position: empty lines take the first; many lines stay quick."""
    n = 40000
    text = "\n".join(["ab", "", ""] + ["x"] * n)
    t = spark.createDataFrame([(1, text)], "id long, text string")
    o = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, n + 2), (1, n + 3)], "id long, offset long")
    began = time.time()
    got = {r.offset: r.line_idx for r in offsets_to_lines(t, o).collect()}
    assert got == {1: 0, 2: 0, 3: 3, n + 2: n + 2, n + 3: None} and time.time() - began < 60


def test_offsets_over_segments(spark):
    """Segments and stretches of any size give the line that a scan gives."""
    import random
    from quarry.operators.render import line_of_offset
    rnd = random.Random(5)
    texts = {i: "\n".join("x" * rnd.choice([0, 0, 1, 2, 9]) for _ in range(rnd.randint(1, 60))) for i in range(25)}
    offs = [(i, o) for i in texts for o in list(range(-2, 40)) + [500] for _ in range(1 + (o == 3))] + [(77, 1), (None, 1)]

    def scan(i, o):
        total = 0
        for k, line in enumerate(texts.get(i, "").split("\n") if i in texts else []):
            total += len(line)
            if total >= o:
                return k
    t = spark.createDataFrame(list(texts.items()), "id long, text string")
    o = spark.createDataFrame(offs, "id long, offset long")
    want = sorted(((str(i), x, scan(i, x)) for i, x in offs), key=str)
    for segment, bucket in ((1, 1), (3, 7), (8, 4), (65536, 1 << 20)):
        got = sorted(((str(r.id), r.offset, r.line_idx) for r in offsets_to_lines(t, o, segment=segment, bucket=bucket).collect()), key=str)
        assert got == want
    # one text of many lines, given as rows: every segment is a task's work of its own
    many = spark.range(2_000_000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("pos"), F.lit(10).alias("len"))
    got = line_of_offset(many, spark.createDataFrame([(1, 1), (1, 10), (1, 11), (1, 20_000_000), (1, 20_000_001)], "id long, offset long"))
    assert {r.offset: r.line_idx for r in got.collect()} == {1: 0, 10: 0, 11: 1, 20_000_000: 1_999_999, 20_000_001: None}


def test_lookup_inside_one_file(spark):
    """A class of 7,000 characters is shown whole inside its file, by its signature among all files; other files do not answer."""
    from quarry.operators.lookup import exact_lookups
    long = "class C:\n    def a(self):\n" + "".join(f'        """{"x" * 60}\n' if k == 0 else f"        {'y' * 60}\n" for k in range(100)) + '        """\n        pass\n'
    files = spark.createDataFrame([("i", "a.py", long), ("i", "b.py", "class C:\n    pass\n\ndef f():\n    return 1\n")], "instance_id string, filename string, content string")
    d = element_displays(extract_elements(files), files, numbered=True)
    q = spark.createDataFrame([("c", "i", "class", None, "C", None, "a.py", None, None), ("m", "i", "method", None, "C", "a", "b.py", None, None), ("f", "i", "function", "f", None, None, "b.py", None, None),
                               ("g", "i", "function", "f", None, None, "a.py", None, None), ("r", "i", "file", None, None, None, "b.py", 4, 4)],
                              "query_id string, instance_id string, query_kind string, fn_name string, class_name string, method_name string, filename string, line_start long, line_end long")
    inside = {r.query_id: (r.filename, len(r.text)) for r in exact_lookups(q, d, files, in_file=True).collect()}
    assert set(inside) == {"c", "f", "r"} and inside["c"][0] == "a.py" and 5000 < inside["c"][1] < 10000
    over = {(r.query_id, r.filename): len(r.text) for r in exact_lookups(q, d, files).collect()}
    assert set(over) == {("c", "a.py"), ("c", "b.py"), ("f", "b.py"), ("g", "b.py"), ("r", "b.py"), ("m", "a.py")} and over["c", "a.py"] < 1000


def test_copies_of_a_file_do_not_crowd_out_others(spark):
    from quarry.operators.search import l1_search
    rows = [(i, "i", "same.py", f"e{i}", [float(i) / 100]) for i in range(40)] + [(100 + i, "i", f"f{i}.py", "e", [10.0 + i]) for i in range(5)]
    c = spark.createDataFrame([(*r[:4], "", "function", 0, r[4]) for r in rows],
                              "id long, instance_id string, filename string, elem_name string, parent_name string, elem_type string, split_idx long, embedding array<double>")
    q = spark.createDataFrame([(1, "i", [0.0])], "query_id long, instance_id string, qvec array<double>")
    files = lambda **o: [r.filename for r in l1_search(c, q, k=4, **o).orderBy("rank").collect()]
    assert files() == ["same.py"] and files(dedup_first=True) == ["same.py", "f0.py", "f1.py", "f2.py"]
