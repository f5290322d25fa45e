from quarry.operators.elements import element_displays, extract_elements, index_rows

SRC = '''# header comment
import os

# TODO skip me
# about C
SIZE = 3


@decorator
def f(a,
      b):
    """Doc."""
    return a


class C:
    # class note
    X = 1

    def m(self):
        pass

    async def am(self):
        pass


def f(a):
    return 2
'''


def _files(spark):
    return spark.createDataFrame([("i", "m.py", SRC), ("i", "bad.py", "def broken(:\n"), ("i", "README.md", "hello")],
                                 "instance_id string, filename string, content string")


def test_extract(spark):
    files = _files(spark)
    rows = {(r.elem_type, r.elem_name, r.parent_name, r.ord): r for r in extract_elements(files).collect()}
    assert rows[("module", "bad.py", "", 0)].kind == "raw"
    assert ("method", "am", "C", 2) not in rows and ("method", "m", "C", 1) in rows
    c = rows[("constant", "SIZE", "", 1)]
    assert (c.upper_lo, c.upper_hi) == (4, 4)               # TODO line skipped, run continues
    f0 = rows[("function", "f", "", 2)]
    assert (f0.sig_lo, f0.sig_hi) == (9, 10)                # multi-line signature
    assert (f0.lower_lo, f0.lower_hi) == (11, 11)
    cl = rows[("class", "C", "", 3)]
    assert (cl.lower_lo, cl.lower_hi) == (16, 16)
    assert rows[("function", "f", "", 4)].start_line == 27   # duplicate name kept in order


def test_displays(spark):
    files = _files(spark)
    d = element_displays(extract_elements(files), files, numbered=False)
    got = {(r.filename, r.elem_type, r.elem_name, r.ord, r.display_level): r.display for r in d.collect()}
    assert got[("m.py", "function", "f", 2, "signature")] == "def f(a,\n      b):\n"
    assert got[("m.py", "function", "f", 2, "minimal")] == "def f(a,\n      b):\n    \"\"\"Doc.\"\"\"\n"
    assert got[("m.py", "class", "C", 3, "minimal")] == "class C:\n    # class note\n"
    # the class note is the class's lower comment and also the constant's upper comment
    assert got[("m.py", "class", "C", 3, "moderate")] == ("class C:\n    # class note\n"
                                                          "    # class note\n    X = 1\n\n    def m(self):\n\n")
    assert got[("m.py", "module", "m.py", 0, "minimal")] == "# header comment\n"
    assert got[("README.md", "module", "README.md", 0, "full")] == "hello"
    num = element_displays(extract_elements(files), files, numbered=True)
    sig = [r.display for r in num.collect() if r.elem_name == "m" and r.display_level == "signature"][0]
    assert sig == "20 |    def m(self):\n"
    idx = {(r.filename, r.elem_type, r.elem_name, r.display_level) for r in index_rows(d).collect()}
    assert ("m.py", "function", "f", "minimal") in idx and ("m.py", "class", "C", "minimal") in idx
    assert ("bad.py", "module", "bad.py", "") in idx
    assert not any(t in ("method", "constant", "import") for _, t, _, _ in idx)


def test_element_rows_leave_python_in_bounded_frames():
    import pandas as pd
    from quarry.operators.elements import ROWS_AT_ONCE, element_frames
    one = next(element_frames([pd.DataFrame({"instance_id": ["r"], "filename": ["a.py"], "content": [SRC]})]))
    n = 2 * ROWS_AT_ONCE // len(one) + 2
    frames = list(element_frames([pd.DataFrame({"instance_id": ["r"] * n, "filename": ["a.py"] * n, "content": [SRC] * n})]))
    assert len(frames) > 1 and max(map(len, frames)) < ROWS_AT_ONCE + len(one)
    assert sum(map(len, frames)) == n * len(one)
    assert [list(f.dtypes) for f in frames] == [list(one.dtypes)] * len(frames)


def test_growing_sides_are_not_broadcast(spark):
    from quarry.operators.lookup import exact_lookups, located_context
    from quarry.operators.render import fix_context
    from quarry.plans.element_plans import located_items, lookup_queries, render_python_files
    part = spark.createDataFrame([(i, f"p {i}", "b", i % 50) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_size int")
    files = render_python_files(part)
    d = element_displays(extract_elements(files), files, numbered=True)
    hunks = spark.createDataFrame([("repo0", "pkg/group_0.py", 3, 2, 1)], "instance_id string, path string, src_start int, src_len int, hunk_no int")
    for df in (d, exact_lookups(lookup_queries(part), d, files), located_context(located_items(part), d, files), fix_context(hunks, files, d)[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
