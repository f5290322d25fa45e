from pyspark.sql import functions as F

from quarry.functions.replies import parse_block
from quarry.operators.replies import parse_query_payload, parse_replies
from quarry.plans.text_plans import parse_indices

REPLIES = {
    "plain": "<reason>\n```md\nwhy\n```\n</reason>\n<patch>\n```diff\n--- a\n+++ b\n```\n</patch>",
    "from0": "<patch0 a=1 b=x=y c>\n```diff\nA\n```\n</patch0>\n<patch1>\nB\n</patch1>",
    "from1": "<patch1>\n```diff\nB\n```\n</patch1>",
    "gap": "<patch0>X</patch0><patch2>Z</patch2>",
    "noend": "<patch0>\nunterminated",
    "dup": "<patch0 a=1 a=2>Q</patch0>",
}


def _parse(spark):
    df = spark.createDataFrame(list(REPLIES.items()), "reply_id string, response string")
    rows = parse_replies(df).collect()
    out = {}
    for r in rows:
        out.setdefault(r.reply_id, []).append((r.tag, r.block_no, r.content, dict(r.attrs or {})))
    return out


def test_blocks(spark):
    got = _parse(spark)
    assert ("reason", -1, "why", {}) in got["plain"]
    assert ("patch", -1, "--- a\n+++ b", {}) in got["plain"]
    assert [(t, n, c) for t, n, c, _ in got["from0"] if t == "patch"] == [("patch", 0, "A"), ("patch", 1, "B")]
    assert dict(a="1", b="x") == [a for t, n, c, a in got["from0"] if n == 0][0]
    assert "from1" not in got                              # numbered from 1: nothing is read
    assert [(n, c) for t, n, c, _ in got["gap"]] == [(0, "X")]
    assert "noend" not in got
    assert got["dup"][0][3] == {"a": "2"}                  # last duplicate key wins


def test_unnumbered_prefix_match(spark):
    # '<patch' also finds '<patch0', but '</patch>' is missing -> no unnumbered block
    r = spark.createDataFrame([("<patch0>x</patch0>",)], "r string").select(parse_block(F.col("r"), "patch").alias("b")).first()
    assert r.b is None


def test_json_payloads(spark):
    body = '<queries>\n```json\n[{"reasoning": "r1", "query": {"fn_name": "f"}}, {"reasoning": "r2", "query": {"filename": "a.py", "line_start": 3, "line_end": -1}}]\n```\n</queries>'
    df = spark.createDataFrame([("q", body)], "reply_id string, response string")
    b = parse_replies(df, code_tag="queries", code_lang="json").where("tag = 'queries' AND block_no = -1")
    rows = parse_query_payload(b).orderBy("query_idx").collect()
    assert [(r.query_kind, r.fn_name, r.filename, r.line_start, r.line_end) for r in rows] == [
        ("function", "f", None, None, None), ("file", None, "a.py", 3, -1)]
    ch = spark.createDataFrame([('{"indices": [2, 0]}',), ('{"indices": 1}',), ("junk",)], "p string") \
        .select(parse_indices(F.col("p")).alias("i")).collect()
    assert [r.i for r in ch] == [[2, 0], [1], None]


PAYLOADS = {
    "q": ('[{"reasoning":"r","query":{"fn_name":"f","line_start":5}},{"reasoning":"x","query":{"semantic":"s"}}, 7, {"a":1}]',
          [("queries", "r", "function", None, None), ("queries", "x", "semantic", None, None), ("corrupt", "7", None, None, None), ("corrupt", '{"a":1}', None, None, None)]),
    "files": (' ["a.py",\n"b.py", 1, null]', [("files", None, None, None, ["a.py"]), ("files", None, None, None, ["b.py"]), ("corrupt", "1", None, None, None),
                                            ("corrupt", "null", None, None, None)]),
    "one": ('{"index": 3}', [("result", None, None, [3], None)]), "list": ('{"index":[1,2]}', [("result", None, None, [1, 2], None)]),
    "extract": ('[{"reasoning":"r","extract":{"class_name":"C"}}]', [("extractions", "r", "class", None, None)]),
    "select": ('[{"reasoning":"r","index":2}]', [("selection", "r", None, [2], None)]),
    "web": ('[{"reason":"w","query_type":"t","query":"the query"}]', [("web_queries", "w", None, None, None)]),
    "indices": ('{"indices":[4,0]}', [("indices", None, None, [4, 0], None)]), "relevant": ('{"relevant":["a","b"]}', [("relevant", None, None, None, ["a", "b"])]),
    "located": ('{"reasoning":"r","category":"function","fn_name":"f","class_name":null,"generic_lines":[1,2]}', [("located", "r", None, [1, 2], None)]),
    "broken": ("[{broken", [("corrupt", "[{broken", None, None, None)]), "empty": ("[]", []), "null": (None, []), "number": ("12", [("corrupt", "12", None, None, None)]),
    "wrong": ('{"relevant":"x"}', [("corrupt", '{"relevant":"x"}', None, None, None)]), "twice": ('{"index":1,"index":2}', [("corrupt", '{"index":1,"index":2}', None, None, None)]),
    "blank": ("", [("corrupt", "", None, None, None)]),
}


def test_payload_shapes(spark):
    from quarry.operators.replies import parse_payloads
    df = spark.createDataFrame([(k, v) for k, (v, _) in PAYLOADS.items()], "reply_id string, content string")
    got = {}
    for r in parse_payloads(df).orderBy("reply_id", "item_idx").collect():
        got.setdefault(r.reply_id, []).append((r.shape, r.reasoning, r.query_kind, r.numbers, r.texts))
    assert got == {k: want for k, (_, want) in PAYLOADS.items() if want}


def test_answers_leave_python_in_bounded_frames():
    import pandas as pd
    from quarry.operators.inference import CALLS_AT_ONCE, _run_provider
    calls = []
    run = _run_provider(lambda texts: calls.append(len(texts)) or [t.upper() for t in texts], "embed", 2)
    n = 4 * CALLS_AT_ONCE + 1
    frames = list(run([pd.DataFrame({"key": [f"k{i}" for i in range(n)], "prompt": [f"t{i}" for i in range(n)]})]))
    assert [len(f) for f in frames] == [2 * CALLS_AT_ONCE, 2 * CALLS_AT_ONCE, 1]
    assert [v for f in frames for v in f["value"]] == [f'"T{i}"' for i in range(n)]
    assert calls == [2] * (2 * CALLS_AT_ONCE) + [1]
