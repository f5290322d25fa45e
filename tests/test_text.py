import random
import re
import string
import unicodedata
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.hashing import adler32, adler32_bucket
from quarry.functions.text import (clean_query, exact_only, fold_table, html_to_text, raw_elem_type, strip_ws, tokenize,
                                   with_term_counts)
from quarry.operators.chunking import boundary_chunks, fixed_chunks

EDGE_TEXTS = ["", "a", "x" * 4096, "y" * 4097, "héllo wörld ñ", "a\r\nb\r\n", "no trailing newline", "z" * 9000]


def py_chunks(text, cap=4096, overlap=512):
    """Brute-force fixed windows: starts every cap-overlap until the end is covered."""
    if not text:
        return []
    step = cap - overlap
    out, s = [], 0
    while True:
        out.append((s, text[s:s + cap]))
        if s + cap >= len(text):
            break
        s += step
    return out


def test_fixed_chunks_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(99, None)], "id long, content string")
    got = {(r.id, r.split_idx): r.content for r in fixed_chunks(df).collect()}
    want = {(i, s): c for i, t in enumerate(EDGE_TEXTS) for s, c in py_chunks(t)}
    assert got == want


def split_boundaries(text, capacity, overlap):
    """The stated rule, character by character."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = n
        if start + capacity < n:
            w = text[start:start + capacity]
            ends = [[k for k in range(1, len(w) + 1) if w[:k].endswith("\n\n")], [k for k in range(1, len(w) + 1) if w[k - 1] == "\n"],
                    [k for k in range(1, len(w)) if w[k - 1] in ".!?" and w[k] in " \t\n\r"], [k for k in range(1, len(w) + 1) if w[k - 1] == " "]]
            end = start + next((e[-1] for e in ends if e and e[-1] > capacity // 4), capacity)
        out.append((start, text[start:end]))
        if end >= n:
            break
        after = max(end - overlap, start + 1)
        space = text.find(" ", after, end - 1)
        start = space + 1 if space >= 0 else after
    return out


def test_boundary_chunks(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["word", " ", " ", ".", "\n", "\n\n", "! ", "é", "🙂", "x" * 30, "\t", "? ", "\r\n"]) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    texts += ["", None, "x" * 999, " " * 300, "\n" * 300, ("First sentence here. Second one!\n\nNew paragraph with words " * 100).strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for capacity, overlap in ((40, 5), (40, 0), (60, 45), (7, 6), (4096, 512)):
        got = {}
        for r in boundary_chunks(df, ["id"], "content", capacity, overlap).orderBy("id", "split_idx").collect():
            got.setdefault(r.id, []).append((r.split_idx, r.content))
        assert got == {i: split_boundaries(t, capacity, overlap) for i, t in enumerate(texts) if t}
        for i, chunks in got.items():
            text = ""
            for at, c in chunks:
                assert at <= len(text) and len(c) <= capacity
                text = text[:at] + c
            assert text == texts[i]


def py_tokens(t):
    plain = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not 0x300 <= ord(c) < 0x370)
    return [x for x in re.split(r"[^\w]|_", unicodedata.normalize("NFC", plain)) if x]


def test_diacritics_are_folded(spark):
    letters, bases = fold_table()
    assert dict(zip(letters, bases))["é"] == "e" and "ø" not in letters and "각" not in letters and len(letters) - len(bases) == 0x70
    con = duckdb.connect()
    for c, b in zip(letters, bases):
        assert con.execute("SELECT strip_accents(?)", [c]).fetchone()[0] == b, hex(ord(c))
    texts = ["Café CAFÉ cafe\u0301", "naïve Ærø", "ǖ ṩ", "plain", None, "日本 각 क़ि", "x\u0301\u0302y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", tokenize("t").alias("toks"))
    got = {r.id: r.toks for r in df.collect()}
    assert got[0] == ["cafe"] * 3 and got[1] == ["naive", "ærø"] and got[2] == ["u", "s"] and got[3] == ["plain"] and got[4] == [] and got[6] == ["xy"]


def test_tokenize_and_counts(spark):
    texts = ["Hello, hello WORLD!", "", "x_y-z 42 42", "Ünïcode wörds été", "   ", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    df = with_term_counts(df.select("id", tokenize("t").alias("toks")), "toks", "tc")
    for r in df.collect():
        assert r.toks == py_tokens(texts[r.id])
        assert {x.term: x.tf for x in r.tc} == dict(Counter(py_tokens(texts[r.id])))


def test_clean_query_and_strip(spark):
    q = "fn_name(x)!?  --punct only-- "
    r = spark.createDataFrame([(q,), (string.punctuation,)], "q string").select(
        clean_query("q").alias("c"), strip_ws("q").alias("s")).collect()
    assert r[0].c == q.translate(str.maketrans(string.punctuation, " " * len(string.punctuation)))
    assert r[0].s == q.strip()
    assert r[1].c.strip() == ""            # punctuation-only query has no terms


def test_exact_only_and_types(spark):
    rows = [("pkg/tests/a.py", "f", ""), ("a.py", "example_f", "minimal"), ("a.py", "f", "full"), ("a.py", "f", "moderate"),
            ("README.md", "README.md", "")]
    df = spark.createDataFrame(rows, "filename string, elem_name string, display_level string")
    got = df.select(exact_only("filename", "elem_name", "display_level").alias("e"), raw_elem_type("filename").alias("t")).collect()
    assert [r.e for r in got] == [True, True, True, False, False]
    assert [r.t for r in got] == ["module", "module", "module", "module", "readme"]


def test_html_to_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><!-- c -->"
            "<p>Tom &amp; Jerry &quot;x&quot;</p><script>var a='</p>';</script><footer>f</footer></body></html>")
    r = spark.createDataFrame([(html,)], "h string").select(html_to_text("h").alias("t")).first()
    assert r.t == 'Tom & Jerry "x"'


@pytest.mark.parametrize("s", ["src0", "Customer#000000001", "héllo", "", "a" * 5000])
def test_adler32_parity(spark, s):
    r = spark.createDataFrame([(s,)], "s string").select(adler32("s").alias("a"), adler32_bucket("s", 8).alias("b")).first()
    assert r.a == zlib.adler32(s.encode())
    assert r.b == zlib.adler32(s.encode()) % 8
