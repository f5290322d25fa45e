"""Accepted patches against git itself; line alignment against dynamic programming."""

import random
import shutil
import subprocess

import pytest

from quarry.functions.linediff import common_lines, edit_blocks, header, hunks_of
from quarry.operators.apply import accepted_patches, first_valid_variant, minimal_patches, splice
from quarry.operators.patches import fit_check, parse_patches


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_lines_are_a_longest_subsequence():
    rnd = random.Random(1)
    for _ in range(600):
        a, b = ([rnd.choice("abcde")[:1] for _ in range(rnd.randint(0, 12))] for _ in range(2))
        pairs = common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == lcs_length(a, b)
        back, at = [], 0
        for i0, i1, j0, j1 in edit_blocks(a, b):
            back += a[at:i0] + b[j0:j1]
            at = i1
        assert back + a[at:] == b


def test_contexts_that_touch_share_a_hunk():
    old = [str(k) for k in range(30)]
    got = hunks_of(old, [(2, 3, ["x"]), (9, 9, ["y"]), (20, 21, [])], 3)
    assert [(h["old"], h["new"], len(h["lines"])) for h in got] == [(0, 0, 14), (17, 18, 7)]
    assert [header(h["old"], h["new"], h["lines"]) for h in got] == ["@@ -1,12 +1,13 @@", "@@ -18,7 +19,6 @@"]


def some_patch(rnd, files):
    """A patch of one or two files: right, moved, with blanks at line ends, with wrong lines, without context."""
    out = []
    for path in rnd.sample(sorted(files), rnd.choice([1, 1, 2])):
        old = files[path]
        out += [f"--- a/{path}", f"+++ b/{path}"]
        shift, at = 0, 0
        for _ in range(rnd.choice([1, 1, 2])):
            at += rnd.randint(0, 4)
            n = rnd.randint(0, 6)
            if at + n > len(old):
                break
            ctx = rnd.choice([0, 1, 2])
            lines = [" " + x if k < ctx or k >= n - ctx else rnd.choice(["-", "-", " "]) + x for k, x in enumerate(old[at:at + n])]
            for _ in range(rnd.randint(0 if n else 1, 2)):
                lines.insert(rnd.randint(min(ctx, len(lines)), max(min(ctx, len(lines)), len(lines) - ctx)), "+" + rnd.choice(["new", "new 2  ", "b", "", "c\t"]))
            if not lines:
                continue
            spoil = rnd.random()
            k = rnd.randrange(len(lines))
            if spoil < .1 and lines[k][0] != "+":
                lines[k] += "wrong"
            elif spoil < .25 and lines[k][0] != "+":
                lines[k] += "  "
            size_old, size_new = sum(x[0] in " -" for x in lines), sum(x[0] in " +" for x in lines)
            move = rnd.choice([0, 0, 0, 1, -1, 4])
            s_old, s_new = at + (1 if size_old else 0), at + shift + (1 if size_new else 0)
            out += [f"@@ -{max(0, s_old + move)},{size_old} +{max(0, s_new + move)},{size_new} @@", *lines]
            shift += size_new - size_old
            at += n
    return "\n".join(out) + "\n"


def by_git(tmp, files, patch):
    """(accepted?, {path: lines}, changed lines) as git has it."""
    run = lambda *a, **k: subprocess.run(["git", *a], cwd=tmp, capture_output=True, text=True, **k)
    run("checkout", "-q", "--", ".")
    (tmp / "p.patch").write_text(patch)
    if run("apply", "--unidiff-zero", "--whitespace=fix", "p.patch").returncode:
        return False, None, None
    diff = run("diff", "--no-color").stdout
    state = {p: (tmp / p).read_text().split("\n")[:-1] for p in files}
    return diff != "", state, sum(x[:1] in "+-" and x[:3] not in ("+++", "---") for x in diff.split("\n"))


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_accepted_as_git_does(spark, tmp_path):
    rnd = random.Random(11)
    files = {"a.txt": [rnd.choice(["a", "b", "c", "", "  d", "e  "]) for _ in range(14)], "d/b.txt": [f"line {k}" for k in range(12)], "one.txt": ["only"]}
    for args in (["init", "-q"], ["config", "user.email", "x@y"], ["config", "user.name", "x"], ["config", "core.autocrlf", "false"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    (tmp_path / "d").mkdir()
    for p, lines in files.items():
        (tmp_path / p).write_text("".join(x + "\n" for x in lines))
    subprocess.run(["git", "add", "."], cwd=tmp_path, check=True)
    subprocess.run(["git", "commit", "-qm", "x"], cwd=tmp_path, check=True)
    patches = [(k, some_patch(rnd, files)) for k in range(250)]
    file_lines = spark.createDataFrame([(p, k + 1, x) for p, lines in files.items() for k, x in enumerate(lines)], "path string, line_no int, line string")
    got = {r.patch_id: r.accepted for r in accepted_patches(spark.createDataFrame(patches, "patch_id long, patch string"), file_lines).collect()}
    assert len(got) == len(patches)
    yes = 0
    for k, patch in patches:
        ok, state, changed = by_git(tmp_path, files, patch)
        assert (got[k] is not None) == ok, patch
        if ok:
            yes += 1
            again, state2, changed2 = by_git(tmp_path, files, got[k])
            assert state2 == state and changed2 == changed, patch
            assert subprocess.run(["git", "checkout", "-q", "--", "."], cwd=tmp_path).returncode == 0
            (tmp_path / "q.patch").write_text(got[k])
            assert subprocess.run(["git", "apply", "--check", "q.patch"], cwd=tmp_path).returncode == 0, got[k]
    assert 60 < yes < 230
    # the strict texts stand at their stated lines
    strict = spark.createDataFrame([(k, v) for k, v in got.items() if v], "patch_id long, patch string")
    assert fit_check(parse_patches(strict), file_lines).where("NOT fits").count() == 0


HEAD = "--- a/f\n+++ b/f\n"


@pytest.mark.parametrize("patch, accepted", [
    (HEAD + "@@ -2 +2 @@\n-b\n+B\n", True), (HEAD + "@@ -2 +2 @@\n-b\n+B", False), (HEAD + "\n@@ -2 +2 @@\n-b\n+B\n", False),
    (HEAD + "@@ -2 +2 @@\n-b\n+B\n\n@@ -3 +3 @@\n-c\n+C\n", False), (HEAD + "@@ -2,2 +2 @@\n-b\n+B\n", False), (HEAD + "@@ -2 +2 @@\n-b\n+b\n", False),
    ("--- a/g\n+++ b/g\n@@ -2 +2 @@\n-b\n+B\n", False), ("", False), (None, False), ("no patch", False),
    ("--- a/f\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n-b\n-c\n", True), ("--- a/f\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n", False),
    ("--- /dev/null\n+++ b/new\n@@ -0,0 +1 @@\n+x\n", False), (HEAD + "@@ -2 +2 @@\n-b\n+B\n--- /dev/null\n+++ b/new\n@@ -0,0 +1 @@\n+x\n", True),
    (HEAD + "@@ -2 +2 @@\n-b\n+B\n--- /dev/null\n+++ b/f2\n@@ -0,0 +1 @@\n+x\n", False), (HEAD + "@@ -40 +40 @@\n-b\n+B\n", True)])
def test_accepted_or_not(spark, patch, accepted):
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c"), ("f2", 1, "x")], "path string, line_no int, line string")
    got = accepted_patches(spark.createDataFrame([(1, patch)], "patch_id int, patch string"), lines).collect()
    assert [r.accepted is not None for r in got] == [accepted]


def test_instances_are_kept_apart(spark):
    lines = spark.createDataFrame([("one", "f", 1, "a"), ("two", "f", 1, "z")], "instance_id string, path string, line_no int, line string")
    p = spark.createDataFrame([(1, "one", HEAD + "@@ -1 +1 @@\n-a\n+b\n"), (2, "two", HEAD + "@@ -1 +1 @@\n-a\n+b\n")], "patch_id int, instance_id string, patch string")
    assert {r.patch_id: r.variant for r in first_valid_variant(p, lines, instance_col="instance_id").collect()} == {1: "default", 2: None}
    assert {r.patch_id: r.accepted for r in accepted_patches(p, lines, instance_col="instance_id").collect()} == {
        1: "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n", 2: None}


def test_minimal_hunks_split(spark):
    p = HEAD + "@@ -3,7 +3,7 @@ section\n a\n-b\n-c\n-d\n+B\n+c\n+D\n e\n-f\n+f\n g\n@@ -20,2 +20,2 @@\n x\n-y\n+y\n"
    got = minimal_patches(parse_patches(spark.createDataFrame([(1, p)], "patch_id int, patch string"))).first().patch
    assert got == HEAD + "@@ -4 +4 @@\n-b\n+B\n@@ -6 +6 @@\n-d\n+D\n"


def test_hash_met_by_chance_is_no_place():
    assert splice(["a"], [{"src_start": 1, "tgt_start": 1, "places": [0], "body": [{"marker": "-", "value": "b"}]}]) is None


def test_variants_alike_are_tried_once(spark, monkeypatch):
    """variants that equal an earlier one were parsed and placed again; rows that share an id keep all of theirs."""
    from quarry.operators import apply
    tried = []
    whole = apply.accepted_patches

    def counted(patches, *args):
        tried.append(patches.count())
        return whole(patches, *args)

    monkeypatch.setattr(apply, "accepted_patches", counted)
    plain = "--- a/f.py\n+++ b/f.py\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"
    blank, bare = plain.replace("@@ -1", "\n\n@@ -1"), "--- a/f.py\n+++ b/f.py\n@@ -2 +2 @@\n-b\n+B\n"
    lines = spark.createDataFrame([("f.py", 1, "a"), ("f.py", 2, "b"), ("f.py", 3, "c")], "path string, line_no int, line string")
    frame = spark.createDataFrame([(1, plain), (2, blank), (3, bare), (4, None), (5, plain), (5, plain)], "patch_id long, patch string")
    got = sorted((r.patch_id, r.variant) for r in apply.first_valid_variant(frame, lines).collect())
    assert got[:4] == [(1, "default"), (2, "default_no_blank"), (3, "default"), (4, None)]
    assert tried == [2 + 4 + 1 + 1 + 8]
