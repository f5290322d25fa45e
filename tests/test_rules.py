"""Many rules: needed literals, candidates and matches against testing every pair."""

import random
import re

import pytest

from quarry.sources.rules import enabled_rules, needed_literals, rule_candidates, rule_matches, rules_from_rows


@pytest.mark.parametrize("pattern, literals", [
    ("^pkg/util", ["pkg/util"]), ("(?i)README", ["readme"]), ("(foo|barn)s?", ["barn", "foo"]), ("ab|abc", None), ("a+bcd", ["bcd"]), ("(abc)*x", None), ("(abcd){2,}x", ["abcd"]),
    ("[.]py$", [".py"]), ("[.q]py$", None), (r"\.toml\b", [".toml"]), (".*", None), ("", None), (r"\Qa.b.c\E", None), ("x(?=long)yz", None), ("(ab(cde|fgh)i)+", ["cde", "fgh"]), ("caféteria", ["teria"]),
    ("(unclosed", None), (r"\d{4}-report", ["-report"]), ("(?:one|two|three)", ["one", "three", "two"]), (r"(ab)\1cdef", None)])
def test_needed_literals(pattern, literals):
    assert needed_literals(pattern) == literals


def test_a_match_holds_a_needed_literal():
    rnd = random.Random(8)
    parts = ["abc", "d", "e+", "(f|gh)", "(ij|klm)", "[no]", "p?", "(qrs){1,2}", "t*", "U", "^", "$", r"\b", ".", "(?:v|wxyz)"]
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzU") for _ in range(30)) for _ in range(50)] + ["abcd", "klmabc", "qrsqrswxyz", "ghijU", "abcdeefklm"]
    for _ in range(3000):
        pattern = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
        need = needed_literals(pattern)
        if need:
            for t in texts:
                assert not re.search(pattern, t) or any(x in t.lower() for x in need), pattern


def test_twenty_thousand_rules(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 7))) for _ in range(3000)]
    make = [lambda: rnd.choice(words) + "/" + rnd.choice(words), lambda: "^" + rnd.choice(words), lambda: f"({rnd.choice(words)}|{rnd.choice(words)})x*$",
            lambda: "(?i)" + rnd.choice(words).upper() + "[a-c]", lambda: rnd.choice(words) + rnd.choice(words)]
    rules = [(k, rnd.choice(make)(), rnd.choice([True, True, None, False]), f"r{k}") for k in range(20_000)] + [(-5, "[x-z]", None, "class"), (-6, None, True, "no pattern")]
    texts = ["/".join(rnd.choice(words) for _ in range(3)) for _ in range(250)] + ["", "ab", "zz", None] + ["hot/path"] * 50
    frame = rules_from_rows(spark, rules)
    terms = spark.createDataFrame(list(enumerate(texts)), "id int, term string")
    got = {r.id: (r.matches, r.n_matches) for r in rule_matches(terms, frame).collect()}
    on = sorted((o, re.compile(m), c) for o, m, e, c in rules if e is not False and m is not None)
    memo = {t: [c for _, p, c in on if t is not None and p.search(t)] for t in set(texts)}
    assert got == {i: ("\n---\n".join(memo[t]), len(memo[t])) for i, t in enumerate(texts)}
    tested = rule_candidates(terms.where("term IS NOT NULL").select("term").distinct(), enabled_rules(frame)).count()
    assert tested < 0.05 * len(on) * len(set(texts))


def test_pieces_are_as_long_as_the_literals_allow(spark):
    """in trigrams, numbered rules and numbered names met by the square of their number; candidates now hold the literal and grow with the input."""
    made = []
    for n in (300, 1200):
        rules = rules_from_rows(spark, [(k, f"(?i)/DOC_{k:09d}[.]py$", None, f"r{k}") for k in range(n)])
        terms = spark.createDataFrame([(f"s/doc_{k:09d}.{'py' if k % 2 else 'md'}",) for k in range(n)], "term string")
        pairs = rule_candidates(terms, rules)
        assert pairs.count() == n // 2
        assert rule_matches(terms, rules).where("n_matches = 1").count() == n // 2
        pieces = [f for f in pairs.inputFiles() if "/rule_grams/" in f]
        index = spark.read.parquet(*pieces)
        grams = spark.read.parquet(*[f for f in pairs.inputFiles() if "/term_grams/" in f])
        made.append(grams.join(index, "gram").count())
        assert index.where("length(gram) = 12").count() == n // 2
    assert made[1] <= 6 * made[0]


def test_literals_of_every_length(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP"
    rules = rules_from_rows(spark, [(n, text[:n], None, f"r{n}") for n in range(1, len(text) + 1)] + [(99, "zzz", None, "absent"), (100, text[:4], None, "again"), (100, text[:4], None, "again")])
    got = {r.term: r.n_matches for r in rule_matches(spark.createDataFrame([(text,), (text[:7],), ("ab",), ("",)], "term string"), rules).collect()}
    assert got == {text: len(text) + 1, text[:7]: 8, "ab": 2, "": 0}
