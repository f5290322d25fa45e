from pyspark.sql import functions as F

from quarry.operators.cache import cache_get, cache_put
from quarry.operators.inference import call_cached, hashing_embedder, rule_failing_provider
from quarry.operators.stats import classify_outcome, histogram_bins, value_distribution
from quarry.session import broadcast_if_small, checkpoint_dir
from quarry.sources.instances import allow_list, get_instance, shard

import pytest


def test_cache_upsert_and_get(spark):
    rows = spark.createDataFrame([("k1", "p1", '"a"', 1), ("k1", "p2", '"b"', 2), ("k2", "p1", '"c"', 3)],
                                 "key string, prompt string, value string, seq long")
    c = cache_put(None, rows)
    assert {(r.key, r.prompt, r.value) for r in c.collect()} == {("k1", "p2", '"b"'), ("k2", "p1", '"c"')}
    req = spark.createDataFrame([("k1", "p1"), ("k1", "p2"), ("k3", "p1")], "key string, prompt string")
    got = {(r.key, r.prompt): (r.hit, r.value) for r in cache_get(req, c).collect()}
    assert got == {("k1", "p1"): (False, None), ("k1", "p2"): (True, '"b"'), ("k3", "p1"): (False, None)}


def test_call_cached(spark):
    req = spark.createDataFrame([("a", "hello world"), ("b", "x" * 6000), ("c", "again")], "key string, prompt string")
    ans, cache = call_cached(req, None, hashing_embedder(16))
    st = {r.key: (r.status, r.cached) for r in ans.collect()}
    assert st == {"a": ("ok", False), "b": ("token_limit", False), "c": ("ok", False)}
    ans2, _ = call_cached(req, cache, hashing_embedder(16))
    assert {r.key: r.cached for r in ans2.collect()} == {"a": True, "b": False, "c": True}
    bad = spark.createDataFrame([("r", "x" * 10), ("t", "x" * 14), ("e", "x" * 22), ("o", "x" * 13)], "key string, prompt string")
    a3, _ = call_cached(bad, None, rule_failing_provider, batch_size=1, max_attempts=2)
    assert {r.key: r.status for r in a3.collect()} == {"r": "rate_limited", "t": "token_limit", "e": "error", "o": "ok"}


def test_distribution_and_outcomes(spark):
    stats = spark.createDataFrame([(0, 1, 0, 3), (1, 1, 2, 15), (2, 2, 1, 120)],
                                  "num_files long, num_edits long, num_imports long, num_lines long")
    d = {(r.metric, r.value): (r.n, r.pct, r.cumulative_pct) for r in value_distribution(stats).collect()}
    assert d[("num_files", 1)] == (1, round(100 / 3, 6), round(200 / 3, 6))
    assert d[("num_edits", 1)] == (2, round(200 / 3, 6), round(200 / 3, 6))
    assert d[("num_edits", 2)] == (1, round(100 / 3, 6), 100.0)
    assert d[("num_files", 7)] == (0, 0.0, 100.0)
    assert len([k for k in d if k[0] == "num_lines"]) == 101
    logs = spark.createDataFrame([("SOME TESTS FAILED and All tests passed",), ("apply patch failed",), ("",)], "t string")
    assert [r.o for r in logs.select(classify_outcome(F.col("t")).alias("o")).collect()] == ["success", "patch_failure", "unknown"]


def test_instances_and_guards(spark):
    inst = spark.createDataFrame([(f"i{i}", "r") for i in range(50)], "instance_id string, repo string")
    parts = [shard(inst, 4, k).count() for k in range(4)]
    assert sum(parts) == 50
    assert shard(inst, None, None).count() == 50
    with pytest.raises(ValueError):
        get_instance(inst, "nope")
    assert get_instance(inst, "i3").count() == 1
    assert allow_list(inst, ["i1", "i2", "zz"]).count() == 2
    ids = spark.createDataFrame([("i1",), ("i9",)], "instance_id string")
    assert allow_list(inst, ids).count() == 2
    assert broadcast_if_small(ids, 1) is ids          # over the bound: no broadcast hint
    assert checkpoint_dir(spark)


def test_values_above_the_domain_are_counted(spark):
    rows = [(1, 0, 3, 7), (1, 9, 90, 100), (40, 2, 51, 101), (11, 11, 7, 5000)]
    stats = spark.createDataFrame(rows, "num_files long, num_imports long, num_edits long, num_lines long")
    d, h = value_distribution(stats, overflow=True).collect(), histogram_bins(stats, overflow=True).collect()
    for m in stats.columns:
        assert sum(r.n for r in d if r.metric == m) == sum(r.n for r in h if r.metric == m) == len(rows)
        assert max(r.cumulative_pct for r in d if r.metric == m) == 100.0
    assert {(r.value, r.n) for r in d if r.metric == "num_files" and r.n} == {(1, 2), (11, 2)}
    assert {(r.bin_lo, r.bin_hi, r.n) for r in h if r.metric == "num_lines"} == {(0, 10, 1), (100, 110, 1), (101, None, 2)}
    assert sum(r.n for r in value_distribution(stats).collect() if r.metric == "num_files") == 2
    assert sum(r.n for r in histogram_bins(stats).collect() if r.metric == "num_files") == 2
