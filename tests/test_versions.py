"""Versions of an index: what readers see before, during and after a change."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import versions
from quarry.operators.versions import current_version, manifest, read_index, unbuilt, write_version


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t) for i, t in pairs], "instance_id string, text string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "instance_id string")


def content(spark, root, version=None):
    return sorted((r.instance_id, r.text) for r in read_index(spark, root, version).collect())


def files(root):
    return {os.path.relpath(f, root) for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def by_letter(n):
    return F.pmod(F.ascii("instance_id"), F.lit(n)).cast("int")


def test_refresh_keeps_other_shards_and_old_versions(spark, tmp_path):
    root = str(tmp_path / "ix")
    assert current_version(spark, root) == 0 and manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_index(spark, root)
    first = [("a", "1"), ("a", "2"), ("b", "3"), ("i", "4")]  # a and i share a shard of 8
    assert write_version(spark, root, rows(spark, *first), ids(spark, "a", "b", "i", "empty"), shard=by_letter) == 1
    before = files(root)
    assert content(spark, root) == sorted(first)
    assert {r.instance_id: r.n_rows for r in manifest(spark, root).collect()} == {"a": 2, "b": 1, "i": 1, "empty": 0}
    assert [r.instance_id for r in unbuilt(ids(spark, "a", "empty", "new"), manifest(spark, root)).collect()] == ["new"]
    assert unbuilt(ids(spark, "a"), manifest(spark, root), force=True).count() == 1
    assert write_version(spark, root, rows(spark, ("a", "9")), shard=by_letter) == 2
    assert content(spark, root) == [("a", "9"), ("b", "3"), ("i", "4")] and content(spark, root, 1) == sorted(first)
    assert before <= files(root) and not any("shard=2" in f for f in files(root) - before)
    assert len({r.batch for r in manifest(spark, root).where("instance_id IN ('a', 'i')").collect()}) == 1
    # emptied, and nothing to do
    assert write_version(spark, root, rows(spark, ("a", "9")).limit(0), ids(spark, "b", "a", "i"), shard=by_letter) == 3
    assert content(spark, root) == [] and {r.n_rows for r in manifest(spark, root).collect()} == {0}
    assert write_version(spark, root, rows(spark, ("a", "9")).limit(0), ids(spark), shard=by_letter) == 3
    assert write_version(spark, root, rows(spark, ("z", "5")), shard=by_letter) == 4 and content(spark, root) == [("z", "5")]


def test_a_job_that_ends_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ix")
    write_version(spark, root, rows(spark, ("a", "1"), ("b", "2")))

    def broken(rows, path):
        raise RuntimeError("lost")
    monkeypatch.setattr(versions, "_commit", broken)
    with pytest.raises(RuntimeError):
        write_version(spark, root, rows(spark, ("a", "3")))
    monkeypatch.undo()
    assert current_version(spark, root) == 1 and content(spark, root) == [("a", "1"), ("b", "2")]
    # a manifest without its end mark is none
    os.makedirs(f"{root}/manifests/version=2")
    assert current_version(spark, root) == 1 and content(spark, root) == [("a", "1"), ("b", "2")]


def test_the_second_writer_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ix")
    write_version(spark, root, rows(spark, ("a", "1")))
    commit = versions._commit

    def late(frame, path):
        monkeypatch.setattr(versions, "_commit", commit)
        write_version(spark, root, rows(spark, ("a", "other")))
        commit(frame, path)
    monkeypatch.setattr(versions, "_commit", late)
    with pytest.raises(Exception, match="exists"):
        write_version(spark, root, rows(spark, ("a", "mine")))
    assert content(spark, root) == [("a", "other")] and current_version(spark, root) == 2
