import json
import os

from pyspark.sql import functions as F

from quarry.operators.index import build_text_index, write_text_index
from quarry.sources.instances import read_instances
from quarry.sources.rules import enabled_rules, read_rules


def test_write_text_index(spark, tmpdir_path):
    c = spark.createDataFrame([(1, "i1", 3, "a.py", "x y y"), (2, "i2", 5, "b.py", "y z"), (3, "i1", 3, "c.py", "")],
                              "id long, instance_id string, shard int, filename string, content string")
    idx = build_text_index(c, scope_cols=("instance_id", "shard"))
    write_text_index(idx, tmpdir_path + "/idx", shard_col="shard")
    back = spark.read.parquet(tmpdir_path + "/idx/postings")
    listing = os.listdir(tmpdir_path + "/idx/postings")
    assert "shard=3" in listing and "shard=5" in listing
    assert back.count() == idx.postings.count()
    got = {(r.id, r.term): r.tf for r in back.where(F.col("term").isNotNull()).collect()}
    assert got[(1, "y")] == 2 and got[(2, "z")] == 1
    # the row without content tokens still counts (filename tokens) in N
    assert back.where("first").count() == 3


def test_read_rules_toml(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "rules.toml")
    with open(p, "w") as f:
        f.write('[[injections]]\nmatch = "^a"\nenabled = false\ncontent = "A"\n\n'
                '[[injections]]\nmatch = "b"\ncontent = """\nB text\n"""\n')
    r = read_rules(spark, p)
    assert [(x.ord, x.match, x.enabled) for x in r.orderBy("ord").collect()] == [(0, "^a", False), (1, "b", None)]
    assert [x.content for x in enabled_rules(r).collect()] == ["B text\n"]


def test_read_instances(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "inst.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"instance_id": "o__r-1", "repo": "o/r", "patch": "--- a\n", "split": "test"}) + "\n")
    df = read_instances(spark, p, fmt="json")
    row = df.first()
    assert (row.instance_id, row.repo, row.test_patch) == ("o__r-1", "o/r", None)
    assert df.schema["base_commit"].dataType.simpleString() == "string"
