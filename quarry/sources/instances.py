"""Instance selection (SRC-1..SRC-4).

Instances are rows ``(instance_id, repo, base_commit, problem_statement,
hints_text, patch, test_patch, split)``.  Sharding is by key hash (row
position is not stable in a distributed scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import xx_bucket
from quarry.session import broadcast_if_small

INSTANCE_SCHEMA = ("instance_id string, repo string, base_commit string, problem_statement string, "
                   "hints_text string, patch string, test_patch string, split string")


def read_instances(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Instances with a declared schema (never inferred)."""
    return spark.read.schema(INSTANCE_SCHEMA).format(fmt).load(path)


def select_split(instances: DataFrame, split: str | None) -> DataFrame:
    """SRC-1: rows of one split (all when None)."""
    return instances if split is None else instances.where(F.col("split") == split)


def shard(instances: DataFrame, num_shards: int | None, shard_id: int | None, key: str = "instance_id") -> DataFrame:
    """SRC-2: deterministic shard ``pmod(xxhash64(key), n) == i``; off when ``shard_id`` is None."""
    if shard_id is None or num_shards is None:
        return instances
    return instances.where(xx_bucket(key, num_shards) == shard_id)


def get_instance(instances: DataFrame, instance_id: str) -> DataFrame:
    """SRC-3: the one row with this id; raises ``ValueError`` when missing."""
    row = instances.where(F.col("instance_id") == instance_id)
    if row.isEmpty():
        raise ValueError(f"Item with id {instance_id} not found in dataset.")
    return row


def allow_list(instances: DataFrame, ids: DataFrame | list | None) -> DataFrame:
    """SRC-4: keep listed ids (``left_semi``; the list side broadcast after a size check)."""
    if ids is None:
        return instances
    if isinstance(ids, list):
        return instances.where(F.col("instance_id").isin(ids))
    return instances.join(broadcast_if_small(ids.select("instance_id").distinct()), "instance_id", "left_semi")
