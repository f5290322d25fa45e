"""An index in versions: shards in new folders, a manifest as the commit (SNK-1..SNK-4, JN-2).

Under its root folder an index has

* ``data/<batch>/shard=<k>/`` — rows; a batch is written once and never changed;
* ``manifests/version=<n>/`` — one row per instance: ``(instance_id, shard, n_rows,
  batch, columns)``, instances without rows included; ``columns`` is the rows' schema.

A change writes the shards that it touches as a new batch and then the next manifest,
which is the commit: readers take the newest complete manifest and open the folders
that it names.  A job that ends before its manifest leaves the old version in force.
Shards that no changed instance belongs to keep their files.  Of two writers that
start from one version the second finds the next manifest taken and fails.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import xx_bucket
from quarry.operators.maintenance import N_SHARDS
from quarry.session import finished_folders, write_table


def _shard(n: int) -> Column:
    return xx_bucket("instance_id", n).cast("int")


def current_version(spark: SparkSession, root: str) -> int:
    """The newest complete version; 0 where nothing has been committed."""
    return max((int(f.split("=")[1]) for f in finished_folders(spark, f"{root}/manifests")), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """``(instance_id, shard, n_rows, batch, columns)`` of a version; None before the first."""
    v = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/manifests/version={v}") if v else None


def _folders(m: DataFrame) -> dict[int, str]:
    """Folder of each shard that holds rows: at most as many as there are shards."""
    return {r.shard: f"data/{r.batch}/shard={r.shard}" for r in m.where("n_rows > 0").select("shard", "batch").distinct().collect()}


def read_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, with their ``shard``."""
    m = manifest(spark, root, version)
    if m is None:
        raise FileNotFoundError(f"no complete version under {root}")
    return _read(spark, root, list(_folders(m).values()), m)


def _read(spark: SparkSession, root: str, folders: list[str], m: DataFrame) -> DataFrame:
    """The rows in ``folders``, batch by batch: a batch is the base of its shard folders."""
    batches: dict[str, list[str]] = {}
    for f in folders:
        batches.setdefault(f.split("/")[1], []).append(f"{root}/{f}")
    schema = T.StructType.fromJson(json.loads(m.select("columns").first()[0]))
    parts = [spark.read.schema(schema).option("basePath", f"{root}/data/{b}").parquet(*paths) for b, paths in sorted(batches.items())]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def write_version(spark: SparkSession, root: str, rows: DataFrame, instances: DataFrame | None = None, shards: int = N_SHARDS, shard=None) -> int:
    """Make ``rows(instance_id, ...)`` the whole content of their instances, in a new version; returns its number.

    ``instances(instance_id)`` names instances that are (re)built; those without rows are
    emptied and stand in the manifest with 0 rows.  Other instances stay as they are.
    ``shard`` gives an instance's shard from the number of shards and must not change
    between versions of one index.
    """
    shard = shard or _shard
    version = current_version(spark, root)
    old = manifest(spark, root, version) if version else None
    new = write_table(rows.drop("shard").withColumn("shard", shard(shards)), "index_new_rows")
    named = new.select("instance_id") if instances is None else instances.select("instance_id").unionByName(new.select("instance_id"))
    named = write_table(named.where(F.col("instance_id").isNotNull()).distinct().withColumn("shard", shard(shards)), "index_named")
    touched = [r.shard for r in named.select("shard").distinct().collect()]  # at most ``shards`` values
    if not touched and version:
        return version
    batch = f"b-{uuid.uuid4().hex[:12]}"
    whole = new
    if old is not None:
        folders = [f for k, f in _folders(old).items() if k in set(touched)]
        if folders:
            kept = _read(spark, root, folders, old).join(named.select("instance_id"), "instance_id", "left_anti")
            whole = kept.select(*new.columns).unionByName(new)
    tasks = max(len(touched), spark.sparkContext.defaultParallelism)
    whole.repartition(tasks, "shard", "instance_id").write.mode("errorifexists").partitionBy("shard").parquet(f"{root}/data/{batch}")
    counts = new.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_rows"))
    built = named.join(counts, "instance_id", "left").select("instance_id", "shard", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.lit(batch).alias("batch"))
    if old is not None:
        rest = old.join(named.select("instance_id"), "instance_id", "left_anti")
        built = built.unionByName(rest.drop("columns").withColumn("batch", F.when(F.col("shard").isin(touched), F.lit(batch)).otherwise(F.col("batch"))))
    built = built.select("instance_id", "shard", "n_rows", "batch", F.lit(new.schema.json()).alias("columns"))
    _commit(built, f"{root}/manifests/version={version + 1}")
    return version + 1


def _commit(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def unbuilt(requests: DataFrame, done: DataFrame | None, force: bool = False) -> DataFrame:
    """Instances that still need a build (SNK-4): all when forced or nothing is built, else those without a manifest row."""
    if force or done is None:
        return requests
    return requests.join(done.select("instance_id"), "instance_id", "left_anti")
