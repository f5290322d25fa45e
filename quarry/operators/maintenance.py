"""Index tables: build, replace by instance, build-once guard, sinks (SNK-1..SNK-6, JN-2, SET-1, SET-2).

Rows get their tag and id here; :mod:`quarry.operators.versions` stores them in
versions with a manifest.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import xx_bucket
from quarry.functions.text import exact_only
from quarry.session import scratch_path

N_SHARDS = 8


def new_version_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}/v-{uuid.uuid4().hex[:12]}")


def with_shard(rows: DataFrame, n: int = N_SHARDS) -> DataFrame:
    return rows.withColumn("shard", xx_bucket("instance_id", n))


def tag_rows(chunks: DataFrame) -> DataFrame:
    """Index rows get the exact-only tag and a stable id from the natural key (SNK-1)."""
    key = F.xxhash64("instance_id", "filename", "elem_name", "parent_name", "elem_type", "display_level", "split_idx")
    return chunks.withColumn("exact_only", exact_only("filename", "elem_name", "display_level")).withColumn("id", key)


def write_predictions(preds: DataFrame, path: str) -> None:
    """One JSON object per line (SNK-5); a NULL patch is an error, as in the reference."""
    missing = F.raise_error(F.concat(F.lit("Fix for "), F.col("instance_id"), F.lit(" is None.")))
    patch = F.when(F.col("model_patch").isNull(), missing).otherwise(F.col("model_patch"))
    preds.select("instance_id", patch.cast("string").alias("model_patch"), "model_name_or_path").write.mode("errorifexists").json(path)


def write_text_per_instance(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One text folder per instance (SNK-6): ``instance_id=<id>/part-*.txt``."""
    (df.select("instance_id", F.col(text_col).alias("value")).repartition("instance_id")
       .write.mode("errorifexists").partitionBy("instance_id").option("lineSep", "\n").text(path))


def local_path(p: str) -> str:
    """POSIX path of a ``file:`` URI (Python file I/O needs a mounted path)."""
    return p[len("file:"):] if p.startswith("file:") else p


def write_files(df: DataFrame, root: str) -> None:
    """Write ``(filename, content)`` rows as real files under ``root`` (per-partition file I/O).

    ``root`` must be a folder every executor can write (a shared mount on a
    cluster).  Each task writes only its own rows, so a retried task
    rewrites the same files.
    """
    base = local_path(root)

    def run(rows):
        made = None
        for r in rows:
            p = os.path.join(base, r["filename"])
            if os.path.dirname(p) != made:
                made = os.path.dirname(p)
                os.makedirs(made, exist_ok=True)
            data = r["content"]
            with open(p, "wb") as f:
                f.write(data if isinstance(data, (bytes, bytearray)) else data.encode("utf-8"))
    df.select("filename", "content").foreachPartition(run)
