"""Source-tree and log scans (SRC-5..SRC-9).

Files are read with Spark's ``binaryFile`` / ``text`` sources, so listing and
reading are distributed; routing and exclusion are column predicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

# Excluded directory names (substring test on the walk root,
# equality test on a listed directory) and excluded file extensions.
EXCLUDE_DIRS = [".git", ".github", "venv", "node_modules", "__pycache__"]
EXCLUDE_EXTS = [".pyc"]
README_MARK = "README"
LOG_GLOB = "*.eval.log"
# Bytes that opening a log counts for when files are dealt to tasks.
LOG_OPEN_COST = "64k"


def _any_contains(col: Column, subs) -> Column:
    c = F.lit(False)
    for s in subs:
        c = c | col.contains(s)
    return c


def parent_dir(path: Column) -> Column:
    """Directory part of a relative path ('' at top level)."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_source_tree(spark: SparkSession, root: str, instance_id: str | None = None) -> DataFrame:
    """SRC-5/SRC-6: files under ``root`` as ``(instance_id, filename, content, kind)``.

    Excluded: a file whose directory string contains an excluded name, and
    ``.pyc`` files.  Routing: ``.py`` -> module (``raw`` when it does not
    parse is decided later by the element job), name with README -> raw,
    anything else dropped; non-UTF-8 files are skipped.
    """
    root = root.rstrip("/")
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "content"))
    rel = F.regexp_replace(F.col("path"), r"^(file:)?\Q" + root + r"/\E", "")
    df = df.select(rel.alias("filename"), "content")
    d = parent_dir(F.col("filename"))
    ext_bad = F.lit(False)
    for e in EXCLUDE_EXTS:
        ext_bad = ext_bad | F.col("filename").endswith(e)
    df = df.where(~_any_contains(d, EXCLUDE_DIRS) & ~ext_bad)
    kind = (F.when(F.col("filename").endswith(".py"), F.lit("module"))
            .when(F.col("filename").contains(README_MARK), F.lit("raw")))
    text = F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n")  # as text-mode reading folds line ends
    df = df.where(kind.isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))).select(
        F.lit(instance_id).cast("string").alias("instance_id"), "filename", text.alias("content"), kind.alias("kind"))
    return df


def list_dirs(paths: DataFrame, path_col: str = "filename", keep=("instance_id",)) -> DataFrame:
    """SRC-7: distinct directories of the file paths, minus excluded ones.

    A directory is listed unless its parent contains an excluded name or it
    *is* an excluded name (so ``pkg/venv`` is listed, ``pkg/venv/lib`` and
    ``venv`` are not).  Directories without files are not visible here.
    """
    keep = [c for c in keep if c in paths.columns]
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    dirs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))) \
            .otherwise(F.array().cast("array<string>"))
    d = paths.select(*keep, F.explode_outer(dirs).alias("dir")).where(F.col("dir").isNotNull()).distinct()
    par = parent_dir(F.col("dir"))
    ok = ~_any_contains(par, EXCLUDE_DIRS) & ~F.col("dir").isin(EXCLUDE_DIRS)
    return d.where(ok).withColumn("depth", (F.length("dir") - F.length(F.replace(F.col("dir"), F.lit("/"), F.lit("")))).cast("long"))


def get_dirs(dirs: DataFrame, prefix: str | None = None, max_depth: int | None = 0) -> DataFrame:
    """SRC-8: ``count('/') <= max_depth`` (None = any) and ``startswith(prefix)``."""
    out = dirs
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    if prefix:
        out = out.where(F.col("dir").startswith(prefix))
    return out


def scan_eval_logs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9: ``*.eval.log`` files, whole text, lower-cased, with their name.

    Logs are small and many: a task takes some 2,000 of them, where the session's cost
    of opening a file would give it 32.  The setting holds in a session of its own, which
    reads the logs into a table of the shared folder.
    """
    path = scratch_path(spark, f"eval_logs/t-{uuid.uuid4().hex[:12]}")
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", LOG_OPEN_COST)
    df = (own.read.text(folder, wholetext=True, pathGlobFilter=LOG_GLOB)
          .select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("path"), F.lower("value").alias("content")))
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
