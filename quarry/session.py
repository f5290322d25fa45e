"""Session construction and cluster-safety helpers.

Nothing here changes query semantics: it sets the engine up (AQE, UTC,
shuffle width) and offers two guards every operator uses:

* :func:`broadcast_if_small` — broadcast a side only after its row count has
  been *measured* below a bound; otherwise leave the join to the planner
  (sort-merge, or AQE's runtime broadcast when the shuffled side turns out
  small).
* :func:`shuffled` — never broadcast a side that grows with the input, whatever
  size the planner derives for it from a compressed table;
* :func:`checkpoint_dir` — the shared folder named by ``spark.checkpoint.dir``;
  a private folder is created only when the session has none (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default bound for broadcasting a query-side frame (rows).  A query batch,
# a rule list or a category table stays far below it; a corpus never does.
BROADCAST_MAX_ROWS = 200_000


def build_session(app: str = "quarry", cpus: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Local session configured the way the operators expect.

    On a cluster the same keys come from ``spark-submit``; ``getOrCreate``
    keeps whatever the cluster already set.
    """
    parts = shuffle_partitions or (8 if cpus == "*" else max(4, int(cpus)))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read, never overridden, and a cluster without it is an error.
    A local session gets a fresh temp folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder; survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but the copy is columnar: later scans
    prune columns and push filters, and a lost executor only re-reads files.
    """
    import uuid
    path = scratch_path(df.sparkSession, f"{name}/t-{uuid.uuid4().hex[:12]}")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` whose write has ended (they hold ``_SUCCESS``)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def spread(df: DataFrame, min_partitions: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Repartition only when a scan gives fewer partitions than the cluster can run.

    A table stored as one Parquet row group is read by one task; the text
    work after it (tokenising, parsing, Python stages) would then run on one
    core.  On a large input the scan already has many splits and this is a
    no-op (no extra shuffle).  With ``keys`` the rows are hash partitioned by
    them, so a later aggregate that groups by those keys needs no exchange.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # a plan with an exchange would run it just to be counted: only plain scans are asked
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec" and df.rdd.getNumPartitions() >= want:
        return df
    # hash by a key when given: later aggregates grouped by that key reuse
    # this partitioning instead of shuffling their (larger) output again
    return df.repartition(want, *keys) if keys else df.repartition(want)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after proving ``df`` holds at most ``max_rows`` rows.

    The probe is ``limit(max_rows + 1).count()``: bounded work whatever the
    input size.  Above the bound the frame is returned unchanged and the
    planner picks a shuffle join (AQE may still convert it at run time from
    measured shuffle sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Ask for a sort-merge join of ``df``, a side that grows with the input.

    The planner takes the size of a derived frame from the compressed table below it:
    rendered files, elements or displays of a few GB count as a few MB, are broadcast
    and fill the driver.
    """
    return df.hint("merge")
