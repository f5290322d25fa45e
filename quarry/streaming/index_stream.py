"""Incremental index maintenance with Structured Streaming (SNK-3, SNK-4 as a stream).

New instance files land in a folder; each micro-batch turns its rows into
index rows and appends them to the shard-partitioned index.  The build-once
guard of the reference becomes the stream's own progress log: a file is
processed exactly once per checkpoint location, and a re-run after a crash
resumes from the last committed batch (``foreachBatch`` with an idempotent
sink keyed by ``batch_id``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.maintenance import with_shard


def start_index_stream(spark: SparkSession, source_dir: str, schema: str, to_rows: Callable[[DataFrame], DataFrame],
                       index_path: str, checkpoint: str, glob: str | None = None, max_files: int = 1,
                       available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``to_rows`` maps a batch of source rows to index rows (must contain
    ``instance_id``).  Each batch is written under ``batch=<id>`` with
    overwrite semantics for that batch only, so a replayed batch replaces
    its own output instead of duplicating it.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = with_shard(to_rows(batch)).withColumn("batch", F.lit(batch_id))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch", "shard").parquet(index_path))

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
