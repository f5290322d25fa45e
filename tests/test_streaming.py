import os

from pyspark.sql import functions as F

from quarry.operators.chunking import fixed_chunks
from quarry.streaming.index_stream import start_index_stream

SCHEMA = "doc_id long, instance_id string, text string"


def _rows(batch):
    return fixed_chunks(batch.select("instance_id", "doc_id", F.col("text").alias("content")), "content", 8)


def test_stream_is_incremental_and_resumable(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, d) for d in ("src", "index", "ckpt"))
    spark.createDataFrame([(1, "a", "x" * 10), (2, "b", "y" * 3)], SCHEMA).coalesce(1).write.parquet(src + "/f1")
    start_index_stream(spark, src + "/f1", SCHEMA, _rows, out, ck).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 2 + 1                       # 10 chars at capacity 8 -> 2 chunks; 3 chars -> 1
    start_index_stream(spark, src + "/f1", SCHEMA, _rows, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == first        # nothing new: the progress log skips done files
    spark.createDataFrame([(3, "a", "z" * 20)], SCHEMA).coalesce(1).write.mode("append").parquet(src + "/f1")
    start_index_stream(spark, src + "/f1", SCHEMA, _rows, out, ck).awaitTermination()
    assert spark.read.parquet(out).where("instance_id = 'a'").count() == 2 + 3   # only the new file was added


def test_documents_as_a_file_and_as_a_folder(spark, tmpdir_path):
    from quarry.plans.maintenance_plans import stream_index_build
    docs = spark.createDataFrame([(1, "x" * 5000, "en", "a", 5000), (2, "y", "fr", "b", 1), (3, None, "fr", "b", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    folder, single = os.path.join(tmpdir_path, "folder"), os.path.join(tmpdir_path, "single")
    docs.repartition(3).write.parquet(folder + "/documents.parquet")
    docs.toPandas().to_parquet(os.path.join(os.makedirs(single) or single, "documents.parquet"))
    for d in (folder, single):
        assert {r.instance_id: r.n_rows for r in stream_index_build(spark, d).collect()} == {"a/en": 2, "b/fr": 1}
