"""The index build as one operator, and search by query text over it (SNK-1..SNK-4, INF-1, SCH-1, JN-2).

files -> elements -> displays -> index rows -> chunks -> exact-only tag -> vectors of
what is not exact-only -> one Parquet table, partitioned by shard and spread over
several tasks a shard.  The table holds text, tags and vectors together, so
searches, filters and results read it alone and never the source files again.

The embedder is a stand-in for a model and runs as Spark expressions: each token
adds or subtracts one in a bucket drawn from its md5, and the vector is scaled to
length one.  Queries are embedded by the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws, tokenize
from quarry.operators.chunking import DEFAULT_CAPACITY, fixed_chunks
from quarry.operators.elements import element_displays, extract_elements, index_rows
from quarry.operators.maintenance import N_SHARDS, new_version_path, tag_rows
from quarry.operators.search import l1_search
from quarry.operators.versions import manifest, read_index, unbuilt, write_version
from quarry.session import shuffled, write_table

VECTOR_DIM = 64


def embed_rows(rows: DataFrame, id_col: str, text_col: str, dim: int = VECTOR_DIM, parts: int | None = None) -> DataFrame:
    """``(id, embedding)``: hashed bag of words of length one; a text without tokens has the zero vector.

    ``parts``: tasks that the words are counted in, at least one a core; more where the texts are many.
    """
    n = max(1, parts or 0, rows.sparkSession.sparkContext.defaultParallelism)
    # a text takes less room than its words
    t = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition(n, "id").select("id", tokenize(strip_ws("_text")).alias("_t"))
    h = t.select("id", F.explode_outer("_t").alias("_w")).withColumn("_h", F.md5(F.col("_w").cast("binary")))
    bucket = (F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("_h", 7, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    # both aggregates keep the partitioning by id
    per = h.groupBy("id", bucket.alias("_b")).agg(F.sum(F.when(F.col("_w").isNotNull(), sign)).alias("_s"))
    v = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_s")))).alias("_m"),
                              F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_n"))
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("_n") > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_n")).otherwise(0.0))
    return v.select(F.col("id").alias(id_col), values.alias("embedding"))


def index_table(files: DataFrame, capacity: int = DEFAULT_CAPACITY, dim: int = VECTOR_DIM) -> DataFrame:
    """Index rows of ``files(instance_id, filename, content)`` with tag, id and vector (empty where exact-only)."""
    elements = write_table(extract_elements(files), "elements")
    rows = index_rows(element_displays(elements, files)).where(F.length("content") > 0)
    tagged = write_table(tag_rows(fixed_chunks(rows, "content", capacity)), "index_rows")
    vectors = embed_rows(tagged.where(~F.col("exact_only")), "id", "content", dim)
    return tagged.join(shuffled(vectors), "id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>")))


def build_index(spark: SparkSession, files: DataFrame, root: str | None = None, capacity: int = DEFAULT_CAPACITY, dim: int = VECTOR_DIM,
                shards: int = N_SHARDS, force: bool = True) -> DataFrame:
    """Build the instances of ``files`` into the versioned index at ``root`` (a new one by default) and read it back.

    ``force`` rebuilds all of them; otherwise only those without a manifest row are built.
    """
    root = root or new_version_path(spark, "index")
    wanted = unbuilt(files.select("instance_id").distinct(), manifest(spark, root), force)
    write_version(spark, root, index_table(files.join(shuffled(wanted), "instance_id", "left_semi"), capacity, dim), wanted, shards)
    return read_index(spark, root)


def search_by_text(index: DataFrame, queries: DataFrame, k: int = 15, dim: int = VECTOR_DIM, **options) -> DataFrame:
    """Exact L1 top-k of ``queries(query_id, instance_id, text)`` by their embedded text (SCH-1, TXT-7)."""
    q = shuffled(queries.select("query_id", "instance_id")).join(embed_rows(queries, "query_id", "text", dim).withColumnRenamed("embedding", "qvec"), "query_id")
    return l1_search(index, q, k=k, **options)
