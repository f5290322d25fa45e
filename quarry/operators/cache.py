"""Keyed result cache as a table (KV-1, KV-2, KV-3).

Schema: ``(key string, prompt string, value string /* JSON */, seq long)``.

* get (KV-1): a request hits only when **key and prompt** both match; a
  changed prompt is a miss.
* put (KV-2): one row per **key**; the row with the highest ``seq`` wins
  (``max_by`` over a struct, a partial aggregate, so a hot key is combined
  per task before the shuffle).
* values are JSON text (KV-3): ``to_json`` on write, ``from_json`` on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_COLS = ["key", "prompt", "value", "seq"]


def cache_get(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests(key, prompt, ...)`` + ``hit`` flag and cached ``value`` (left join)."""
    c = cache.select("key", "prompt", F.col("value").alias("_v"), F.lit(True).alias("_hit"))
    j = requests.join(c, ["key", "prompt"], "left")
    return j.withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).withColumnRenamed("_v", "value").drop("_hit")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests not answered by the cache (``left_anti`` on key + prompt)."""
    return requests.join(cache.select("key", "prompt"), ["key", "prompt"], "left_anti")


def cache_put(cache: DataFrame | None, new_rows: DataFrame) -> DataFrame:
    """Upsert: union, then keep the latest ``seq`` per key."""
    rows = new_rows.select(*CACHE_COLS)
    allr = rows if cache is None else cache.select(*CACHE_COLS).unionByName(rows)
    latest = allr.groupBy("key").agg(F.max_by(F.struct("prompt", "value", "seq"), F.struct("seq", "prompt", "value")).alias("_w"))
    return latest.select("key", "_w.prompt", "_w.value", "_w.seq")


def to_json_value(col: Column) -> Column:
    return F.to_json(F.struct(col.alias("v")))
