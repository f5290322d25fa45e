"""Driver table scans.

Tables are single Parquet files (or folders) named after the table.  The
schema comes from the Parquet footer (never inferred from data); column
pruning and filter push-down reach the scan because every operator selects
and filters with built-in expressions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ship_package

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
# Tables whose rows carry heavy per-row work (text, parsing, Python stages):
# spread over the cluster when the scan yields too few splits.
SPREAD_TABLES = {"documents", "pages", "conversations", "part", "lineitem", "orders", "embeddings"}
# Key to hash by when spreading (aggregates per that key then need no exchange).
SPREAD_KEYS = {"documents": ["doc_id"], "lineitem": ["l_orderkey"], "orders": ["o_orderkey"]}


def table_path(sf_dir: str, name: str) -> str:
    p = os.path.join(sf_dir, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in sf_dir else os.path.join(sf_dir, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = read_table(self.spark, self.sf_dir, name)
            if name in SPREAD_TABLES:
                from quarry.session import spread
                df = spread(df, keys=SPREAD_KEYS.get(name))
            return df
        raise AttributeError(name)

    def parts_of(self, name: str, rows: int) -> int:
        """In how many partitions the table lies with about ``rows`` rows in each, at least one a core (Parquet counts from its footers)."""
        n = read_table(self.spark, self.sf_dir, name).count()
        return max(self.spark.sparkContext.defaultParallelism, -(-n // rows))

    def colocated(self, name: str, parts: int | None = None) -> DataFrame:
        """The table hash partitioned by its key, however many splits its scan has.

        For queries that explode a row into many and group them by that key: the rows are
        moved once as they are, and not again, many times as large, after the explode.
        With ``parts`` there are as many partitions, which nothing merges, so that what a
        task explodes stays of one size (:meth:`parts_of`).
        """
        if parts:
            return read_table(self.spark, self.sf_dir, name).repartition(parts, *SPREAD_KEYS[name])
        df = getattr(self, name)
        scan = df._jdf.queryExecution().executedPlan().getClass().getSimpleName() != "AdaptiveSparkPlanExec"
        return df.repartition(*SPREAD_KEYS[name]) if scan else df
