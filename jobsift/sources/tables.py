"""Readers for the input tables.

Every reader returns a lazy DataFrame; callers select the columns they need
so Catalyst prunes the parquet scan (``ReadSchema``) and pushes filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Row id of each input table: the hash key used when a table has to be
# spread over more tasks.
ID_COLUMNS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
              "conversations": "conv_id", "labels": "doc_id", "benchmark": "item_id",
              "events": "event_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table."""
    return spark.read.parquet(table_path(sf_dir, name))


SPREAD_BELOW_BYTES = 128 * 1024 * 1024  # one input split


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the bench and fixtures.  One that is stored in less than one
    split (the test tables are single files with one row group) would do its
    per-row text work in one task, so its rows are hash-spread by id; anything
    larger is read as it is stored."""
    df = read_table(spark, sf_dir, name)
    key = ID_COLUMNS.get(name)
    if key and table_bytes(df) < SPREAD_BELOW_BYTES:
        df = df.repartition(default_parallelism(spark), key)
    return df


def table_bytes(df: DataFrame) -> int:
    """Size of the scanned files as the optimizer sees it (no job, no paths)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return SPREAD_BELOW_BYTES


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to the session (falls back to the shuffle partition
    setting where no SparkContext is exposed, e.g. Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
