"""op4: lines of all documents that match an earlier line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.common import table
from jobsift.llm.linededup import removed_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
