"""op9: bytes of all documents covered by repeated 200-byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.common import table
from jobsift.llm.suffix import remove_repeats


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
