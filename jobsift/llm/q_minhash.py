"""op6: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.common import table
from jobsift.llm.minhash import near_classes


def op6_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


QUERIES = {"op6_minhash_classes": op6_minhash_classes}
