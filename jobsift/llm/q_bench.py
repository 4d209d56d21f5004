"""op8: every document against every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.bench import find_leaks
from jobsift.llm.common import table


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "similarity", "start", "n_windows")


QUERIES = {"op8_decontamination": op8_decontamination}
