"""op3: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.common import table
from jobsift.llm.quality import line_verdicts


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words")


QUERIES = {"op3_quality_rules": op3_quality_rules}
