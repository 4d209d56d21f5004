"""op2: all documents mixed to weights 3, 1, 2 by source, 150 % of all words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.common import table
from jobsift.llm.mixing import mix

CYCLE = (3, 1, 2)


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Weights 3, 1, 2, repeating over the sources by code point, null last
    (one row per source)."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (at % len(CYCLE) + 1).cast("int")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), cycled_weights)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op2_mixing": op2_mixing}
