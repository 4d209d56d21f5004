"""op5: quality of every document, learned from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import classifier
from jobsift.llm.common import crc_fold, table

FOLDS = 5
CUT = 0.3


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), FOLDS) != 0)
    model = classifier.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return classifier.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
