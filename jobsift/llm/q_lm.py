"""op10: log probabilities of all texts, learned from nine tenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import lm
from jobsift.llm.common import crc_fold, table

FOLDS = 10


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), FOLDS) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return lm.score_texts(docs, docs.where("not held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scores": op10_lm_scores}
