"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

quality rules -> line dedup -> MinHash near-dedup -> benchmark
decontamination -> mixing.  Every stage but the last returns the columns of
documents; the last returns the documents that the mix takes words from or
not, with their copies.

Defined cases: those of the operators; documents that the quality rules
reject, that lose all words to line dedup, that are not their class's first,
or that hold a benchmark passage are gone after their stage; repeated rows
(same doc_id and text) are one document from line dedup on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.bench import decontaminate
from jobsift.llm.common import table, with_scratch
from jobsift.llm.linededup import drop_matched_lines
from jobsift.llm.minhash import drop_near_duplicates
from jobsift.llm.mixing import mix
from jobsift.llm.q_mixing import cycled_weights
from jobsift.llm.quality import clean_documents
from jobsift.session import checkpoint_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_scratch(lambda: clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_scratch(lambda: drop_matched_lines(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_scratch(lambda: drop_near_duplicates(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_scratch(lambda: decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_scratch(lambda: mix(docs, cycled_weights))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

# Not expressible: the similarity joins have no SQL that ends on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)  # the stage's own tables go with ``out``
        docs = spark.read.parquet(path)
    return docs
