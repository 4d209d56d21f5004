"""Text vectors for the semantic score when no embedding is supplied.

The original encodes lower(description) with a sentence-embedding model on
one machine.  Here the encoder is a Spark ML pipeline (regex tokens ->
hashed term counts -> IDF -> L2 normalise) fitted once on the job
descriptions and applied to jobs and CVs alike; the IDF fit is one
distributed aggregation.  Vectors come out as ``array<float>`` so they plug
into the same cosine as supplied embeddings.  Any other encoder can be
plugged in the same way as an Arrow ``pandas_udf`` returning array<float>.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_text_encoder(df: DataFrame, text_col: str, dims: int = 256) -> PipelineModel:
    src = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dims),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="__vec", p=2.0),
    ])
    return pipe.fit(src)


def encode(model: PipelineModel, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
    """Add ``out_col`` (array<float>, unit norm; a text without tokens gives
    a zero vector, which scores 0)."""
    src = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    out = model.transform(src)
    return (out.withColumn(out_col, vector_to_array("__vec", "float32"))
               .drop("__text", "__tok", "__tf", "__tfidf", "__vec"))
