"""op12: the five best rows of every fiftieth vector, by integer inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.common import table
from jobsift.llm.vafile import scaled, top_k

EVERY, K = 50, 5


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.select("vec_id", scaled(F.col("embedding")).alias("vec"),
                             (F.col("vec_id") % EVERY == 0).alias("is_query")), K)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([y FOR y IN embedding IF y IS NULL OR isnan(y) OR isinf(y)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % {EVERY} = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""

QUERIES = {"op12_exact_topk": op12_exact_topk}
ORACLES = {"op12_exact_topk": ORACLE}
