"""op11: the best 2,000 collocations of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.llm.common import table
from jobsift.llm.phrases import collocations

TOP = 2000


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), TOP)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (
  SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF w <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, w[i:i + k - 1] AS g
  FROM split, range(1, 5) AS ks(k), unnest(range(1, len(w) - k + 2)) AS t(i)
  WHERE len(w) >= k),
f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
parts AS (SELECT lang, g, a, k, g[:k] AS lg, g[k + 1:] AS rg FROM cand, unnest(range(1, len(g))) AS t(k)),
cuts AS (
  SELECT p.lang, p.g, p.a, p.k, l.f AS l, r.f AS r, (2000000 * p.a) // (l.f + r.f) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.g = p.lg JOIN f r ON r.lang = p.lang AND r.g = p.rg),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM cand, range(2, 4) AS ms(m), unnest(range(1, len(g) - m + 2)) AS t(i)
  WHERE m < len(g) GROUP BY ALL),
kept AS (
  SELECT o.lang, array_to_string(o.g, ' ') AS phrase, a, l, r, score
  FROM lowest o LEFT JOIN inside i ON o.lang = i.lang AND o.g = i.g
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept k JOIN sizes s ON k.lang = s.lang
QUALIFY rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
