"""op7: conversations as mail, each reply quoting what it answers, linked back.

The table's turns hold no quotes, so the mail form is derived from them: turn
t answers t - 1 (t - 2 for every third turn), quotes it whole, and above that,
one level deeper, the whole turn before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.chat import link_quotes
from jobsift.llm.common import table


def as_mail(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with quotes of one and two levels."""
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    lines = F.split("said", "\n")
    first = said.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"),
                        F.transform(lines, lambda x: F.concat(F.lit("> "), x)).alias("q1"),
                        F.transform(lines, lambda x: F.concat(F.lit(">> "), x)).alias("q2"))
    back = F.when(F.col("turn") % 3 == 2, 2).otherwise(1)
    reply = conversations.select("conv_id", "turn", "role", "text", (F.col("turn") - back).alias("_to"))
    one = first.select(F.col("_c").alias("_c1"), F.col("_t").alias("_t1"), "q1")
    two = first.select(F.col("_c").alias("_c2"), F.col("_t").alias("_t2"), "q2")
    joined = (reply.join(one, (F.col("conv_id") == F.col("_c1")) & (F.col("_to") == F.col("_t1")), "left")
              .join(two, (F.col("conv_id") == F.col("_c2")) & (F.col("_to") - 1 == F.col("_t2")), "left"))
    return joined.select("conv_id", "turn", "role", F.concat_ws(
        "\n", F.array_join("q2", "\n"), F.array_join("q1", "\n"), "text").alias("text"))


def op7_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(as_mail(table(spark, sf_dir, "conversations")))
    return out.withColumnRenamed("conv", "conv_id")


ORACLE = """
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
firsts AS (
  SELECT conv_id, turn, list_transform(string_split(said, chr(10)), lambda x: '> ' || x) AS q1,
         list_transform(string_split(said, chr(10)), lambda x: '>> ' || x) AS q2 FROM said),
mail AS (
  SELECT c.conv_id, c.turn, concat_ws(chr(10), array_to_string(b.q2, chr(10)), array_to_string(a.q1, chr(10)), c.text) AS text
  FROM conversations c
  LEFT JOIN firsts a ON a.conv_id = c.conv_id AND a.turn = c.turn - CASE WHEN c.turn % 3 = 2 THEN 2 ELSE 1 END
  LEFT JOIN firsts b ON b.conv_id = c.conv_id AND b.turn = c.turn - CASE WHEN c.turn % 3 = 2 THEN 2 ELSE 1 END - 1),
split AS (
  SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM mail),
marked AS (SELECT *, regexp_extract(line, '^((?:[ \\t]*>)*)', 1) AS marks FROM split),
lines AS (
  SELECT conv_id, turn, pos, length(marks) - length(replace(marks, '>', '')) AS level,
         CASE WHEN marks LIKE '%>%' THEN substr(line, length(marks) + 1) ELSE line END AS line FROM marked),
normal AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS norm FROM lines),
bodies AS (
  SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '') AS body
  FROM normal GROUP BY ALL),
quoted AS (SELECT DISTINCT conv_id, turn, level, norm FROM normal WHERE level > 0 AND norm <> ''),
origins AS (SELECT conv_id, norm, min(turn) AS origin FROM normal WHERE level = 0 AND norm <> '' GROUP BY ALL),
linked AS (
  SELECT q.*, CASE WHEN o.origin < q.turn THEN o.origin END AS origin
  FROM quoted q LEFT JOIN origins o USING (conv_id, norm)),
counts AS (SELECT conv_id, turn, count(*) AS n_quotes, max(level) AS max_level, count(origin) AS n_linked FROM linked GROUP BY ALL),
votes AS (SELECT conv_id, turn, origin, count(*) AS v FROM linked WHERE level = 1 AND origin IS NOT NULL GROUP BY ALL),
parents AS (SELECT conv_id, turn, origin AS parent_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, origin DESC) = 1),
nodes AS (SELECT b.*, p.parent_turn FROM bodies b LEFT JOIN parents p USING (conv_id, turn)),
walk AS (
  SELECT conv_id, turn, turn AS thread_root, 0 AS depth FROM nodes WHERE parent_turn IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, w.thread_root, w.depth + 1 FROM nodes n JOIN walk w ON n.conv_id = w.conv_id AND n.parent_turn = w.turn)
SELECT n.conv_id, n.turn, n.body, coalesce(c.n_quotes, 0) AS n_quotes, coalesce(c.max_level, 0) AS max_level,
       coalesce(c.n_linked, 0) AS n_linked, n.parent_turn, w.thread_root, CAST(w.depth AS BIGINT) AS depth
FROM nodes n JOIN walk w USING (conv_id, turn) LEFT JOIN counts c USING (conv_id, turn)"""

QUERIES = {"op7_chat_quotes": op7_chat_quotes}
ORACLES = {"op7_chat_quotes": ORACLE}
