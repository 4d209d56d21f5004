"""Skill queries: dictionary hits per job, live (url, skill) pairs, token
keywords and token-mode skills, missing skills of the top matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.operators import dedup as DD
from jobsift.operators import skills as SK
from jobsift.plans.catalog import register
from jobsift.plans.sqlkit import WORD_CLASS, build, hit_list_sql, sql_str
from jobsift.sources.fixtures import SKILLS_FX, jobs_fx
from jobsift.sources.tables import read_test_table

# Stop words for the token keyword queries (a parameter of the operator).
STOP_WORDS_FX = ["the", "and", "with", "from", "for", "that", "this", "les", "des", "une",
                 "der", "die", "und", "los", "las", "que"]


def q_skill_pairs(spark, sf):
    return SK.skill_pairs(jobs_fx(spark, sf), ["seq", "url"], "description_text", SKILLS_FX)


def o_skill_pairs():
    return build(f"""SELECT seq, url, unnest({hit_list_sql('description_text', SKILLS_FX, True)}) AS skill
FROM jobs""", ("jobs",))


# Entries of every kind that occur in the prose: plain, case variants, several
# words, inner punctuation, a sign at an end (like ``c++``).
MIXED_TERMS = ["the", "The", "THE", "of the", "of The", "that, the", "der.", "*** the", "&&& the", "le ou", "que",
               "in the", "$$", "!! der", "is|", "and, with", "über", "Éou"]


def q_skill_pairs_mixed(spark, sf):
    """Every kind of entry, the dictionary given as a table."""
    terms = spark.createDataFrame([(t,) for t in MIXED_TERMS], "term string")
    docs = read_test_table(spark, sf, "documents").select("doc_id", "text")
    return SK.skill_pairs(docs, ["doc_id"], "text", terms)


def o_skill_pairs_mixed():
    return f"SELECT doc_id, unnest({hit_list_sql('text', MIXED_TERMS, True)}) AS skill FROM documents"


def q_skills_in_jobs(spark, sf):
    jobs = jobs_fx(spark, sf)
    pairs = SK.skill_pairs(jobs, ["url"], "description_text", SKILLS_FX)
    return SK.live_skill_pairs(pairs, DD.dedup_latest(jobs))


def o_skills_in_jobs():
    from jobsift.plans.q_dedup import LATEST_SQL
    return build(f"""SELECT DISTINCT url, skill FROM (
  SELECT url, unnest({hit_list_sql('description_text', SKILLS_FX, True)}) AS skill FROM jobs)
WHERE url IN (SELECT url FROM live)""", ("jobs",), (f"live AS ({LATEST_SQL.format(t='jobs')})",))


def _keywords(spark, sf):
    docs = read_test_table(spark, sf, "documents").select("doc_id", "text")
    return SK.token_keywords(docs, "text", STOP_WORDS_FX)


def q_keywords(spark, sf):
    return _keywords(spark, sf).select("doc_id", F.size("keywords").cast("bigint").alias("n_keywords"),
                                       "keywords")


def _kw_sql() -> str:
    stop = "[" + ", ".join(sql_str(w) for w in sorted(set(STOP_WORDS_FX))) + "]::VARCHAR[]"
    word = WORD_CLASS.replace("[^", "[")
    return f"""kw AS (
  SELECT doc_id,
         coalesce(list_sort(list_distinct(list_filter(
             regexp_extract_all(lower(text), '{word}+'),
             lambda t: length(t) >= 3 AND NOT list_contains({stop}, t)))), []::VARCHAR[]) AS keywords
  FROM documents)"""


def o_keywords():
    return build("SELECT doc_id, len(keywords) AS n_keywords, keywords FROM kw", (), (_kw_sql(),))


def q_token_skills(spark, sf):
    kw = _keywords(spark, sf)
    return SK.token_skills(kw, "keywords", SKILLS_FX).select("doc_id", "token_skills")


def o_token_skills():
    lit = "[" + ", ".join(sql_str(t) for t in SKILLS_FX) + "]::VARCHAR[]"
    return build(f"SELECT doc_id, list_sort(list_distinct(list_intersect(keywords, {lit}))) AS token_skills "
                 "FROM kw", (), (_kw_sql(),))


def q_missing_skills(spark, sf):
    from jobsift.plans.q_match import q_match_topk
    top = q_match_topk(spark, sf)
    return top.select("cv_id", "seq", "rank", "missing_skills",
                      F.array_join(F.slice("missing_skills", 1, 5), ", ").alias("missing_shown"))


def o_missing_skills():
    from jobsift.plans import q_match
    return build("SELECT cv_id, seq, rank, missing_skills, "
                 "array_to_string(missing_skills[1:5], ', ') AS missing_shown FROM rec",
                 ("jobs", "cvs"), q_match._top_ctes())


register("skill_pairs_mixed", o_skill_pairs_mixed)(q_skill_pairs_mixed)
register("skill_pairs", o_skill_pairs)(q_skill_pairs)
register("skills_in_jobs", o_skills_in_jobs)(q_skills_in_jobs)
register("keywords", o_keywords)(q_keywords)
register("token_skills", o_token_skills)(q_token_skills)
register("missing_skills", o_missing_skills)(q_missing_skills)
