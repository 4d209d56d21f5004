"""Matching queries: N CVs x M jobs, top 50 per CV, cards, score parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions import scores as S
from jobsift.operators import blockmatch as B
from jobsift.operators import match as M
from jobsift.operators import pairstats as PS
from jobsift.operators.skills import with_skills
from jobsift.plans.catalog import register
from jobsift.plans.sqlkit import build, dot_sql, hits_sql, level_idx_sql, norm_sql, sround
from jobsift.sources.fixtures import (FIXTURE_SQL, SKILLS_FX, cvs_fx, jobs_fx, sql_widened,
                                      widened)

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def scored_inputs(spark, sf):
    """(cvs, jobs) with skill arrays from the fixture dictionary."""
    jobs = with_skills(jobs_fx(spark, sf), "description_text", SKILLS_FX)
    cvs = with_skills(cvs_fx(spark, sf), "text", SKILLS_FX)
    return cvs, jobs


def q_match_topk(spark, sf):
    cvs, jobs = scored_inputs(spark, sf)
    return M.match_topk(cvs, jobs, SKILLS_FX)


def q_match_topk_blocks(spark, sf):
    """The same result by blocks, with bounds (the form for large sides)."""
    return B.match_topk(*scored_inputs(spark, sf))


def q_match_topk_wide(spark, sf):
    """By blocks with vectors of 384 dimensions."""
    cvs, jobs = scored_inputs(spark, sf)
    return B.match_topk(cvs.withColumn("vector", widened(F.col("vector"))),
                        jobs.withColumn("bert_vector", widened(F.col("bert_vector"))))


def q_match_work(spark, sf):
    """Candidate pairs, and pairs whose vectors were compared, of the ten best by blocks."""
    return B.match_work(*scored_inputs(spark, sf), k=10)


def q_top50_single_cv(spark, sf):
    cvs, jobs = scored_inputs(spark, sf)
    first = cvs.where(F.col("cv_id") == cvs.select(F.min("cv_id")).scalar())
    return M.single_cv_top(first, jobs, SKILLS_FX)


def q_match_with_bypass(spark, sf):
    """The bypass flow: CVs whose main category is 'Other' are scored
    against every job (not only one category)."""
    cvs, jobs = scored_inputs(spark, sf)
    return M.match_topk(cvs.where(F.col("main_category") == D.BYPASS_CATEGORY), jobs, SKILLS_FX)


def q_match_cards(spark, sf):
    return M.match_cards(q_match_topk(spark, sf))


def q_category_score(spark, sf):
    return (M.category_level_counts(cvs_fx(spark, sf), jobs_fx(spark, sf))
            .groupBy("score_category").agg(F.sum("pairs").alias("pairs")))


def q_seniority_score(spark, sf):
    return (M.category_level_counts(cvs_fx(spark, sf), jobs_fx(spark, sf))
            .groupBy("cv_level_idx", "job_level_idx", "score_seniority").agg(F.sum("pairs").alias("pairs")))


def q_skill_score(spark, sf):
    matched, required = F.col("n_matched"), F.col("n_required")
    return (PS.skill_counts(*scored_inputs(spark, sf)).groupBy("n_matched", "n_required").agg(F.sum("pairs").alias("pairs"))
            .groupBy(F.round(S.skill_score(matched, required), 1).alias("score_skills"))
            .agg(F.sum("pairs").alias("pairs"), F.sum(matched * F.col("pairs")).alias("matched"),
                 F.sum((required - matched) * F.col("pairs")).alias("missing")))


def q_semantic_score(spark, sf):
    return (PS.semantic_extremes(*scored_inputs(spark, sf)).groupBy("cv_id")
            .agg(F.sum("pairs").alias("pairs"),
                 F.round(F.max("most"), 1).alias("max_semantic"),
                 F.round(F.min("least"), 1).alias("min_semantic")))


def q_match_score(spark, sf):
    bucket = (F.floor(F.col("match_score") / 10) * 10).cast("bigint")
    return (PS.score_counts(*scored_inputs(spark, sf)).groupBy(bucket.alias("bucket"))
            .agg(F.sum("pairs").alias("pairs"), F.max("match_score").alias("max_score")))


def q_score_band(spark, sf):
    top = q_match_topk(spark, sf)
    return (top.groupBy(S.score_band(F.col("match_score")).alias("band"))
            .agg(F.count(F.lit(1)).alias("results")))


# ---------------------------------------------------------------------------
# Oracle side
# ---------------------------------------------------------------------------

def _pairs_ctes() -> tuple[str, ...]:
    return (
        f"job_sk AS (SELECT seq, {hits_sql('description_text', SKILLS_FX)} AS skills FROM jobs)",
        f"cv_sk AS (SELECT cv_id, {hits_sql('text', SKILLS_FX)} AS skills FROM cvs)",
        f"""cv AS (
  SELECT c.cv_id,
         CASE WHEN c.main_category = '{D.BYPASS_CATEGORY}' THEN '*' ELSE '=' || c.main_category END AS jkey,
         c.main_category AS cv_main, c.sub_category AS cv_sub,
         {level_idx_sql('c.level', True)} AS cv_level_idx,
         c.vector AS cv_vec, {norm_sql('c.vector')} AS cv_norm, k.skills AS cv_skills
  FROM cvs c JOIN cv_sk k ON k.cv_id = c.cv_id)""",
        f"""job AS (
  SELECT j.seq, j.url, unnest(['=' || j.main_category, '*']) AS jkey,
         j.main_category AS job_main, j.sub_category AS job_sub,
         {level_idx_sql('j.level', False)} AS job_level_idx,
         j.bert_vector AS job_vec, {norm_sql('j.bert_vector')} AS job_norm, k.skills AS job_skills
  FROM jobs j JOIN job_sk k ON k.seq = j.seq)""",
        f"""raw AS (
  SELECT cv.cv_id, job.seq, job.url, cv.cv_level_idx, job.job_level_idx,
         list_sort(list_distinct(list_intersect(cv.cv_skills, job.job_skills))) AS matched_skills,
         list_sort(list_distinct(list_filter(job.job_skills, lambda s: NOT list_contains(cv.cv_skills, s)))) AS missing_skills,
         CASE WHEN cv.cv_main IS DISTINCT FROM job.job_main THEN 0.0::DOUBLE
              WHEN cv.cv_sub IS DISTINCT FROM job.job_sub THEN 75.0::DOUBLE
              ELSE 100.0::DOUBLE END AS cat,
         len(job.job_skills) AS n_req,
         cv.cv_level_idx - job.job_level_idx AS diff,
         CASE WHEN cv.cv_vec IS NULL OR job.job_vec IS NULL OR len(cv.cv_vec) <> len(job.job_vec)
                   OR cv.cv_norm = 0 OR job.job_norm = 0 THEN 0.0::DOUBLE
              ELSE {dot_sql('cv.cv_vec', 'job.job_vec')} / (cv.cv_norm * job.job_norm) * 100.0::DOUBLE
         END AS sem
  FROM cv JOIN job ON cv.jkey = job.jkey)""",
        """comp AS (
  SELECT *,
         CASE WHEN n_req = 0 THEN 0.0::DOUBLE
              ELSE len(matched_skills)::DOUBLE / n_req::DOUBLE * 100.0::DOUBLE END AS skill,
         CASE WHEN diff = 0 THEN 100.0::DOUBLE WHEN diff = -1 THEN 50.0::DOUBLE
              WHEN diff < -1 THEN 0.0::DOUBLE WHEN diff = 1 THEN 80.0::DOUBLE
              ELSE 60.0::DOUBLE END AS sen
  FROM raw)""",
        f"""pairs AS (
  SELECT cv_id, seq, url, cv_level_idx, job_level_idx, matched_skills, missing_skills,
         CASE WHEN {sround('tot')} > 0 THEN {sround('tot')} ELSE 0.0::DOUBLE END AS match_score,
         {sround('cat')} AS score_category, {sround('skill')} AS score_skills,
         {sround('sen')} AS score_seniority, {sround('sem')} AS score_semantic
  FROM (SELECT *, 0.25::DOUBLE * cat + 0.30::DOUBLE * skill + 0.25::DOUBLE * sen
                  + sem * 0.20::DOUBLE AS tot FROM comp))""",
    )


def _top_ctes(cv_filter: str = "") -> tuple[str, ...]:
    return _pairs_ctes() + (
        f"""top AS (
  SELECT * FROM (
    SELECT p.*, row_number() OVER (PARTITION BY cv_id ORDER BY match_score DESC, url, seq) AS rank
    FROM pairs p {cv_filter}) WHERE rank <= {D.TOP_K})""",
        """rec AS (
  SELECT t.cv_id, t.rank, t.seq, j.job_title, j.company_name AS company, j.url,
         j.search_date AS date, j.description_text AS description, t.match_score,
         t.score_category, t.score_skills, t.score_seniority, t.score_semantic,
         t.matched_skills, t.missing_skills, j.location, j.search_date, j.main_category
  FROM top t JOIN jobs j ON j.seq = t.seq)""",
    )


def o_match_topk():
    return build("SELECT * FROM rec", ("jobs", "cvs"), _top_ctes())


def o_match_topk_wide():
    wide = tuple(f"{name} AS (SELECT * REPLACE ({sql_widened(col)} AS {col}) FROM ({FIXTURE_SQL[name]()}))"
                 for name, col in (("jobs", "bert_vector"), ("cvs", "vector")))
    return build("SELECT * FROM rec", (), wide + _top_ctes())


def o_top50_single_cv():
    return build("SELECT * FROM rec", ("jobs", "cvs"),
                 _top_ctes("WHERE cv_id = (SELECT min(cv_id) FROM cvs)"))


def o_match_with_bypass():
    return build("SELECT * FROM rec", ("jobs", "cvs"),
                 _top_ctes(f"WHERE cv_id IN (SELECT cv_id FROM cvs WHERE main_category = '{D.BYPASS_CATEGORY}')"))


def o_match_cards():
    final = f"""
SELECT cv_id, rank, seq, url, job_title, company, location, search_date, main_category,
       CAST(trunc(match_score) AS INTEGER) AS score_pct,
       CASE WHEN match_score > {D.BAND_GREEN_ABOVE} THEN 'green'
            WHEN match_score > {D.BAND_ORANGE_ABOVE} THEN 'orange' ELSE 'red' END AS band,
       'Category: ' || CAST(score_category AS VARCHAR) || '% | Skills: ' || CAST(score_skills AS VARCHAR)
         || '% | Seniority: ' || CAST(score_seniority AS VARCHAR) || '% | Semantic: '
         || CAST(score_semantic AS VARCHAR) || '%' AS breakdown,
       array_to_string(missing_skills[1:{D.MISSING_SHOWN}], ', ') AS missing_shown,
       substring(coalesce(description, ''), 1, {D.PREVIEW_CHARS}) AS preview,
       CASE WHEN length(coalesce(description, '')) > {D.PREVIEW_CHARS}
            THEN substring(description, {D.PREVIEW_CHARS + 1}) ELSE '' END AS rest
FROM rec"""
    return build(final, ("jobs", "cvs"), _top_ctes())


def o_category_score():
    return build("SELECT score_category, count(*) AS pairs FROM pairs GROUP BY 1",
                 ("jobs", "cvs"), _pairs_ctes())


def o_seniority_score():
    return build("SELECT cv_level_idx, job_level_idx, score_seniority, count(*) AS pairs "
                 "FROM pairs GROUP BY 1, 2, 3", ("jobs", "cvs"), _pairs_ctes())


def o_skill_score():
    return build("SELECT score_skills, count(*) AS pairs, CAST(sum(len(matched_skills)) AS BIGINT) AS matched, "
                 "CAST(sum(len(missing_skills)) AS BIGINT) AS missing FROM pairs GROUP BY 1",
                 ("jobs", "cvs"), _pairs_ctes())


def o_semantic_score():
    return build("SELECT cv_id, count(*) AS pairs, max(score_semantic) AS max_semantic, "
                 "min(score_semantic) AS min_semantic FROM pairs GROUP BY 1",
                 ("jobs", "cvs"), _pairs_ctes())


def o_match_score():
    return build("SELECT CAST(floor(match_score / 10) * 10 AS BIGINT) AS bucket, count(*) AS pairs, "
                 "max(match_score) AS max_score FROM pairs GROUP BY 1",
                 ("jobs", "cvs"), _pairs_ctes())


def o_score_band():
    return build(f"""SELECT CASE WHEN match_score > {D.BAND_GREEN_ABOVE} THEN 'green'
                WHEN match_score > {D.BAND_ORANGE_ABOVE} THEN 'orange' ELSE 'red' END AS band,
           count(*) AS results FROM rec GROUP BY 1""", ("jobs", "cvs"), _top_ctes())


register("match_topk", o_match_topk)(q_match_topk)
register("match_topk_blocks", o_match_topk)(q_match_topk_blocks)
register("match_topk_wide", o_match_topk_wide)(q_match_topk_wide)
register("match_work")(q_match_work)
register("top50_single_cv", o_top50_single_cv)(q_top50_single_cv)
register("match_with_bypass", o_match_with_bypass)(q_match_with_bypass)
register("match_cards", o_match_cards)(q_match_cards)
register("category_score", o_category_score)(q_category_score)
register("seniority_score", o_seniority_score)(q_seniority_score)
register("skill_score", o_skill_score)(q_skill_score)
register("semantic_score", o_semantic_score)(q_semantic_score)
register("match_score", o_match_score)(q_match_score)
register("score_band", o_score_band)(q_score_band)
