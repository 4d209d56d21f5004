"""Queries with the dictionary as a table: hits, keyword classes, skill overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.operators import overlap as OV
from jobsift.operators import termtable as TT
from jobsift.plans import q_classify
from jobsift.plans.catalog import register
from jobsift.plans.q_skills import STOP_WORDS_FX
from jobsift.plans.sqlkit import WORD_CLASS, build, sql_str, sround
from jobsift.sources.fixtures import cvs_fx, jobs_fx, terms_fx
from jobsift.sources.tables import read_test_table

MIN_SCORE = 60


def q_skill_pairs_table(spark, sf):
    """Every document against a dictionary derived from two other tables."""
    docs = read_test_table(spark, sf, "documents")
    return TT.hit_rows(docs, ["doc_id"], "text", terms_fx(spark, sf)).withColumnRenamed("entry", "skill")


def _hits_cte(name: str, table: str, key: str, text: str) -> tuple[str, ...]:
    """(key, skill) of all entries of one run, or of three beginning with a word."""
    word = WORD_CLASS.replace("[^", "[")
    return (
        f"{name}_runs AS (SELECT {key}, regexp_extract_all(lower({text}), '{word}+|{WORD_CLASS}+') AS r FROM {table} "
        f"WHERE {text} IS NOT NULL)",
        f"""{name} AS (
  SELECT DISTINCT {key}, term AS skill FROM (
    SELECT {key}, unnest(r) AS g FROM {name}_runs
    UNION ALL
    SELECT {key}, unnest([r[i] || r[i + 1] || r[i + 2] FOR i IN range(1, len(r) - 1)
                          IF regexp_matches(r[i], '^{word}')]) AS g FROM {name}_runs)
  JOIN terms ON g = term)""")


def o_skill_pairs_table():
    return build("SELECT doc_id, skill FROM hits", ("terms",), _hits_cte("hits", "documents", "doc_id", "text"))


def q_skill_overlap(spark, sf):
    """Pairs of a CV and a job of its category (any, for bypass CVs) of whose
    required skills the CV has at least 60%; the dictionary is a table."""
    terms = terms_fx(spark, sf)
    sides = []
    for df, key, text in ((cvs_fx(spark, sf), "cv_id", "text"), (jobs_fx(spark, sf), "seq", "description_text")):
        sets = TT.skill_sets(df, key, text, terms)
        sides.append(df.select(key, "main_category").join(sets, key))
    return OV.overlap_pairs(*sides, min_score=MIN_SCORE)


def o_skill_overlap():
    ctes = (*_hits_cte("ch", "cvs", "cv_id", "text"), *_hits_cte("jh", "jobs", "seq", "description_text"),
            "c AS (SELECT cv_id, any_value(main_category) AS main, list(skill) AS s FROM ch JOIN cvs USING (cv_id) GROUP BY cv_id)",
            "j AS (SELECT seq, any_value(main_category) AS main, list(skill) AS s FROM jh JOIN jobs USING (seq) GROUP BY seq)",
            f"""p AS (
  SELECT cv_id, seq, len(list_intersect(j.s, c.s)) AS m, len(j.s) AS r
  FROM c JOIN j ON c.main = j.main AND c.main <> '{D.BYPASS_CATEGORY}'
  UNION ALL
  SELECT cv_id, seq, len(list_intersect(j.s, c.s)), len(j.s) FROM c, j WHERE c.main = '{D.BYPASS_CATEGORY}')""")
    return build(f"""SELECT cv_id, seq, m::INTEGER AS n_matched, r::INTEGER AS n_required,
       {sround('m::DOUBLE / r::DOUBLE * 100.0::DOUBLE')} AS score_skills
FROM p WHERE m * 100 >= {MIN_SCORE} * r""", ("terms", "cvs", "jobs"), ctes)


def q_category_keywords_table(spark, sf):
    """The keyword classifier with its keywords as a table."""
    jobs = jobs_fx(spark, sf).select("seq", "job_title", "description_text")
    got = TT.category_keywords(jobs, "seq", "job_title", "description_text", TT.keyword_table(spark))
    return jobs.select("seq", "job_title").join(got, "seq").select("seq", "job_title", "main_category", "sub_category")


LEMMA_POS = ["NOUN", "VERB", "ADJ", "PROPN"]


def lemmas_fx(spark, sf):
    """A lemma table made from the documents: tokens that end in ``s`` lose it;
    their part of speech goes by their length."""
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}s"), 0))
    t = read_test_table(spark, sf, "documents").select(tokens.alias("surface")).distinct()
    pos = F.get(F.array(*map(F.lit, LEMMA_POS)), F.length("surface") % 4)
    return t.select("surface", F.expr("substring(surface, 1, length(surface) - 1)").alias("lemma"), pos.alias("pos"))


def q_lemma_keywords(spark, sf):
    docs = read_test_table(spark, sf, "documents")
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS_FX], "word string")
    got = TT.lemma_keywords(docs, "doc_id", "text", lemmas_fx(spark, sf), stop)
    return got.select("doc_id", F.size("keywords").cast("bigint").alias("n_keywords"), "keywords")


def o_lemma_keywords():
    word = WORD_CLASS.replace("[^", "[")
    stop = ", ".join(sql_str(w) for w in STOP_WORDS_FX)
    pos = ", ".join(map(sql_str, LEMMA_POS))
    return build(f"""SELECT d.doc_id, coalesce(len(k.keywords), 0) AS n_keywords, coalesce(k.keywords, []::VARCHAR[]) AS keywords
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""", (), (
        f"tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{word}+')) AS surface FROM documents)",
        f"""lem AS (
  SELECT surface, substr(surface, 1, length(surface) - 1) AS lemma, ([{pos}])[length(surface) % 4 + 1] AS pos
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}s')) AS surface FROM documents))""",
        f"""k AS (
  SELECT doc_id, list_sort(list(DISTINCT lemma)) AS keywords FROM (
    SELECT doc_id, coalesce(lem.lemma, tok.surface) AS lemma FROM tok LEFT JOIN lem ON lem.surface = tok.surface
    WHERE lem.surface IS NULL OR lem.pos IN ({", ".join(map(sql_str, TT.KEPT_POS))}))
  WHERE length(lemma) >= 3 AND lemma NOT IN ({stop}) GROUP BY doc_id)"""))


register("lemma_keywords", o_lemma_keywords)(q_lemma_keywords)
register("skill_pairs_table", o_skill_pairs_table)(q_skill_pairs_table)
register("skill_overlap", o_skill_overlap)(q_skill_overlap)
register("category_keywords_table", q_classify.o_category_keywords)(q_category_keywords_table)
