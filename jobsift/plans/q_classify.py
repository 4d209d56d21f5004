"""Classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.operators import classify as C
from jobsift.plans.catalog import register
from jobsift.plans.q_text import requirements_ctes
from jobsift.plans.sqlkit import build, hit_list_sql, sql_str
from jobsift.sources.fixtures import jobs_fx, responses_fx

BLUE_EVERY = 3  # fixture: every third job answered as Blue Collar / Business & Sales


def _blue_jobs(spark, sf):
    j = jobs_fx(spark, sf)
    blue = F.col("seq") % BLUE_EVERY == 0
    return (j.withColumn("sub_category", F.when(blue, F.lit(D.BLUE_COLLAR_SUB)).otherwise(F.col("sub_category")))
             .withColumn("main_category", F.when(blue, F.lit("Business & Sales")).otherwise(F.col("main_category"))))


BLUE_JOBS_SQL = f"""blue AS (
  SELECT * REPLACE (
    CASE WHEN seq % {BLUE_EVERY} = 0 THEN '{D.BLUE_COLLAR_SUB}' ELSE sub_category END AS sub_category,
    CASE WHEN seq % {BLUE_EVERY} = 0 THEN 'Business & Sales' ELSE main_category END AS main_category)
  FROM jobs)"""


def _masks_sql(t: str = "lower(coalesce(job_title, ''))") -> dict[str, str]:
    def rx(p):
        return f"regexp_matches({t}, {sql_str(p)})"
    lead = f"({rx(D.LEAD_PATTERNS[0])} OR {rx(D.LEAD_PATTERNS[1])})"
    manager = f"({rx(D.MANAGER_PATTERN)} AND NOT {rx(D.MANAGER_EXCLUDE_PATTERN)})"
    senior = f"({rx(D.SENIOR_PATTERN)} OR {manager})"
    return {"lead": lead, "senior": senior, "intern": rx(D.INTERN_PATTERN),
            "professional": rx(D.PROFESSIONAL_PATTERN)}


def _level_sql(level: str = "level") -> str:
    m = _masks_sql()
    return (f"CASE WHEN {m['lead']} THEN 'lead' WHEN {m['senior']} THEN 'senior' "
            f"WHEN {m['intern']} THEN 'intern' ELSE {level} END")


def _bad_bc_sql() -> str:
    return f"(coalesce(sub_category = '{D.BLUE_COLLAR_SUB}', false) AND {_masks_sql()['professional']})"


# --- title rules -----------------------------------------------------------

def q_level_override(spark, sf):
    j = jobs_fx(spark, sf).select("seq", "job_title", F.col("level").alias("level_before"), "level")
    return C.level_override(j)


def o_level_override():
    return build(f"SELECT seq, job_title, level AS level_before, {_level_sql()} AS level FROM jobs",
                 ("jobs",))


def q_category_override(spark, sf):
    return C.category_override(_blue_jobs(spark, sf)).select(
        "seq", "job_title", "main_category", "sub_category")


def o_category_override():
    bad = _bad_bc_sql()
    return build(f"""SELECT seq, job_title,
  CASE WHEN {bad} THEN 'General' ELSE main_category END AS main_category,
  CASE WHEN {bad} THEN 'Other' ELSE sub_category END AS sub_category FROM blue""",
                 ("jobs",), (BLUE_JOBS_SQL,))


def q_override_metrics(spark, sf):
    return C.override_metrics(_blue_jobs(spark, sf))


def o_override_metrics():
    m = _masks_sql()
    return build(f"""SELECT count(*) FILTER (WHERE {m['lead']}) AS lead_fixed,
  count(*) FILTER (WHERE {m['senior']} AND NOT {m['lead']}) AS senior_fixed,
  count(*) FILTER (WHERE {m['intern']} AND NOT {m['lead']} AND NOT {m['senior']}) AS intern_fixed,
  count(*) FILTER (WHERE {_bad_bc_sql()}) AS blue_collar_fixed,
  count(*) FILTER (WHERE {m['lead']}) + count(*) FILTER (WHERE {m['senior']} AND NOT {m['lead']})
    + count(*) FILTER (WHERE {m['intern']} AND NOT {m['lead']} AND NOT {m['senior']}) AS level_fixed
FROM blue""", ("jobs",), (BLUE_JOBS_SQL,))


# --- merges ----------------------------------------------------------------

MERGE_COLS = ["seq", "url", "job_title", "main_category", "sub_category", "level"]


def q_classify_merge_fanout(spark, sf):
    return C.merge_fanout(jobs_fx(spark, sf), responses_fx(spark, sf)).select(*MERGE_COLS)


def o_classify_merge_fanout():
    return build(f"""SELECT j.seq, j.url, j.job_title,
  coalesce(r.main_category, '{D.JOB_DEFAULT['main_category']}') AS main_category,
  coalesce(r.sub_category, '{D.JOB_DEFAULT['sub_category']}') AS sub_category,
  coalesce(r.level, '{D.JOB_DEFAULT['level']}') AS level
FROM jobs j LEFT JOIN responses r ON r.URL = j.url""", ("jobs", "responses"))


# arg_max over a struct: DuckDB skips NULL arguments, the last answer's
# NULL fields must be kept.
LAST_SQL = """last AS (
  SELECT URL, a.main_category, a.sub_category, a.level, true AS hit FROM (
    SELECT URL, arg_max(struct_pack(main_category, sub_category, level), ord) AS a
    FROM responses GROUP BY URL))"""


def _lookup_sql() -> str:
    d = D.JOB_DEFAULT
    return f"""merged AS (
  SELECT j.seq, j.url, j.job_title,
    CASE WHEN l.hit THEN l.main_category ELSE '{d['main_category']}' END AS main_category,
    CASE WHEN l.hit THEN l.sub_category ELSE '{d['sub_category']}' END AS sub_category,
    CASE WHEN l.hit THEN l.level ELSE '{d['level']}' END AS level
  FROM jobs j LEFT JOIN last l ON l.URL = j.url)"""


def q_classify_lookup(spark, sf):
    return C.merge_last_wins(jobs_fx(spark, sf), responses_fx(spark, sf)).select(*MERGE_COLS)


def o_classify_lookup():
    return build("SELECT * FROM merged", ("jobs", "responses"), (LAST_SQL, _lookup_sql()))


def q_classify_merge_rules(spark, sf):
    merged = C.merge_last_wins(jobs_fx(spark, sf), responses_fx(spark, sf))
    return C.validate(merged).select(*MERGE_COLS)


def _rules_sql() -> str:
    bad = _bad_bc_sql()
    return f"""ruled AS (
  SELECT seq, url, job_title,
    CASE WHEN {bad} THEN 'General' ELSE main_category END AS main_category,
    CASE WHEN {bad} THEN 'Other' ELSE sub_category END AS sub_category,
    {_level_sql()} AS level
  FROM merged)"""


def o_classify_merge_rules():
    return build("SELECT * FROM ruled", ("jobs", "responses"), (LAST_SQL, _lookup_sql(), _rules_sql()))


def q_category_counts(spark, sf):
    return C.category_counts(q_classify_merge_rules(spark, sf))


def o_category_counts():
    return build("SELECT main_category, count(*) AS count FROM ruled WHERE main_category IS NOT NULL "
                 "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
                 ("jobs", "responses"), (LAST_SQL, _lookup_sql(), _rules_sql()))


# --- batches and responses --------------------------------------------------

def q_classify_chunks(spark, sf):
    return C.chunk_ids(jobs_fx(spark, sf).select("seq", "url")).select("seq", "url", "chunk")


def o_classify_chunks():
    return build(f"SELECT seq, url, CAST((row_number() OVER (ORDER BY seq) - 1) // {D.CHUNK_SIZE} AS BIGINT) "
                 "AS chunk FROM jobs", ("jobs",))


def q_classify_batches(spark, sf):
    return C.classify_batches(jobs_fx(spark, sf))


PROMPT_TEMPLATE = ("Classify each job into main_category, sub_category and level.\n"
                   "--- JOBS TO CLASSIFY ---\n{jobs_json}\nReturn ONLY valid JSON.")


def q_classify_batch_sizes(spark, sf):
    prompts = C.render_prompt(C.classify_batches(jobs_fx(spark, sf)), PROMPT_TEMPLATE)
    return C.batch_sizes(prompts)


def q_classify_batch_totals(spark, sf):
    """Batches and their totals: the report of a classification run."""
    return C.batch_totals(C.render_prompt(C.classify_batches(jobs_fx(spark, sf)), PROMPT_TEMPLATE))


def _batches_sql(final: str) -> str:
    ctes = (*requirements_ctes("jobs", "seq", "description_text"), f"""numbered AS (
  SELECT j.seq, j.url, j.job_title, r.requirements,
         CAST((row_number() OVER (ORDER BY j.seq) - 1) // {D.CHUNK_SIZE} AS BIGINT) AS chunk
  FROM jobs j JOIN req r ON r.seq = j.seq)""", """batches AS (
  SELECT chunk, count(*) AS n_jobs, min(seq) AS first_seq,
         CAST(to_json(list(struct_pack("URL" := url, "job_title" := job_title, "description_text" := requirements) ORDER BY seq))
              AS VARCHAR) AS payload
  FROM numbered GROUP BY chunk)""", f"""prompts AS (
  SELECT chunk, n_jobs, length(payload) + {len(PROMPT_TEMPLATE.replace('{jobs_json}', ''))} AS chars FROM batches)""")
    return build(final, ("jobs",), ctes).replace("WITH ", "WITH RECURSIVE ", 1)


EST_SQL = f"CAST(ceil(chars / {D.CHARS_PER_TOKEN}) AS BIGINT)"


def o_classify_batch_totals():
    return _batches_sql(f"""SELECT chunk, count(n_jobs) AS batches, coalesce(sum(n_jobs), 0)::BIGINT AS n_jobs,
       coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum({EST_SQL}), 0)::BIGINT AS est_tokens
FROM prompts GROUP BY ROLLUP (chunk)""")


def _answers(spark, sf):
    """Answers per chunk of 50 responses in ord order; chunk % 7 = 3 is
    malformed JSON, chunk % 11 = 5 lacks job_list."""
    r = C.chunk_ids(responses_fx(spark, sf), order_col="ord")
    grouped = r.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "URL", "main_category", "sub_category", "level"))).alias("items"))
    items = F.transform("items", lambda x: F.struct(x["URL"].alias("URL"), x["main_category"].alias("main_category"),
                                                    x["sub_category"].alias("sub_category"), x["level"].alias("level")))
    ok = F.to_json(F.struct(items.alias("job_list")))
    bad = F.concat(F.lit('{"job_list": [{"URL": '), F.col("chunk").cast("string"))
    other = F.to_json(F.struct(items.alias("jobs")))
    payload = (F.when(F.col("chunk") % 7 == 3, bad).when(F.col("chunk") % 11 == 5, other).otherwise(ok))
    return grouped.select("chunk", payload.alias("payload"))


def q_classify_parse(spark, sf):
    return C.parse_responses(_answers(spark, sf))


PARSED_SQL = f"""parsed AS (
  SELECT chunk, CAST((rn - 1) % {D.CHUNK_SIZE} AS BIGINT) AS pos, URL, main_category, sub_category, level
  FROM (SELECT *, row_number() OVER (ORDER BY ord) AS rn,
               CAST((row_number() OVER (ORDER BY ord) - 1) // {D.CHUNK_SIZE} AS BIGINT) AS chunk
        FROM responses)
  WHERE chunk % 7 <> 3 AND chunk % 11 <> 5)"""


def o_classify_parse():
    return build("SELECT * FROM parsed", ("responses",), (PARSED_SQL,))


def q_classify_defaults(spark, sf):
    """Answers of failed chunks (malformed, or without job_list) are lost;
    their jobs get the whole default record, as do jobs never answered."""
    parsed = C.parse_responses(_answers(spark, sf))
    answers = parsed.withColumn("ord", F.col("chunk") * 1_000_000 + F.col("pos"))
    return C.merge_last_wins(jobs_fx(spark, sf), answers).select(*MERGE_COLS)


def o_classify_defaults():
    d = D.JOB_DEFAULT
    return build(f"""SELECT j.seq, j.url, j.job_title,
    CASE WHEN l.hit THEN l.main_category ELSE '{d['main_category']}' END AS main_category,
    CASE WHEN l.hit THEN l.sub_category ELSE '{d['sub_category']}' END AS sub_category,
    CASE WHEN l.hit THEN l.level ELSE '{d['level']}' END AS level
FROM jobs j LEFT JOIN plast l ON l.URL = j.url""", ("jobs", "responses"), (PARSED_SQL, """plast AS (
  SELECT URL, a.main_category, a.sub_category, a.level, true AS hit FROM (
    SELECT URL, arg_max(struct_pack(main_category, sub_category, level), chunk * 1000000 + pos) AS a
    FROM parsed GROUP BY URL))"""))


# --- rule-based classifiers --------------------------------------------------

def q_seniority_rules(spark, sf):
    return C.seniority_rules(jobs_fx(spark, sf).select("seq", "job_title", "description_text")) \
        .select("seq", "job_title", "level")


def seniority_case_sql(title: str, desc: str) -> str:
    t = f"lower(coalesce({title}, ''))"
    d = f"lower(coalesce({desc}, ''))"

    def anyof(col, phrases):
        return "(" + " OR ".join(f"contains({col}, {sql_str(p)})" for p in phrases) + ")"
    whens = []
    for scope, phrases, level in D.SENIORITY_RULES:
        if scope == "any":
            cond = f"({anyof(t, phrases)} OR {anyof(d, phrases)})"
        elif scope == "title":
            cond = anyof(t, phrases)
        elif scope == "desc":
            cond = anyof(d, phrases)
        elif scope == "title_suffix":
            cond = "(" + " OR ".join(f"ends_with({t}, {sql_str(p)})" for p in phrases) + ")"
        else:
            cond = f"({anyof(t, phrases)} AND NOT {anyof(t, ['junior', 'assistant'])})"
        whens.append(f"WHEN {cond} THEN {sql_str(level)}")
    return f"CASE {' '.join(whens)} ELSE {sql_str(D.SENIORITY_DEFAULT)} END"


def o_seniority_rules():
    return build(f"SELECT seq, job_title, {seniority_case_sql('job_title', 'description_text')} AS level "
                 "FROM jobs", ("jobs",))


def q_category_phrases(spark, sf):
    return C.category_phrases(jobs_fx(spark, sf).select("seq", "job_title")) \
        .select("seq", "job_title", "main_category", "sub_category")


def o_category_phrases():
    t = "lower(coalesce(job_title, ''))"
    wm, ws = [], []
    for line, m, s in D.CATEGORY_PHRASES:
        cond = " OR ".join(f"contains({t}, {sql_str(p.strip().lower())})" for p in line.split(" / "))
        wm.append(f"WHEN {cond} THEN {sql_str(m)}")
        ws.append(f"WHEN {cond} THEN {sql_str(s)}")
    d = D.JOB_DEFAULT
    return build(f"SELECT seq, job_title, CASE {' '.join(wm)} ELSE '{d['main_category']}' END AS main_category, "
                 f"CASE {' '.join(ws)} ELSE '{d['sub_category']}' END AS sub_category FROM jobs", ("jobs",))


def q_category_keywords(spark, sf):
    j = jobs_fx(spark, sf).select("seq", "job_title", "description_text")
    return C.category_keywords(j, "seq", "job_title", "description_text") \
        .select("seq", "job_title", "main_category", "sub_category")


def keyword_ctes(src: str, key: str, title: str, text: str) -> tuple[str, ...]:
    """CTEs ending in best(<key>, main, sub): the keyword classifier."""
    rows = C._keyword_rows()
    terms = sorted({r[2] for r in rows})
    kw_values = ", ".join(f"({sql_str(m)}, {sql_str(s)}, {sql_str(k)}, {o})" for m, s, k, o in rows)
    return (
        f"kw(main, sub, keyword, tax_order) AS (VALUES {kw_values})",
        f"""hits AS (
  SELECT {key}, unnest(list_distinct({hit_list_sql(title, terms)})) AS keyword, 3 AS w FROM {src}
  UNION ALL
  SELECT {key}, unnest(list_distinct({hit_list_sql(text, terms)})) AS keyword, 1 AS w FROM {src})""",
        f"""hk AS (SELECT h.{key}, k.main, k.sub, k.tax_order, h.w FROM hits h JOIN kw k ON k.keyword = h.keyword)""",
        f"""mw AS (SELECT {key}, main, tax_order, sum(w) AS score FROM hk WHERE sub IS NULL GROUP BY 1, 2, 3)""",
        f"""scored AS (
  SELECT s.{key}, s.main, s.sub, s.tax_order, s.sw + coalesce(m.score, 0) AS score
  FROM (SELECT {key}, main, sub, tax_order, sum(w) AS sw FROM hk WHERE sub IS NOT NULL GROUP BY 1, 2, 3, 4) s
  LEFT JOIN mw m ON m.{key} = s.{key} AND m.main = s.main
  UNION ALL
  SELECT {key}, main, NULL AS sub, tax_order, score FROM mw)""",
        f"""best AS (
  SELECT {key}, b.main, b.sub FROM (
    SELECT {key}, arg_max(struct_pack(main, sub), score * 1000000 - tax_order) AS b
    FROM scored GROUP BY {key}))""",
    )


def o_category_keywords():
    d = D.JOB_DEFAULT
    return build(f"""SELECT j.seq, j.job_title,
  coalesce(b.main, '{d['main_category']}') AS main_category,
  CASE WHEN b.main IS NULL THEN '{d['sub_category']}' ELSE coalesce(b.sub, 'Other') END AS sub_category
FROM jobs j LEFT JOIN best b ON b.seq = j.seq""", ("jobs",),
                 keyword_ctes("jobs", "seq", "job_title", "description_text"))


def q_cv_classification(spark, sf):
    from jobsift.functions.text import clean_text
    from jobsift.sources.fixtures import cv_pages_fx
    from jobsift.sources.html import ordered_text_concat
    text = ordered_text_concat(cv_pages_fx(spark, sf)).select(
        "cv_id", clean_text(F.col("text")).alias("text"))
    return C.classify_cvs(text)


def o_cv_classification():
    from jobsift.plans.q_text import clean_ctes
    d, c = D.JOB_DEFAULT, D.CV_DEFAULT
    head = "coalesce(string_split(text, chr(10))[1], '')"
    return build(f"""SELECT v.cv_id,
  CASE WHEN coalesce(v.text, '') = '' THEN '{c['main_category']}'
       ELSE coalesce(b.main, '{d['main_category']}') END AS main_category,
  CASE WHEN coalesce(v.text, '') = '' THEN '{c['sub_category']}'
       WHEN b.main IS NULL THEN '{d['sub_category']}' ELSE coalesce(b.sub, 'Other') END AS sub_category,
  CASE WHEN coalesce(v.text, '') = '' THEN '{c['level']}'
       ELSE {seniority_case_sql('v.headline', 'v.text')} END AS level
FROM cvh v LEFT JOIN best b ON b.cv_id = v.cv_id""", ("cv_pages",),
                 clean_ctes() + (f"cvh AS (SELECT cv_id, text, {head} AS headline FROM cv_clean)",)
                 + keyword_ctes("cvh", "cv_id", "headline", "text"))


register("level_override", o_level_override)(q_level_override)
register("category_override", o_category_override)(q_category_override)
register("override_metrics", o_override_metrics)(q_override_metrics)
register("classify_merge_fanout", o_classify_merge_fanout)(q_classify_merge_fanout)
register("classify_lookup", o_classify_lookup)(q_classify_lookup)
register("classify_merge_rules", o_classify_merge_rules)(q_classify_merge_rules)
register("category_counts", o_category_counts)(q_category_counts)
register("classify_chunks", o_classify_chunks)(q_classify_chunks)
register("classify_batches", lambda: _batches_sql("SELECT * FROM batches"))(q_classify_batches)
register("classify_batch_sizes", lambda: _batches_sql(
    f"SELECT chunk, chars, {EST_SQL} AS est_tokens FROM prompts"))(q_classify_batch_sizes)
register("classify_batch_totals", o_classify_batch_totals)(q_classify_batch_totals)
register("classify_parse", o_classify_parse)(q_classify_parse)
register("classify_defaults", o_classify_defaults)(q_classify_defaults)
register("seniority_rules", o_seniority_rules)(q_seniority_rules)
register("category_phrases", o_category_phrases)(q_category_phrases)
register("category_keywords", o_category_keywords)(q_category_keywords)
register("cv_classification", o_cv_classification)(q_cv_classification)
