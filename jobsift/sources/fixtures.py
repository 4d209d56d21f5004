"""Job-market views derived from the driver's tables.

The application's own inputs (captured postings, classification responses,
CVs) are not part of the test data, so each is formed from a driver table by
a fixed rule (documents -> jobs, embeddings -> CVs, labels -> responses,
pages -> captured pages, conversations -> CV pages).  Each view exists twice:
as a Spark DataFrame builder and as DuckDB SQL (a CTE body), so every query
built on it can be checked against an independent engine.  All work grows
with the input tables; nothing here is a fixed small table except the
dictionaries, which are parameters.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.dictionaries import TAXONOMY_ROWS
from jobsift.sources.tables import read_test_table

JOB_URL_PREFIX = "https://example.org/job/"

# Titles given to the fixture jobs (row doc_id % 20); each hits one branch of
# the title rules.  Index 19 is a missing title.
TITLES = [
    "Senior Data Engineer", "Director of Engineering", "Lead Backend Developer",
    "Team Lead", "VP Sales", "Product Manager", "Junior Product Manager",
    "Assistant Store Manager", "Software Engineer II", "Software Engineer III",
    "Software Engineer III - Platform", "Internal Auditor",
    "International Sales Associate", "Data Science Student",
    "Lead Generation Specialist", "Sr. Analyst", "SR Analyst",
    "Warehouse Picker", "Graduate 2026 Researcher", None,
]
# Job level cycle, position floor(doc_id / 20) % 5 (NULL = unknown level)
JOB_LEVELS = ["intern", "junior", "senior", "lead", None]
# CV level cycle, position (vec_id div 41) % 5; 'Senior' is unknown on the
# case-sensitive CV side.
CV_LEVELS = ["intern", "junior", "senior", "lead", "Senior"]

# Fixture skill dictionary: terms that occur in the driver's prose
# (a real skill list has no hits there).
SKILLS_FX = ["the", "and", "with", "from", "dans", "pour", "avec", "une", "que",
             "est", "nicht", "für", "über", "der", "los", "para", "of the",
             "in the", "que de"]
# Edge dictionary for punctuation cases of whole-word matching.
EDGE_SKILLS = ["python", "sql", "ci/cd", "node.js", "schema-on-read",
               "machine learning", "natural language processing", "a/b testing",
               "r programming", "c++", "k-means"]


def _str_array(values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _pick(values, idx: Column) -> Column:
    """values[idx] for a literal list (0-based, NULL when out of range)."""
    return F.get(_str_array(values), idx.cast("int"))


FIXTURE_BROADCAST_BYTES = 64 * 1024 * 1024


def _vector_table_stats(emb: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of the embeddings table: one small aggregate
    (only the vector column is read)."""
    row = emb.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims")).first()
    return int(row["n"]), int(row["n"]) * (32 + 4 * int(row["dims"]))


def job_url(doc_id: Column) -> Column:
    """Rows 8 and 9 of every ten share one URL (re-scraped postings)."""
    base = F.when(doc_id % 10 == 9, doc_id - 1).otherwise(doc_id)
    return F.concat(F.lit(JOB_URL_PREFIX), base.cast("string"))


def jobs_fx(spark: SparkSession, sf_dir: str, null_every: int | None = None) -> DataFrame:
    """The jobs table: one posting per document.

    ``null_every``: description NULL where doc_id % null_every = 0
    (the jobs_null variant uses 97)."""
    docs = read_test_table(spark, sf_dir, "documents")
    emb = read_test_table(spark, sf_dir, "embeddings")
    n_emb, emb_bytes = _vector_table_stats(emb)
    d = F.col("doc_id")
    desc = F.col("text")
    if null_every:
        desc = F.when(d % null_every == 0, F.lit(None).cast("string")).otherwise(desc)
    jobs = docs.select(
        d.alias("seq"),
        job_url(d).alias("url"),
        _pick(TITLES, d % 20).alias("job_title"),
        F.col("source").alias("company_name"),
        F.col("lang").alias("location"),
        F.when(d % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat((d % 7).cast("string"), F.lit(" days ago"))).alias("time_posted"),
        F.concat((d % 90).cast("string"), F.lit(" applicants")).alias("num_applicants"),
        desc.alias("description_text"),
        F.date_add(F.lit(_dt.date(2024, 1, 1)), (d % 30).cast("int")).alias("search_date"),
        _pick([m for m, _ in TAXONOMY_ROWS], d % 40).alias("main_category"),
        _pick([s for _, s in TAXONOMY_ROWS], d % 40).alias("sub_category"),
        _pick(JOB_LEVELS, F.expr("doc_id div 20") % 5).alias("level"),
        (F.pmod(d, F.lit(n_emb)) if n_emb > 0 else F.lit(None).cast("bigint")).alias("_vk"),
    )
    vecs = emb.select(F.col("vec_id").alias("_vk"), F.col("embedding").alias("bert_vector"))
    if emb_bytes <= FIXTURE_BROADCAST_BYTES:  # measured: the documents stream, no text shuffle
        vecs = F.broadcast(vecs)
    return (jobs.join(vecs, "_vk", "left")
            .select("seq", "url", "job_title", "company_name", "location", "time_posted",
                    "num_applicants", "description_text", "search_date", "bert_vector",
                    "main_category", "sub_category", "level"))


def cvs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CV per embedding row: cv_id = vec_id, its vector, a category
    (taxonomy row vec_id % 41; row 40 = main 'Other', the bypass case) and a
    level from CV_LEVELS.  With n = the smaller of the two row counts, its text
    is that of all documents with doc_id % n = vec_id % n, in order, so every
    document is part of a CV."""
    emb = read_test_table(spark, sf_dir, "embeddings")
    docs = read_test_table(spark, sf_dir, "documents")
    n = min(docs.count(), emb.count())
    v = F.col("vec_id")
    mains = [m for m, _ in TAXONOMY_ROWS] + ["Other"]
    subs = [s for _, s in TAXONOMY_ROWS] + ["Other"]
    key = (lambda c: F.pmod(c, F.lit(n))) if n > 0 else (lambda c: F.lit(None).cast("bigint"))
    cvs = emb.select(
        v.alias("cv_id"),
        F.col("embedding").alias("vector"),
        _pick(mains, v % 41).alias("main_category"),
        _pick(subs, v % 41).alias("sub_category"),
        _pick(CV_LEVELS, F.expr("vec_id div 41") % 5).alias("level"),
        key(v).alias("_dk"),
    )
    parts = docs.where("text is not null").groupBy(key(F.col("doc_id")).alias("_dk")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("_p"))
    texts = parts.select("_dk", F.array_join(F.transform("_p", lambda x: x["text"]), "\n").alias("text"))
    return (cvs.join(texts, "_dk", "left")
            .select("cv_id", "text", "vector", "level", "main_category", "sub_category"))


# Words and two-word phrases that a derived skill dictionary takes from a text.
TERM_PATTERNS = ["[a-z]{5,}", "[a-z]{3,} [a-z]{3,}"]


def terms_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill dictionary as a table: words and phrases of the conversations and benchmark items."""
    texts = read_test_table(spark, sf_dir, "conversations").select("text").unionByName(
        read_test_table(spark, sf_dir, "benchmark").select("text"))
    found = F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(p), 0) for p in TERM_PATTERNS])
    return texts.where("text is not null").select(F.explode(found).alias("term")).distinct()


def sql_terms_fx() -> str:
    found = " || ".join(f"regexp_extract_all(lower(text), '{p}')" for p in TERM_PATTERNS)
    return f"""SELECT DISTINCT unnest({found}) AS term
FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL"""


WIDE_TURNS, WIDE_STEP = 6, 10


def widened(v: Column) -> Column:
    """A vector six times as wide: itself and five rotations by ten components."""
    turns = [F.concat(F.slice(v, WIDE_STEP * i + 1, F.size(v)), F.slice(v, 1, WIDE_STEP * i)) for i in range(WIDE_TURNS)]
    return F.concat(*turns)


def sql_widened(v: str) -> str:
    return " || ".join(f"({v})[{WIDE_STEP * i + 1}:] || ({v})[1:{WIDE_STEP * i}]" for i in range(WIDE_TURNS))


def responses_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification responses, one per labelled document: URL of that
    job, category = taxonomy row (doc_id * 7) % 40, level senior/junior by
    quality, NULL level (key present, value NULL) where toxic = 1."""
    lab = read_test_table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return lab.select(
        job_url(d).alias("URL"),
        _pick([m for m, _ in TAXONOMY_ROWS], (d * 7) % 40).alias("main_category"),
        _pick([s for _, s in TAXONOMY_ROWS], (d * 7) % 40).alias("sub_category"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
         .when(F.col("quality") == 1, F.lit("senior")).otherwise(F.lit("junior")).alias("level"),
        d.alias("ord"),
    )


def cv_pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV pages: one CV per conversation, one page per turn."""
    conv = read_test_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("cv_id"), F.col("turn").alias("page"), "text")


def cv_blank_pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV pages with a blank one (no extractable text) before every fifth."""
    pages = cv_pages_fx(spark, sf_dir)
    blank = pages.where(F.col("page") % 5 == 3).select(
        "cv_id", (F.col("page") * 2 - 1).alias("page"), F.lit("").alias("text"))
    return pages.withColumn("page", F.col("page") * 2).unionByName(blank)


def req_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with a requirements section on even doc ids."""
    docs = read_test_table(spark, sf_dir, "documents")
    t = F.col("text")
    rest = F.substring(t, 201, F.length(t))
    with_section = F.concat(F.substring(t, 1, 200), F.lit("\nRequirements:\n- "), rest, F.lit("\nBenefits\nmore"))
    return docs.select(F.col("doc_id"),
                       F.when(F.col("doc_id") % 2 == 0, with_section).otherwise(t)
                        .alias("description_text"))


def responses_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured detail responses: each page with an HTTP status
    (429 where page_id % 25 = 0, 404 where page_id % 40 = 1, else 200)."""
    pages = read_test_table(spark, sf_dir, "pages")
    p = F.col("page_id")
    return pages.select(
        p.cast("string").alias("job_id"),
        F.when(p % 25 == 0, 429).when(p % 40 == 1, 404).otherwise(200).cast("int").alias("status"),
        F.col("html"),
    )


# ---------------------------------------------------------------------------
# DuckDB SQL for the same views (CTE bodies over the driver's views)
# ---------------------------------------------------------------------------

def _sql_str(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]::VARCHAR[]"


def _sql_url(doc: str) -> str:
    return (f"'{JOB_URL_PREFIX}' || CAST(CASE WHEN {doc} % 10 = 9 THEN {doc} - 1 "
            f"ELSE {doc} END AS VARCHAR)")


def sql_jobs_fx(null_every: int | None = None) -> str:
    desc = "d.text"
    if null_every:
        desc = f"CASE WHEN d.doc_id % {null_every} = 0 THEN NULL ELSE d.text END"
    mains = _sql_list([m for m, _ in TAXONOMY_ROWS])
    subs = _sql_list([s for _, s in TAXONOMY_ROWS])
    return f"""
SELECT d.doc_id AS seq,
       {_sql_url('d.doc_id')} AS url,
       ({_sql_list(TITLES)})[d.doc_id % 20 + 1] AS job_title,
       d.source AS company_name,
       d.lang AS location,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL
            ELSE CAST(d.doc_id % 7 AS VARCHAR) || ' days ago' END AS time_posted,
       CAST(d.doc_id % 90 AS VARCHAR) || ' applicants' AS num_applicants,
       {desc} AS description_text,
       CAST(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) AS DATE) AS search_date,
       e.embedding AS bert_vector,
       ({mains})[d.doc_id % 40 + 1] AS main_category,
       ({subs})[d.doc_id % 40 + 1] AS sub_category,
       ({_sql_list(JOB_LEVELS)})[(d.doc_id // 20) % 5 + 1] AS level
FROM documents d
LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)
"""


def sql_cvs_fx() -> str:
    mains = _sql_list([m for m, _ in TAXONOMY_ROWS] + ["Other"])
    subs = _sql_list([s for _, s in TAXONOMY_ROWS] + ["Other"])
    return f"""
SELECT e.vec_id AS cv_id, d.text AS text, e.embedding AS vector,
       ({_sql_list(CV_LEVELS)})[(e.vec_id // 41) % 5 + 1] AS level,
       ({mains})[e.vec_id % 41 + 1] AS main_category,
       ({subs})[e.vec_id % 41 + 1] AS sub_category
FROM embeddings e
LEFT JOIN (SELECT doc_id % (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings))) AS k,
                  string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL) d
  ON d.k = e.vec_id % (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)))
"""


def sql_responses_fx() -> str:
    mains = _sql_list([m for m, _ in TAXONOMY_ROWS])
    subs = _sql_list([s for _, s in TAXONOMY_ROWS])
    return f"""
SELECT {_sql_url('l.doc_id')} AS URL,
       ({mains})[(l.doc_id * 7) % 40 + 1] AS main_category,
       ({subs})[(l.doc_id * 7) % 40 + 1] AS sub_category,
       CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 1 THEN 'senior' ELSE 'junior' END AS level,
       l.doc_id AS ord
FROM labels l
"""


def sql_cv_pages_fx() -> str:
    return "SELECT conv_id AS cv_id, turn AS page, text FROM conversations"


def sql_cv_blank_pages_fx() -> str:
    return """
SELECT conv_id AS cv_id, turn * 2 AS page, text FROM conversations
UNION ALL
SELECT conv_id, turn * 2 - 1, '' FROM conversations WHERE turn % 5 = 3
"""


def sql_req_fx() -> str:
    return """
SELECT doc_id,
       CASE WHEN doc_id % 2 = 0
            THEN substring(text, 1, 200) || chr(10) || 'Requirements:' || chr(10) || '- '
                 || substring(text, 201) || chr(10) || 'Benefits' || chr(10) || 'more'
            ELSE text END AS description_text
FROM documents
"""


def sql_responses_status() -> str:
    return """
SELECT CAST(page_id AS VARCHAR) AS job_id,
       CAST(CASE WHEN page_id % 25 = 0 THEN 429 WHEN page_id % 40 = 1 THEN 404 ELSE 200 END AS INTEGER) AS status,
       html
FROM pages
"""


FIXTURE_SQL = {
    "jobs": lambda: sql_jobs_fx(),
    "jobs_null": lambda: sql_jobs_fx(97),
    "cvs": sql_cvs_fx,
    "responses": sql_responses_fx,
    "cv_pages": sql_cv_pages_fx,
    "cv_blank_pages": sql_cv_blank_pages_fx,
    "req_in": sql_req_fx,
    "detail_responses": sql_responses_status,
    "terms": sql_terms_fx,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each named fixture."""
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]()})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
