"""Queries of maintained tables (live jobs, skills), of the nightly job and its counts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from jobsift.operators.dedup import dedup_latest
from jobsift.operators.skills import skill_pairs
from jobsift.plans import q_text
from jobsift.plans.catalog import register
from jobsift.plans.nightly import run_nightly
from jobsift.plans.q_dedup import LATEST_SQL
from jobsift.plans.sqlkit import build, hit_list_sql, hits_sql
from jobsift.session import checkpoint_path
from jobsift.sources import sinks
from jobsift.sources.fixtures import SKILLS_FX, jobs_fx
from jobsift.streaming import ingest, live


DAY_FILES = 4  # parts of a day in the source folder, at most


def q_stream_live(spark, sf):
    """Daily files through the stream, the days in an order that makes half of
    the rows late, three days delivered twice; then the live table."""
    base = checkpoint_path(spark, f"stream_live/{uuid.uuid4().hex}")
    jobs = jobs_fx(spark, sf)
    by = ["search_date", F.pmod(F.xxhash64("seq"), F.lit(DAY_FILES))]
    days = jobs.repartition(30 * DAY_FILES, *by).write.partitionBy("search_date")
    days.mode("overwrite").parquet(f"{base}/source")
    again = jobs.where(F.dayofmonth("search_date").isin(2, 3, 29)).repartition(3 * DAY_FILES, *by)
    again.write.mode("append").partitionBy("search_date").parquet(f"{base}/source")
    live.run_stream(spark, f"{base}/source", ingest.stream_schema(jobs), f"{base}/table", f"{base}/checkpoint", SKILLS_FX,
                    max_files_per_trigger=12 * DAY_FILES, compact_every=2)
    return live.live_jobs(spark, f"{base}/table").select(*jobs.columns)


def q_live_skills(spark, sf):
    """Three nights into the skills table: only pairs of jobs that came or went
    are written, with a compaction after the second night."""
    base = checkpoint_path(spark, f"live_skills/{uuid.uuid4().hex}")
    jobs = jobs_fx(spark, sf)
    for night in range(3):
        live.apply_batch(spark, base, jobs.where(F.dayofmonth("search_date") % 3 == night), night, SKILLS_FX, compact_every=2)
    return live.read_skills(spark, base)


STEPS = ("jobs", "live", "skills")


def q_write_counts(spark, sf):
    """The tables of a run and how many rows each write took, observed by the writes."""
    base = checkpoint_path(spark, f"write_counts/{uuid.uuid4().hex}")
    no_text = F.count_if(F.coalesce(F.col("description_text"), F.lit("")) == "")
    got = {"jobs": sinks.write_counted(jobs_fx(spark, sf), f"{base}/jobs", empty_rows=no_text, last_seq=F.max("seq"))}
    kept = dedup_latest(spark.read.parquet(f"{base}/jobs"))
    got["live"] = sinks.write_counted(kept, f"{base}/live", empty_rows=no_text, last_seq=F.max("seq"))
    pairs = skill_pairs(spark.read.parquet(f"{base}/live"), ["seq", "url"], "description_text", SKILLS_FX)
    got["skills"] = sinks.write_counted(pairs, f"{base}/skills", empty_rows=F.count_if(F.col("skill") == ""), last_seq=F.max("seq"))
    return spark.createDataFrame([(t, got[t]["rows"], got[t]["empty_rows"], got[t]["last_seq"]) for t in STEPS],
                                 "step string, rows bigint, empty_rows bigint, last_seq bigint")


def o_write_counts():
    no_text = "count(*) FILTER (coalesce(description_text, '') = '')"
    return build(f"""SELECT 'jobs' AS step, count(*) AS rows, {no_text} AS empty_rows, max(seq) AS last_seq FROM jobs
UNION ALL SELECT 'live', count(*), {no_text}, max(seq) FROM live
UNION ALL SELECT 'skills', count(*), 0, max(seq) FROM (
  SELECT seq, unnest({hit_list_sql('description_text', SKILLS_FX, True)}) AS skill FROM live)""",
                 ("jobs",), (f"live AS ({LATEST_SQL.format(t='jobs')})",))


NIGHTS = (dt.date(2024, 3, 1), dt.date(2024, 3, 2))


def q_nightly_live(spark, sf):
    """The nightly job over two nights, the second one run twice: captured
    posting pages to the live table, with the pairs table's skills per url."""
    base = checkpoint_path(spark, f"nightly_live/{uuid.uuid4().hex}")
    pages = q_text.posting_pages(spark, sf).withColumn("capture_order", F.col("page_id"))
    for night in (0, 1, 1):
        paths = run_nightly(spark, pages.where(F.col("page_id") % 2 == night), None, f"{base}/table", f"{base}/export{night}",
                            NIGHTS[night], SKILLS_FX)
    skills = (spark.read.parquet(paths["skills"]).groupBy(F.col("url").alias("_url"))
              .agg(F.array_sort(F.collect_set("skill")).alias("skills")))
    rows = spark.read.parquet(paths["live"]).join(skills, F.col("url") == F.col("_url"), "left")
    return rows.select("seq", "url", "job_title", "company_name", "num_applicants", "description_text", "search_date",
                       F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def o_nightly_live():
    fields = q_text.o_posting_fields()
    return f"""WITH posted AS ({fields}),
nights AS (
  SELECT *, CASE WHEN page_id % 2 = 0 THEN DATE '{NIGHTS[0]}' ELSE DATE '{NIGHTS[1]}' END AS search_date,
         row_number() OVER (ORDER BY page_id % 2, page_id) AS seq FROM posted),
latest AS (SELECT * FROM nights QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
live AS (
  SELECT * FROM latest
  QUALIFY description_text IS NULL OR row_number() OVER (PARTITION BY description_text ORDER BY seq DESC) = 1)
SELECT seq, url, job_title, company_name, num_applicants, description_text, search_date,
       {hits_sql('description_text', SKILLS_FX)} AS skills FROM live"""


def o_live_skills():
    return build(f"""SELECT DISTINCT url, skill FROM (
  SELECT url, unnest({hit_list_sql('description_text', SKILLS_FX, True)}) AS skill FROM live)""",
                 ("jobs",), (f"live AS ({LATEST_SQL.format(t='jobs')})",))


register("stream_live", lambda: build(LATEST_SQL.format(t="jobs"), ("jobs",)))(q_stream_live)
register("live_skills", o_live_skills)(q_live_skills)
register("write_counts", o_write_counts)(q_write_counts)
register("nightly_live", o_nightly_live)(q_nightly_live)
