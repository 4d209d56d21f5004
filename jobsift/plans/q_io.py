"""Scans, filtered scans, exports and the streaming ingest."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from jobsift.operators import skills as SK
from jobsift.operators.dedup import dedup_latest
from jobsift.plans.catalog import register
from jobsift.plans.q_dedup import LATEST_SQL
from jobsift.plans.sqlkit import build, hit_list_sql
from jobsift.session import checkpoint_path
from jobsift.sources import sinks
from jobsift.sources.fixtures import SKILLS_FX, jobs_fx
from jobsift.streaming import ingest

EXPORT_JOB_COLS = ["job_title", "company_name", "location", "search_date", "main_category",
                   "sub_category", "URL"]
CATEGORY_PARAM = "Data & BI"
JOB_COLS = ["seq", "url", "job_title", "company_name", "location", "time_posted", "num_applicants",
            "description_text", "search_date", "bert_vector", "main_category", "sub_category", "level"]


def q_scan_jobs(spark, sf):
    return jobs_fx(spark, sf)


def q_jobs_by_category(spark, sf, category: str = CATEGORY_PARAM):
    """A filtered scan of the stored table: it is kept by category, so the
    filter selects folders (``PartitionFilters``) and reads no other rows."""
    base = checkpoint_path(spark, f"jobs_by_category/{uuid.uuid4().hex}")
    sinks.append_jobs(jobs_fx(spark, sf), base, partition_col="main_category")
    return spark.read.parquet(base).where(F.col("main_category") == F.lit(category)).select(*JOB_COLS)


def q_export_jobs(spark, sf):
    live = dedup_latest(jobs_fx(spark, sf)).withColumnRenamed("url", "URL")
    return sinks.export_rows(live, EXPORT_JOB_COLS)


def o_export_jobs():
    cols = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in EXPORT_JOB_COLS)
    return build(f"SELECT {cols} FROM (SELECT *, url AS URL FROM live)", ("jobs",),
                 (f"live AS ({LATEST_SQL.format(t='jobs')})",))


def q_export_skills(spark, sf):
    jobs = jobs_fx(spark, sf)
    pairs = SK.live_skill_pairs(SK.skill_pairs(jobs, ["url"], "description_text", SKILLS_FX),
                                dedup_latest(jobs))
    return sinks.export_rows(pairs.withColumnRenamed("url", "URL"))


def o_export_skills():
    return build(f"""SELECT DISTINCT coalesce(url, '') AS URL, coalesce(skill, '') AS skill FROM (
  SELECT url, unnest({hit_list_sql('description_text', SKILLS_FX, True)}) AS skill FROM jobs)
WHERE url IN (SELECT url FROM live)""", ("jobs",), (f"live AS ({LATEST_SQL.format(t='jobs')})",))


def q_stream_ingest(spark, sf):
    """Daily files of the jobs view -> streaming append -> live table.
    Must equal the batch dedup of all rows."""
    base = checkpoint_path(spark, f"stream_ingest/{uuid.uuid4().hex}")
    jobs = jobs_fx(spark, sf)
    ingest.split_by_day(jobs, f"{base}/incoming")
    ingest.run_ingest(spark, f"{base}/incoming", ingest.stream_schema(jobs), f"{base}/table",
                      f"{base}/checkpoint")
    return ingest.live_jobs(spark, f"{base}/table", JOB_COLS)


def q_append_jobs(spark, sf):
    """Two nightly batches (days 1-15, then 16-30) appended to a table
    partitioned by search_date, read back whole."""
    base = checkpoint_path(spark, f"append_jobs/{uuid.uuid4().hex}")
    jobs = jobs_fx(spark, sf)
    cut = F.lit(dt.date(2024, 1, 16))
    sinks.append_jobs(jobs.where(F.col("search_date") < cut), base)
    sinks.append_jobs(jobs.where(F.col("search_date") >= cut), base)
    return spark.read.parquet(base).select(*JOB_COLS)


register("append_jobs", lambda: build("SELECT * FROM jobs", ("jobs",)))(q_append_jobs)
register("scan_jobs", lambda: build("SELECT * FROM jobs", ("jobs",)))(q_scan_jobs)
register("jobs_by_category",
         lambda: build(f"SELECT * FROM jobs WHERE main_category = '{CATEGORY_PARAM}'", ("jobs",)))(
    q_jobs_by_category)
register("export_jobs", o_export_jobs)(q_export_jobs)
register("export_skills", o_export_skills)(q_export_skills)
register("stream_ingest", lambda: build(LATEST_SQL.format(t="jobs"), ("jobs",)))(q_stream_ingest)
