"""The nightly job: captured detail pages -> jobs table -> live table,
skill pairs and export.  Each step is a DataFrame function of this package;
the tables are parquet folders on shared storage.

    raw/      every ingested batch, appended, partitioned by search_date
    rejects/  responses that gave no row, per run date
    encoder/  the text encoder, fitted once
    live/     versioned: the deduped jobs (readers never see a half write)
    skills/   versioned: distinct (url, skill) pairs of live jobs
    export/   CSV per tab (full refresh)
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.operators import classify as C
from jobsift.operators import dedup as DD
from jobsift.operators import skills as SK
from jobsift.operators import vectors as V
from jobsift.sources import html as H
from jobsift.sources import sinks

EXPORT_JOB_COLS = ["job_title", "company_name", "location", "search_date", "main_category",
                   "sub_category", "url"]


def capture_order(start: str = "start", pos: str = "pos"):
    """Listing position of a card (page start, then card position) as one
    exact number: the order the collector met the job."""
    return (F.col(start).cast("decimal(24,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + F.col(pos)).cast("decimal(38,0)")


def ingest_batch(detail_responses: DataFrame, run_date: dt.date, order_col: str = "capture_order",
                 url_prefix: str = D.POSTING_URL_PREFIX, after: int = 0) -> DataFrame:
    """Usable responses (job_id, status, html, <order_col> unique) -> one job
    row each, with the run date and an ingest order ``seq`` that goes on after
    ``after`` (the largest of the table) in capture order."""
    jobs = H.posting_fields(detail_responses, url_prefix, keep=[order_col])
    numbered = C.global_row_number(jobs, order_col)
    return numbered.select(
        (F.lit(after).cast("bigint") + F.col("row_number")).alias("seq"),
        "url", "job_title", "company_name", "location", "time_posted", "num_applicants",
        "description_text", F.lit(run_date).alias("search_date"))


def table_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_nightly(spark: SparkSession, detail_responses: DataFrame, answers: DataFrame | None,
                table_base: str, export_base: str, run_date: dt.date, skills,
                url_prefix: str = D.POSTING_URL_PREFIX, vector_dims: int = 256) -> dict:
    """One nightly run.  ``answers``: classification answers (URL,
    main_category, sub_category, level, ord) or None (all defaults).
    A repeated run of a date replaces that date's rows.  The text encoder is
    fitted by the first run and kept beside the table, so vectors of different
    nights compare.  Returns the paths written and the export status per tab."""
    before = table_rows(spark, f"{table_base}/raw")
    last = before.where(F.col("search_date") != F.lit(run_date)).agg(F.max("seq")).first()[0] if before is not None else None
    batch = ingest_batch(detail_responses, run_date, url_prefix=url_prefix, after=last or 0)
    if before is not None:  # later nights than a repeated one stay the newest
        newer = before.where(F.col("search_date") > F.lit(run_date)).agg(F.min("seq")).first()[0]
        if newer is not None:
            raise ValueError(f"{run_date} lies before nights that are in the table; rebuild from that date on")
    model = stored_encoder(batch, f"{table_base}/encoder", vector_dims)
    batch = V.encode(model, batch, "description_text", "bert_vector")
    H.rejected_responses(detail_responses).withColumn("search_date", F.lit(run_date)).write.mode("overwrite") \
        .parquet(f"{table_base}/rejects/search_date_{run_date}")
    if answers is None:
        answers = spark.createDataFrame([], "URL string, main_category string, sub_category string, "
                                            "level string, ord bigint")
    batch = C.validate(C.merge_last_wins(batch, answers))
    sinks.append_jobs(batch, f"{table_base}/raw", replace_dates=True)
    raw = spark.read.parquet(f"{table_base}/raw")
    live_path = sinks.write_version(DD.dedup_latest(raw), f"{table_base}/live")
    live = spark.read.parquet(live_path)
    pairs = SK.live_skill_pairs(SK.skill_pairs(live, ["url"], "description_text", skills), live)
    skills_path = sinks.write_version(pairs, f"{table_base}/skills")
    status = sinks.export_tabs({"jobs": live.select(*EXPORT_JOB_COLS),
                                "skills": spark.read.parquet(skills_path)}, export_base)
    return {"live": live_path, "skills": skills_path, "rejects": f"{table_base}/rejects", "export": status}


def stored_encoder(batch: DataFrame, path: str, dims: int):
    """The encoder kept at ``path``; fitted on this batch if there is none."""
    try:
        batch.sparkSession.read.text(f"{path}/metadata")
    except AnalysisException:  # no such folder: the first night
        pass
    else:
        return PipelineModel.load(path)
    model = V.fit_text_encoder(batch, "description_text", dims)
    model.write().save(path)
    return model
