"""Skill overlap of CVs and jobs by an inverted index, for any dictionary.

The mask form (``match.score_pairs``) looks at every pair of a category, with a
plan of the dictionary's size.  Here skills are rows.  Both sides are dealt to
blocks of one category (``blockmatch``), each with its index: skill -> rows.  A
pair of blocks is one unit of an Arrow task: the postings of the skills that
both have are counted (those of frequent skills by a matrix product), and only
pairs that reach ``min_score`` percent of the job's required skills leave it.
Sets of skills stay in their blocks; no candidate carries them.

Hot skills and categories only mean more blocks, of about ``HOT`` jobs.  Bypass
CVs are blocks of their own that meet all jobs.

Defined cases: jobs without skills never reach a score above 0; a CV without
skills has no pairs; NULL categories match only bypass CVs; rows without an id
have no pairs; skill arrays count as sets of lower-case names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions import scores as S
from jobsift.operators import blockmatch as B
from jobsift.operators.match import skill_names
from jobsift.sources.sinks import scratch_table

HOT = 4096      # jobs of a block, on average at most
CV_BLOCK = 256  # CVs of a block


def _pair_batches(min_score: int):
    def work(column, cv, job, cat, sen):
        matched = B.overlap(cv, job)
        i, j = np.nonzero(matched * 100 >= min_score * job.size.astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [column("cv_id").take(pa.array(i)), column("seq", True).take(pa.array(j)), pa.array(matched[i, j], pa.int32()),
             pa.array(job.size[j], pa.int32())], names=["cv_id", "seq", "n_matched", "n_required"])
    return lambda batches: B.each_cell(batches, work)


def overlap_pairs(cvs: DataFrame, jobs: DataFrame, min_score: int = 80, bypass: bool = True) -> DataFrame:
    """cvs(cv_id, main_category, skills), jobs(seq, main_category, skills) ->
    cv_id, seq, n_matched, n_required, score_skills of the candidate pairs
    whose skill score is ``min_score`` (1 to 100) or more."""
    if not 1 <= min_score <= 100:
        raise ValueError("min_score must be 1 to 100")
    names = F.array_sort(skill_names(F.col("skills"))).alias("names")
    star = F.coalesce((F.col("main_category") == D.BYPASS_CATEGORY) & F.lit(bypass), F.lit(False))
    held = "size(names) > 0"
    c = scratch_table(cvs.select("cv_id", F.col("main_category").alias("main"), star.alias("star"), names)
                      .where(held).where("cv_id is not null"), "overlap")
    j = scratch_table(jobs.select("seq", F.col("main_category").alias("main"), names).where(held).where("seq is not null"), "overlap")
    cvb = scratch_table(B.skill_blocks(c, ["star", "main"], CV_BLOCK, ["cv_id"], "cb"), "overlap")
    jobb = scratch_table(B.skill_blocks(j, ["main"], HOT, ["seq"], "jb"), "overlap")
    met = B._met_blocks(scratch_table(B.category_cells(cvb, jobb), "overlap"), cvb, jobb, ["cv_id"], ["seq"])
    kind = {n: dict(t.dtypes)[n] for t, n in ((c, "cv_id"), (j, "seq"))}
    found = met.mapInArrow(_pair_batches(min_score), f"cv_id {kind['cv_id']}, seq {kind['seq']}, n_matched int, n_required int")
    return found.select("*", F.round(S.skill_score(F.col("n_matched"), F.col("n_required")), 1).alias("score_skills"))
