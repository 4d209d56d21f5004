"""Distributions of the scores of all candidate pairs, without a row a pair.

The candidates of ``match.all_pair_scores`` are counted by blocks
(``blockmatch``): each pair of blocks is scored in one Arrow task, and only
counts or extremes leave it.  No pair is left out and no result is estimated:

* ``skill_counts``: pairs by (matched, required) skills.  Equal skill sets of a
  category are one row with their number first; overlaps by matrix products.
* ``score_counts``: pairs by match score.  Scores come from matrix products,
  which may differ from the pair-wise sum in the last bits, so pairs within
  ``NEAR`` of a rounding edge leave the task with their exact parts (equal ones
  once, with their number) and are rounded by the same expressions as there.
* ``semantic_extremes``: pairs, least and most semantic score a CV; those near
  the least or most of a matrix product are summed again left to right.

Skills are those of the rows: both sides hold entries of one dictionary.
Defined cases are those of ``blockmatch``.
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

NEAR = 1e-6       # score points; matrix products are some 1e-12 off
SEM_NEAR = 1e-7
SET_BLOCK = 2048  # skill sets of a block


def _blocks(cvs: DataFrame, jobs: DataFrame, bypass: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of CVs, blocks of jobs, their cells)."""
    cvb = scratch_table(B.cv_blocks(scratch_table(B.prepare_cvs(cvs, bypass), "stat-cvs")), "stat-cvs")
    jobb = scratch_table(B.job_blocks(scratch_table(B.prepare_jobs(jobs), "stat-jobs")), "stat-jobs")
    return cvb, jobb, scratch_table(B.all_cells(cvb, jobb), "stat-cells")


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# -- skills -------------------------------------------------------------------

def skill_cells(cv: B.Side, job: B.Side, of_cv: np.ndarray, of_job: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched, required, pairs) of two blocks of skill sets that stand for so many rows each."""
    wide = int(cv.size.max()) + 1
    sizes, place = np.unique(job.size, return_inverse=True)
    at = B.overlap(cv, job) + (place * wide).astype(np.int32)[None, :]
    pairs = np.zeros(len(sizes) * wide, np.int64)
    for r, n in zip(at, of_cv, strict=True):  # whole numbers below 2^53 in a row, so exact
        pairs += n * np.bincount(r, of_job, len(pairs)).astype(np.int64)
    held = np.flatnonzero(pairs)
    return held % wide, sizes[held // wide], pairs[held]


def _skill_batches(batches):
    def work(column, cv, job, cat, sen):
        matched, required, pairs = skill_cells(cv, job, column("rows_cv").to_numpy(), column("rows_job", True).to_numpy())
        return _batch({"n_matched": pa.array(matched, pa.int32()), "n_required": pa.array(required, pa.int32()),
                       "pairs": pa.array(pairs, pa.int64())})
    return B.each_cell(batches, work)


def _sets(df: DataFrame, keys: list[str], rows: str, block: str) -> DataFrame:
    """Blocks of the distinct skill sets of each key, with the number of rows (``rows``) of each set."""
    sets = df.groupBy(*keys, F.array_sort(skill_names(F.col("skills"))).alias("names")).agg(F.count(F.lit(1)).alias(rows))
    sets = scratch_table(sets.withColumn("sid", F.xxhash64("names")), "stat-sets")
    return scratch_table(B.skill_blocks(sets, keys, SET_BLOCK, ["sid", rows], block), "stat-sets")


def skill_counts(cvs: DataFrame, jobs: DataFrame, bypass: bool = True) -> DataFrame:
    """n_matched, n_required, pairs (n_matched and n_required may repeat): all candidate pairs."""
    main = F.col("main_category")
    star = F.coalesce((main == D.BYPASS_CATEGORY) & F.lit(bypass), F.lit(False))
    cvb = _sets(cvs.select(star.alias("star"), main.alias("main"), "skills"), ["star", "main"], "rows_cv", "cb")
    jobb = _sets(jobs.select(main.alias("main"), "skills"), ["main"], "rows_job", "jb")
    blocks = B._met_blocks(scratch_table(B.category_cells(cvb, jobb), "stat-cells"), cvb, jobb, ["rows_cv"], ["rows_job"])
    return blocks.mapInArrow(_skill_batches, "n_matched int, n_required int, pairs long")


# -- match scores -------------------------------------------------------------

def score_cells(cv: B.Side, job: B.Side, cat: float, sen: float):
    """(tenths, pairs) of the pairs whose rounded score is sure, and (matched, required, semantic, pairs) of the others."""
    matched, kind = B.overlap(cv, job), B.semantic_kind(cv, job)
    if kind != B.COSINE:  # equal parts: exact by counts
        wide = int(matched.max()) + 1
        sizes, place = np.unique(job.size, return_inverse=True)
        pairs = np.bincount((matched + (place * wide)[None, :]).ravel(), minlength=len(sizes) * wide)
        held = np.flatnonzero(pairs)
        none = np.zeros(0, np.int64)
        return none, none, held % wide, sizes[held // wide], np.full(len(held), 0.0 if kind == B.NO_VECTOR else np.nan), pairs[held]
    raw = matched * np.divide(D.W_SKILLS * 1000.0, job.size, out=np.zeros(job.n), where=job.size > 0)
    raw += 10.0 * (D.W_CATEGORY * cat + D.W_SENIORITY * sen) + 0.5
    raw += (D.W_SEMANTIC * 1000.0 * cv.unit) @ job.unit.T
    tenth = np.floor(raw)
    raw -= tenth
    sure = (raw >= 10.0 * NEAR) & (raw <= 1.0 - 10.0 * NEAR)  # not so for NaN and infinity
    i, j = np.nonzero(~sure)
    if len(i):
        tenth[i, j] = -1.0
    counts = np.bincount((np.maximum(tenth, -1.0).astype(np.int32) + 1).ravel())  # scores below 0 count as 0
    below = int((tenth < 0).sum()) - len(i)
    counts[0] = 0
    if below:
        counts = np.r_[counts, 0][:max(len(counts), 2)]
        counts[1] += below
    held = np.flatnonzero(counts)
    parts = np.stack([matched[i, j], job.size[j], B.semantic(cv, job, i, j)], axis=1) if len(i) else np.zeros((0, 3))
    parts, n = np.unique(parts, axis=0, return_counts=True)
    return held - 1, counts[held], parts[:, 0], parts[:, 1], parts[:, 2], n


def _score_batches(batches):
    def work(column, cv, job, cat, sen):
        tenth, sure, matched, required, sem, pairs = score_cells(cv, job, cat, sen)
        a, b = len(tenth), len(sem)
        no = lambda n: np.zeros(n)
        first, last = np.r_[np.zeros(a, bool), np.ones(b, bool)], np.r_[np.ones(a, bool), np.zeros(b, bool)]
        null_sem = np.full(b, B.semantic_kind(cv, job) == B.NO_SCORE)
        return _batch({
            "tenth": pa.array(np.r_[tenth, no(b)].astype(np.int64), mask=first), "cat": pa.array(np.full(a + b, cat)),
            "sen": pa.array(np.full(a + b, sen)), "n_matched": pa.array(np.r_[no(a), matched].astype(np.int32), mask=last),
            "n_required": pa.array(np.r_[no(a), required].astype(np.int32), mask=last),
            "sem": pa.array(np.r_[no(a), sem], mask=np.r_[np.ones(a, bool), null_sem]), "pairs": pa.array(np.r_[sure, pairs].astype(np.int64))})
    return B.each_cell(batches, work)


def score_counts(cvs: DataFrame, jobs: DataFrame, bypass: bool = True) -> DataFrame:
    """match_score, pairs (scores may repeat): all candidate pairs."""
    cvb, jobb, cells = _blocks(cvs, jobs, bypass)
    rows = B._met_blocks(cells, cvb, jobb, [], []).mapInArrow(
        _score_batches, "tenth long, cat double, sen double, n_matched int, n_required int, sem double, pairs long")
    exact = S.match_score(S.combined_score(F.col("cat"), S.skill_score(F.col("n_matched"), F.col("n_required")), F.col("sen"), F.col("sem")))
    return rows.select(F.when(F.col("tenth").isNotNull(), F.col("tenth") / F.lit(10.0)).otherwise(exact).alias("match_score"), "pairs")


# -- semantic scores ----------------------------------------------------------

def semantic_cells(cv: B.Side, job: B.Side) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) semantic score of each CV of a block with the jobs of another; NaN counts as the largest."""
    if B.semantic_kind(cv, job) != B.COSINE:
        return np.zeros(cv.n), np.zeros(cv.n)
    cos = cv.unit @ job.unit.T
    odd, near, out = np.isnan(cos), SEM_NEAR / 100.0, []
    low, high = np.where(odd, np.inf, cos), np.where(odd, -np.inf, cos)
    for close, pick in ((low <= low.min(axis=1, keepdims=True) + near, np.minimum), (high >= high.max(axis=1, keepdims=True) - near, np.maximum)):
        i, j = np.nonzero(close | odd)
        sem = B.semantic(cv, job, i, j)
        best = np.full(cv.n, np.inf if pick is np.minimum else -np.inf)
        nan = np.isnan(sem)
        pick.at(best, i[~nan], sem[~nan])
        gone = np.bincount(i[nan], minlength=cv.n)
        best[gone == job.n if pick is np.minimum else gone > 0] = np.nan
        out.append(best)
    return out[0], out[1]


def _semantic_batches(batches):
    def work(column, cv, job, cat, sen):
        least, most = semantic_cells(cv, job)
        gone = np.full(cv.n, B.semantic_kind(cv, job) == B.NO_SCORE)
        return _batch({"cv_id": column("cv_id"), "pairs": pa.array(np.full(cv.n, job.n), pa.int64()),
                       "most": pa.array(most, mask=gone), "least": pa.array(least, mask=gone)})
    return B.each_cell(batches, work)


def semantic_extremes(cvs: DataFrame, jobs: DataFrame, bypass: bool = True) -> DataFrame:
    """cv_id, pairs, most, least: of parts of the candidates of each CV (not rounded; cv_id repeats)."""
    cvb, jobb, cells = _blocks(cvs, jobs, bypass)
    kind = dict(cvs.dtypes)["cv_id"]
    return B._met_blocks(cells, cvb, jobb, ["cv_id"], []).mapInArrow(
        _semantic_batches, f"cv_id {kind}, pairs long, most double, least double")
