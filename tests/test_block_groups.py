"""Blocks of jobs in groups: what is shuffled and kept, equal results with small groups, overlaps by arrays."""

import os

import numpy as np
import pyarrow as pa
import pytest

from jobsift.operators import blockmatch as B
from jobsift.operators import match as M
from jobsift.operators import overlap as OV
from jobsift.sources import sinks
from test_blockmatch import CV, JOB, job, view


def inputs(spark):
    v = [[0.5, -0.25, 1.0], [1.0, 0.5, 0.25], [-1.0, 0.5, 2.0], [0.0, 0.0, 0.0], None]
    skills = [["a"], ["a", "b"], ["b", "c", None], [], None]
    jobs = [job(i, f"u{i % 11}", ["IT", "HR"][i % 2], "x", "junior", v[i % 5], skills[i % 3]) for i in range(80)]
    cvs = [(i, ["IT", "HR", "Other"][i % 3], "x", "junior", v[i % 5], skills[i % 5]) for i in range(24)]
    return spark.createDataFrame(cvs, CV), spark.createDataFrame(jobs, JOB)


def test_a_cv_block_goes_to_a_group_of_jobs_once(spark, monkeypatch):
    monkeypatch.setattr(B, "JOB_BLOCK", 4)
    monkeypatch.setattr(B, "CV_BLOCK", 6)
    cvs, jobs = inputs(spark)
    cvb = sinks.scratch_table(B.cv_blocks(sinks.scratch_table(B.prepare_cvs(cvs, True))))
    jobb = sinks.scratch_table(B.job_blocks(sinks.scratch_table(B.prepare_jobs(jobs))))
    cells = sinks.scratch_table(B.all_cells(cvb, jobb))
    met = B._met_blocks(cells, cvb, jobb, [], []).cache()
    n_cv, n_cells = cvb.count(), cells.count()
    with_cells = met.where("cells is not null")
    assert sum(r.n for r in with_cells.selectExpr("size(cells) n").collect()) == n_cells > 4 * n_cv
    assert with_cells.count() <= n_cv * 2 and met.where("cells is null").count() == jobb.count()


@pytest.mark.parametrize("group", [1, 600])
def test_small_groups_and_slices_give_the_pairwise_rows(spark, monkeypatch, group):
    for name, n in (("JOB_BLOCK", 9), ("CV_BLOCK", 3), ("GROUP_BYTES", group), ("LEAST_PAIRS", 40), ("MOST_PAIRS", 40)):
        monkeypatch.setattr(B, name, n)
    cvs, jobs = inputs(spark)
    jobs = jobs.where("seq % 3 < 2")  # without null skills, which have no place in a dictionary
    assert view(B.match_topk(cvs, jobs, 5)) == view(M.match_topk(cvs, jobs, ["a", "b", "c"], 5))


def test_matching_keeps_only_what_its_result_reads(spark, monkeypatch):
    made = []
    path = sinks.checkpoint_path
    monkeypatch.setattr(sinks, "checkpoint_path", lambda s, name: made.append(path(s, name)) or made[-1])
    top = B.match_topk(*inputs(spark), 5)
    left = [os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.exists(p)]
    assert top.count() > 100 and "match-top" in left and not {"match-pairs", "match-cells", "match-jobs", "match-cvs"} & set(left)


def test_overlap_counts_as_sets_do(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + [None]
    share = np.r_[np.full(5, 0.6), np.full(55, 0.04), 0.1]

    def sets(n):
        return [[w for w, p in zip(words, share, strict=True) if rng.random() < p] for _ in range(n)]

    def side(rows):
        names = pa.array(rows, pa.list_(pa.string()))
        t = pa.table({"vec": pa.nulls(len(rows), pa.list_(pa.float32())), "nrm": pa.nulls(len(rows), pa.float64()), "names": names,
                      "dim": pa.array([0] * len(rows), pa.int32()), "id": pa.array(range(len(rows)))})
        packed, = B._pack_batches(["dim"], ["id"])(iter(t.to_batches()))
        return B._side(lambda c: packed.column(c)[0])

    a, b = sets(31), sets(47)
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    for dense, step, at_once in ((256, 4_000_000, 512), (10, 7, 2), (1, 50, 3)):
        monkeypatch.setattr(B, "DENSE", dense)
        monkeypatch.setattr(B, "STEP", step)
        monkeypatch.setattr(B, "AT_ONCE", at_once)
        assert B.overlap(side(a), side(b)).tolist() == want
    assert B.overlap(side([[]] * 3), side(b)).tolist() == np.zeros((3, 47)).tolist()


def test_the_pairs_of_one_category_are_dealt_to_many_tasks(spark, monkeypatch):
    """One block of jobs that meets many CV blocks is not one task."""
    monkeypatch.setattr(B, "LEAST_PAIRS", 64)
    monkeypatch.setattr(OV, "CV_BLOCK", 2)
    jobs = spark.createDataFrame([(i, "IT", [f"s{i % 7}", "t"]) for i in range(16)], "seq long, main_category string, skills array<string>")
    cvs = spark.createDataFrame([(i, "IT", ["t", f"s{i % 7}"]) for i in range(64)], "cv_id long, main_category string, skills array<string>")
    got = OV.overlap_pairs(cvs, jobs, 100)
    assert sorted((r.cv_id, r.seq) for r in got.collect()) == sorted((c, j) for c in range(64) for j in range(16) if c % 7 == j % 7)
    assert len([n for n in got.rdd.glom().map(len).collect() if n]) > 1
