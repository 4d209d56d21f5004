"""Blocked matching: equal to the pair-wise form, work below all pairs, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from jobsift.operators import blockmatch as B
from jobsift.operators import match as M
from jobsift.plans.q_match import scored_inputs
from jobsift.sources.fixtures import SKILLS_FX

JOB = ("seq long, url string, job_title string, company_name string, location string, search_date date, description_text string, "
       "main_category string, sub_category string, level string, bert_vector array<float>, skills array<string>")
CV = "cv_id long, main_category string, sub_category string, level string, vector array<float>, skills array<string>"


def view(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def job(seq, url, main, sub, level, vec, skills):
    return (seq, url, "t", "c", "l", None, f"d{seq}", main, sub, level, vec, skills)


@pytest.mark.parametrize("k", [3, 50])
def test_equals_the_pairwise_form(spark, k):
    cvs, jobs = scored_inputs(spark, SMALL)
    assert view(B.match_topk(cvs, jobs, k)) == view(M.match_topk(cvs, jobs, SKILLS_FX, k))


def test_edges_equal_the_pairwise_form(spark, monkeypatch):
    monkeypatch.setattr(B, "JOB_BLOCK", 5)
    monkeypatch.setattr(B, "CV_BLOCK", 2)
    terms = ["a", "b", "c", "d", "e"]
    v = [0.5, -0.25, 1.0]
    jobs = [job(i, f"u{i % 7}", ["IT", "HR", None][i % 3], ["x", "y", None][i % 4 % 3], ["Lead", "junior", None, "boss"][i % 4],
                [v, None, [0.0, 0.0, 0.0], [1.0, 2.0], [], [-1.0, -0.5, -0.25]][i % 6], [[], None, ["a", "B", "b"], terms][i % 5 % 4])
            for i in range(90)]
    jobs += [job(1000 + i, "same", "IT", "x", "junior", v, ["a", "b"]) for i in range(40)]  # copies: ties by seq
    cvs = [(i, ["IT", "HR", "Other", None, "None such"][i % 5], ["x", "y"][i % 2], ["junior", "senior", "Lead", None][i % 4],
            [v, None, [-0.5, 0.25, -1.0], [3.0, 1.0]][i % 7 % 4], [["a", "C"], [], None, ["e", "d"]][i % 3]) for i in range(25)]
    cvs, jobs = spark.createDataFrame(cvs, CV), spark.createDataFrame(jobs, JOB)
    for bypass in (True, False):
        for k in (1, 4, 200):
            assert view(B.match_topk(cvs, jobs, k, bypass)) == view(M.match_topk(cvs, jobs, terms, k, bypass))
    assert B.match_topk(cvs.limit(0), jobs).count() == 0 and B.match_topk(cvs, jobs.limit(0)).count() == 0
    assert B.match_work(cvs.limit(0), jobs).count() == 1


def test_bounds_leave_out_most_pairs(spark, monkeypatch):
    """Many jobs a category and few results: blocks under the threshold are never read."""
    monkeypatch.setattr(B, "JOB_BLOCK", 50)
    rng = np.random.default_rng(2)
    levels, skills = ["intern", "junior", "senior", "lead"], [f"s{i}" for i in range(30)]
    some = lambda n: [str(s) for s in rng.choice(skills, n, replace=False)]
    unit = lambda: [float(x) for x in rng.normal(size=16)]
    jobs = [job(i, f"u{i}", "IT", f"sub{i % 5}", levels[i // 5 % 4], unit(), some(1 + i % 12)) for i in range(6000)]
    cvs = [(i, "IT", f"sub{i % 5}", levels[i // 5 % 4], unit(), some(6)) for i in range(40)]
    cvs, jobs = spark.createDataFrame(cvs, CV).cache(), spark.createDataFrame(jobs, JOB).cache()
    work = B.match_work(cvs, jobs, 5).first()
    assert work.candidate_pairs == 240_000 and work.scored_pairs < 0.35 * work.candidate_pairs
    assert view(B.match_topk(cvs, jobs, 5)) == view(M.match_topk(cvs, jobs, skills, 5))


def test_large_sides_go_by_blocks(spark):
    """Beyond the broadcast bound on both sides ``match_topk`` takes the blocked form."""
    cvs, jobs = scored_inputs(spark, SMALL)
    cvs = cvs.where("cv_id < 60")
    assert view(M.match_topk(cvs, jobs, SKILLS_FX, 7, max_broadcast_bytes=0)) == view(M.match_topk(cvs, jobs, SKILLS_FX, 7))


def test_ties_of_a_block_keep_the_first_k():
    raw = np.array([5.0, 7.0, 7.0, 5.0, 7.0, 6.95, 1.0])
    assert B.best_of(raw, float("-inf"), 2).tolist() == [1, 2, 5]
    assert B.best_of(raw, 8.0, 2).tolist() == []
    assert B.best_of(np.zeros(0), 0.0, 2).tolist() == []


def test_many_pairs_go_by_blocks(spark, monkeypatch):
    """Also with both sides small; repeated and null ids and vectors with a NULL element come out as pair by pair."""
    v = [0.5, -0.25, 1.0]
    jobs = [job(i // 2 if i % 9 else None, f"u{i % 7}", ["IT", "HR"][i % 2], "x", "junior", [v, [None, 1.0, 2.0], None][i % 3], ["a", "b"][:i % 3])
            for i in range(30)]
    cvs = [(i // 2 if i else None, ["IT", "Other"][i % 2], "x", "junior", [v, [1.0, None, 0.5], [2.0, 1.0, 0.0]][i % 3], ["a"]) for i in range(8)]
    cvs, jobs = spark.createDataFrame(cvs, CV), spark.createDataFrame(jobs, JOB)
    want = view(M.match_topk(cvs, jobs, ["a", "b"], 200))
    monkeypatch.setattr(M, "MAX_PAIRS", 10)
    called = []
    blocks = B.match_topk
    monkeypatch.setattr(B, "match_topk", lambda *a: called.append(1) or blocks(*a))
    assert view(M.match_topk(cvs, jobs, ["a", "b"], 200)) == want and called and len(want) > 100


def test_repeated_ids_take_the_skills_of_each_of_their_rows(spark):
    """``match_topk`` of this module joins skills by id: two rows of a CV give each result twice."""
    jobs = spark.createDataFrame([job(1, "u1", "IT", "x", "junior", [1.0], ["a", "b"])], JOB)
    cvs = spark.createDataFrame([(1, "IT", "x", "junior", [1.0], ["a"])] * 2, CV)
    assert B.match_topk(cvs, jobs, 5).count() == 4 and M.match_topk(cvs, jobs, ["a", "b"], 5).count() == 2
