"""Distributions by blocks: equal to aggregates over all pairs, edge rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from jobsift.operators import blockmatch as B
from jobsift.operators import match as M
from jobsift.operators import pairstats as PS
from jobsift.plans.q_match import scored_inputs
from jobsift.sources.fixtures import SKILLS_FX
from test_blockmatch import CV, JOB, job


def view(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN equals NaN


def edge_inputs(spark):
    v, nan = [0.5, -0.25, 1.0], [float("nan"), 1.0, 1.0]
    jobs = [job(i // 2, f"u{i % 7}", ["IT", "HR", None][i % 3], ["x", "y", None][i % 4 % 3], ["Lead", "junior", None, "boss"][i % 4],
                [v, None, [0.0, 0.0, 0.0], [1.0, 2.0], [], [-1.0, -0.5, -0.25], [None, 1.0, 2.0], nan][i % 8], [[], None, ["a", "B", "b"], ["a", "b", "c", "d"]][i % 5 % 4])
            for i in range(90)]
    cvs = [(i // 2 or None, ["IT", "HR", "Other", None, "None such"][i % 5], ["x", "y"][i % 2], ["junior", "senior", "Lead", None][i % 4],
            [v, None, [-0.5, 0.25, -1.0], [3.0, 1.0], [1.0, None, 2.0]][i % 7 % 5], [["a", "C"], [], None, ["d"]][i % 3]) for i in range(25)]
    return spark.createDataFrame(cvs, CV), spark.createDataFrame(jobs, JOB)


@pytest.mark.parametrize("edges", [False, True])
def test_equal_to_aggregates_over_all_pairs(spark, monkeypatch, edges):
    if edges:
        monkeypatch.setattr(B, "JOB_BLOCK", 5)
        monkeypatch.setattr(B, "CV_BLOCK", 3)
        monkeypatch.setattr(PS, "SET_BLOCK", 2)
    cvs, jobs = edge_inputs(spark) if edges else (t.cache() for t in scored_inputs(spark, SMALL))
    pairs = M.all_pair_scores(cvs, jobs, ["a", "b", "c", "d"] if edges else SKILLS_FX).cache()
    n = F.count(F.lit(1)).alias("pairs")
    total = F.sum("pairs").alias("pairs")
    want = pairs.groupBy("n_matched", "job_nreq").agg(n)
    assert view(PS.skill_counts(cvs, jobs).groupBy("n_matched", "n_required").agg(total)) == view(want)
    assert view(PS.score_counts(cvs, jobs).groupBy("match_score").agg(total)) == view(pairs.groupBy("match_score").agg(n))
    want = pairs.groupBy("cv_id").agg(n, F.max("score_semantic"), F.min("score_semantic"))
    got = PS.semantic_extremes(cvs, jobs).groupBy("cv_id").agg(total, F.round(F.max("most"), 1), F.round(F.min("least"), 1))
    assert view(got) == view(want)


def test_scores_at_rounding_edges(spark):
    """Scores that end in 5 hundredths are rounded as the expressions do; scores below 0 count as 0."""
    jobs = spark.createDataFrame([job(i, f"u{i}", "HR" if i % 2 else "IT", "x", "lead", [1.0, 0.0], [f"s{x}" for x in range(i % 9)]) for i in range(40)], JOB)
    cvs = spark.createDataFrame([(i, "Other" if i % 2 else "IT", "x", "intern", [[1.0, 0.0], [-1.0, 0.0], [0.6, 0.8], [-0.02, 1.0]][i % 4],
                                  [f"s{x}" for x in range(i % 5)]) for i in range(12)], CV)
    pairs = M.all_pair_scores(cvs, jobs, [f"s{x}" for x in range(9)])
    got = PS.score_counts(cvs, jobs).groupBy("match_score").agg(F.sum("pairs").alias("pairs"))
    assert view(got) == view(pairs.groupBy("match_score").agg(F.count(F.lit(1)).alias("pairs")))
    assert PS.score_counts(cvs.limit(0), jobs).count() == 0
