"""Dictionaries as tables and the inverted-index overlap: equal to the literal and mask forms."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, SMOKE
from jobsift.operators import classify as C
from jobsift.operators import match as M
from jobsift.operators import overlap as OV
from jobsift.operators import skills as SK
from jobsift.operators import termtable as TT
from jobsift.plans.q_match import scored_inputs
from jobsift.sources.fixtures import EDGE_SKILLS, SKILLS_FX, jobs_fx

ODD = [*EDGE_SKILLS, "The", "THE", "der.", "*** the", "$$", "!! der", "is|", "c++", "+c", ".net", "++", "a", "é", "été froid", "", None]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def terms(spark, entries):
    return spark.createDataFrame([(t,) for t in entries], "term string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_table_equals_literal_hits(spark, limit):
    texts = ["C++ dev, c++x and +c", "+c", "x+c", "a.net .NET x.net", "a++b c++", "++", "x++", "der. der.x *** the,", "the*** the x",
             "a/b testing ci/cd; node.js", "is|x is|", "$$", "x$$y", "", None, "ÉTÉ  froid été froid", "the THE The", "!! der x!! der",
             "natural language processing\nmachine learning"]
    texts += [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = rows(SK.skill_pairs(df, ["k"], "text", [t for t in ODD if t]))
    assert rows(TT.hit_rows(df, ["k"], "text", terms(spark, ODD), max_broadcast_bytes=limit)) == want and len(want) > 60


def test_fifty_thousand_entries(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    made = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(50_000)]
    table = terms(spark, [*made, *SKILLS_FX]).unionByName(
        docs.select(F.explode(F.slice(F.split("text", " "), 1, 20)).alias("term")))
    got = TT.skill_sets(docs, "doc_id", "text", table)
    few = {r.doc_id: {s for s in r.skills if s in SKILLS_FX} for r in got.collect()}
    want = {r.doc_id: set(r.skills) for r in SK.with_skills(docs, "text", SKILLS_FX).collect()}
    assert all(few.get(i, set()) == s for i, s in want.items())
    assert got.where(F.size("skills") > 20).count() > 50
    pairs = SK.skill_pairs(docs, ["doc_id"], "text", table)  # a large table is not read to the driver
    assert pairs.select("doc_id", F.lower("skill")).distinct().count() == got.select(F.sum(F.size("skills"))).first()[0]


def test_keyword_table_equals_literal_form(spark, tmp_path):
    jobs = jobs_fx(spark, SMOKE).select("seq", "job_title", "description_text")
    kw = [("IT", None, "the"), ("IT", "Dev", "of the"), ("IT", "Dev", "engineer"), ("HR", None, "der"), ("HR", "Ops", "der"), ("HR", "Ops", "que"),
          ("Sales", "Field", "los"), ("IT", "Dev", "Engineer"), ("Zed", None, "manager"), ("Zed", "Und", "c++")]
    path = str(tmp_path / "kw.csv")
    spark.createDataFrame([(m, s or "", k) for m, s, k in kw], "main string, sub string, keyword string").write.option("header", True).csv(path)
    got = TT.category_keywords(jobs, "seq", "job_title", "description_text", TT.load_keywords(spark, path))
    want = C.category_keywords(jobs, "seq", "job_title", "description_text", kw).select("seq", "main_category", "sub_category")
    assert rows(got) == rows(want) and got.select("main_category").distinct().count() > 2
    empty = spark.createDataFrame([(1, None, None), (2, "", "")], "seq long, job_title string, description_text string")
    assert {r[1:] for r in rows(TT.category_keywords(empty, "seq", "job_title", "description_text", TT.keyword_table(spark)))} == {("General", "Other")}


@pytest.mark.parametrize(("min_score", "hot"), [(80, 10_000), (100, 3), (1, 20)])
def test_overlap_equals_the_mask_form(spark, monkeypatch, min_score, hot):
    monkeypatch.setattr(OV, "HOT", hot)  # small: hot skills go to many parts
    cvs, jobs = scored_inputs(spark, SMALL)
    cvs = cvs.where("cv_id < 90")
    pairs = M.all_pair_scores(cvs, jobs, SKILLS_FX)
    want = pairs.where(F.col("n_matched") * 100 >= min_score * F.col("job_nreq")).where("job_nreq > 0").select(
        "cv_id", "seq", "n_matched", F.col("job_nreq").alias("n_required"), "score_skills")
    got = OV.overlap_pairs(cvs, jobs, min_score)
    assert rows(got) == rows(want) and got.count() > 100


def test_overlap_edges(spark):
    cvs = spark.createDataFrame([(1, "IT", ["A", "b"]), (2, "Other", ["c"]), (3, None, ["a"]), (4, "IT", None), (5, "IT", [])],
                                "cv_id long, main_category string, skills array<string>")
    jobs = spark.createDataFrame([(1, "IT", ["a", "B", "b"]), (2, "IT", []), (3, None, ["C"]), (4, "HR", ["c", "d"]), (5, "IT", None)],
                                 "seq long, main_category string, skills array<string>")
    assert rows(OV.overlap_pairs(cvs, jobs, 50)) == [(1, 1, 2, 2, 100.0), (2, 3, 1, 1, 100.0), (2, 4, 1, 2, 50.0)]
    assert rows(OV.overlap_pairs(cvs, jobs, 50, bypass=False)) == [(1, 1, 2, 2, 100.0)]
    assert OV.overlap_pairs(cvs.limit(0), jobs).count() == 0
    with pytest.raises(ValueError):
        OV.overlap_pairs(cvs, jobs, 0)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lemmas_of_a_table(spark, limit):
    df = spark.createDataFrame([(1, "Engineers engineer RUNNING tests, a test"), (2, None), (3, ""), (4, "the an it"), (5, "bats saw")],
                               "k long, text string")
    lemmas = spark.createDataFrame([("engineers", "engineer", "NOUN"), ("running", "run", "VERB"), ("tests", "test", None),
                                    ("saw", "see", "VERB"), ("saw", "saw", "NOUN"), (None, "x", None), ("bats", "bat", "ADJ")],
                                   "surface string, lemma string, pos string")
    stop = spark.createDataFrame([("the",), ("bat",), (None,)], "word string")
    got = {r.k: list(r.keywords) for r in TT.lemma_keywords(df, "k", "text", lemmas, stop, max_broadcast_bytes=limit).collect()}
    assert got == {1: ["engineer", "test"], 2: [], 3: [], 4: [], 5: ["saw"]}


def test_overlap_keeps_skill_sets_in_their_blocks(spark):
    """No exchange of a pair carries a set of skills: pairs are counted inside the blocks."""
    names = [f"s{i}" for i in range(40)]
    cvs = spark.createDataFrame([(i, "IT", names[i % 5:]) for i in range(30)], "cv_id long, main_category string, skills array<string>")
    jobs = spark.createDataFrame([(i, "IT", names[i % 7:i % 7 + 6]) for i in range(50)], "seq long, main_category string, skills array<string>")
    got = OV.overlap_pairs(cvs, jobs, 60)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and got.count() == sum(
        10 * len(set(names[a:]) & set(names[b:b + 6])) >= 36 for a in [i % 5 for i in range(30)] for b in [i % 7 for i in range(50)])
