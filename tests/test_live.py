"""Maintained live table and skill pairs: equal to the full rebuild after any batches."""

import random

import pytest

from pyspark.sql import functions as F

from jobsift.operators.dedup import dedup_latest
from jobsift.operators.skills import skill_pairs
from jobsift.streaming import live

SKILLS = ["spark", "sql", "Java", "java", "data lake"]
SCHEMA = "seq long, url string, description_text string, job_title string"
TEXTS = ["spark and sql", "Java", "sql; data lake", "nothing", None, "", "spark"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, base, everything):
    want = dedup_latest(everything.dropDuplicates(["seq"]))
    assert rows(live.live_jobs(spark, base).select("seq", "url", "description_text", "job_title")) == rows(want)
    pairs = skill_pairs(want, ["url"], "description_text", SKILLS).distinct()
    assert rows(live.read_skills(spark, base)) == rows(pairs)


@pytest.mark.parametrize("compact_every", [0, 2])
def test_random_batches_equal_the_rebuild(spark, tmp_path, compact_every):
    rng = random.Random(compact_every)
    base, seen = str(tmp_path / "live"), []
    for epoch in range(5):
        batch = [(rng.randrange(60), 0, 0, 0) for _ in range(14)]  # late, new and repeated rows
        batch = [(s, f"u{s * 7 % 11}" if s % 13 else None, TEXTS[s * 5 % 17 % 7], f"t{s}") for s, *_ in batch]
        seen += batch
        df = spark.createDataFrame(batch, SCHEMA)
        live.apply_batch(spark, base, df, epoch, SKILLS, compact_every)
        if epoch == 3:  # a retried epoch replaces its own output
            live.apply_batch(spark, base, df, epoch, SKILLS, compact_every)
        if epoch % 2 == 0:
            check(spark, base, spark.createDataFrame(seen, SCHEMA))


def test_hidden_row_comes_back(spark, tmp_path):
    base = str(tmp_path / "live")
    nights = [[(1, "a", "spark and sql", "x")], [(2, "b", "spark and sql", "x")], [(3, "b", "Java", "x")], [(0, "b", "sql", "late")], []]
    got = []
    for epoch, batch in enumerate(nights):
        live.apply_batch(spark, base, spark.createDataFrame(batch, SCHEMA), epoch, SKILLS, 0)
        got.append(sorted(r.seq for r in live.live_jobs(spark, base).collect()))
    assert got == [[1], [2], [1, 3], [1, 3], [1, 3]]
    log = spark.read.schema(live.PAIRS + ", epoch int").parquet(f"{base}/skills")
    assert log.where("epoch = 3").count() == 0 and log.where("epoch = 1").count() == 4  # only what moved is written
    assert rows(live.read_skills(spark, base)) == [("a", "spark"), ("a", "sql"), ("b", "Java"), ("b", "java")]


def test_no_task_of_the_stream_source_reads_all_days(spark, monkeypatch):
    """The files of the stream, of days delivered twice too, come from several tasks."""
    from conftest import SMOKE
    from jobsift.plans import q_live
    parts = []

    def run(spark, source, *a, **kw):
        files = spark.read.parquet(source).select("search_date", F.input_file_name().alias("f")).distinct()
        parts.append(files.groupBy("search_date").count().agg(F.max("count")).first()[0])
        raise StopIteration
    monkeypatch.setattr(q_live.live, "run_stream", run)
    with pytest.raises(StopIteration):
        q_live.q_stream_live(spark, SMOKE)
    assert parts[0] > 3  # one file a day and one of the second delivery before
