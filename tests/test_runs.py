"""Observed counts and batch totals."""

import random

import pytest
from pyspark.sql import functions as F

from jobsift.operators import classify as C
from jobsift.sources import sinks


def test_counts_come_from_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id"))).repartition(5)
    got = sinks.write_counted(df, str(tmp_path / "t"), missing=F.count_if(F.col("x").isNull()), top=F.max("id"))
    assert got == {"rows": 1000, "missing": 100, "top": 999}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
    none = sinks.write_counted(df.limit(0), str(tmp_path / "none"), top=F.max("id"))
    assert none == {"rows": 0, "top": None}


def test_totals_of_batches(spark):
    rows = [(0, 50, "abcde"), (1, 50, ""), (2, 7, None)]
    df = spark.createDataFrame(rows, "chunk long, n_jobs long, prompt string")
    got = sorted(map(tuple, C.batch_totals(df).collect()), key=repr)
    assert got == [(0, 1, 50, 5, 2), (1, 1, 50, 0, 0), (2, 1, 7, 0, 0), (None, 3, 107, 5, 2)]
    assert C.batch_totals(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["clumped", "sparse", "dense", "huge"])
def test_ranges_are_even_for_any_values(spark, kind):
    rng = random.Random(3)
    n = 20_000
    values = {"clumped": [rng.randrange(10**15) if i % 50 == 0 else 10**9 + i for i in range(n)],
              "sparse": [int(rng.random() ** 9 * 2**62) * 3 + i for i in range(n)],
              "dense": list(range(n)), "huge": [2**63 - 1 - 2 * i for i in range(n)]}[kind]
    values = [min(v, 2**63 - 1) for v in dict.fromkeys(values)]
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(v,) for v in rng.sample(values, len(values))], "seq long")
    sizes = [r["count"] for r in df.groupBy(C.quantile_range(df, "seq", 64).alias("b")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2.5 * len(values) / 64
    got = C.global_row_number(df).collect()
    place = {v: i + 1 for i, v in enumerate(sorted(values))}
    assert len(got) == len(values) and all(r.row_number == place[r.seq] for r in got)


def test_numbering_of_none_and_one(spark):
    df = spark.createDataFrame([(5,)], "seq long")
    assert [tuple(r) for r in C.global_row_number(df).collect()] == [(5, 1)]
    assert C.global_row_number(df.limit(0)).count() == 0
