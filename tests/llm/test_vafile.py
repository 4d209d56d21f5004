"""op12: against brute force, with ties, copies, bad vectors and both ways to meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.llm import q_vafile, vafile
from llm_helpers import SMOKE
from tools.oracle_compare import compare, duck

SCHEMA = "vec_id long, embedding array<double>, label int, c string, q string, block string, score string"


def brute(rows, every=50, k=5):
    ok = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q is None or q % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c is None, c or 0)
                      for j, (c, w) in enumerate(ok) if j != at and len(w) == len(v))
        out += [(q, r + 1, None if no else c, -s) for r, (s, no, c) in enumerate(near[:k])]
    return sorted(out, key=repr)


def found(spark, rows, every=50, k=5):
    df = spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], SCHEMA)
    df = df.select("*", vafile.scaled(F.col("embedding")).alias("vec"), (F.col("vec_id") % every == 0).alias("is_query"))
    return sorted(map(tuple, vafile.top_k(df, k).collect()), key=repr)


def test_copies_ties_and_bad_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(5)]) for i in range(300)]  # many ties
    rows += [(1000 + i, [0.25] * 5) for i in range(120)]              # a large group of copies, queries among them
    rows += [(50, [0.25] * 5), (50, [0.25] * 5), (100, [0.1] * 5)]    # repeated ids, with and without the same vector
    rows += [(None, [0.3] * 5), (None, [0.3] * 5)]
    rows += [(2000, None), (2050, []), (2100, []), (2150, [None] * 5), (2200, [float("nan")] * 5),
             (2250, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2300, [0.5, 0.5]), (2301, [0.25, -1.0]), (2350, [1.0] * 3)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_blocks_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(vafile, "BLOCK", 64)
    monkeypatch.setattr(vafile, "QUERIES", 8)
    monkeypatch.setattr(vafile, "LIMIT", limit)  # 0: a join on the block
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (500, 17)))]
    assert found(spark, rows, every=10, k=3) == brute(rows, 10, 3)


def test_cells_hold_their_values():
    x = np.random.default_rng(1).integers(-300, 300, (1000, 7)).astype(float)
    x[:, 3] = 4.0  # one value only
    codes, lo, hi = vafile.cells(x)
    at = np.arange(7)
    assert (lo[at, codes] <= x).all() and (x <= hi[at, codes]).all()
    assert np.bincount(codes[:, 0]).max() < 20


def test_few_vectors_are_read(spark, monkeypatch):
    """The bounds leave out most pairs before any exact vector is read."""
    read = []
    exact = vafile._exact
    monkeypatch.setattr(vafile, "_exact", lambda pairs, classes: read.append(pairs.count()) or exact(pairs, classes))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    n = vafile.top_k(rows.select("vec_id", vafile.scaled(F.col("embedding")).alias("vec"),
                                 (F.col("vec_id") % 50 == 0).alias("is_query"))).count()
    queries, everyone = rows.where("vec_id % 50 = 0").count(), rows.count()
    assert n == 5 * queries and sum(read) < 0.05 * queries * everyone


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5])]) == [] and found(spark, [(50, [0.5])]) == []


def test_query_against_sql(spark):
    res = compare(spark, duck(SMOKE), SMOKE, "op12", q_vafile.op12_exact_topk, q_vafile.ORACLE)
    assert res["status"] == "match" and "types" not in res, res
