"""Windows that no entry equals are dropped before the join to a large dictionary."""

import pytest
from pyspark.sql import functions as F

from jobsift.operators import termtable as TT


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_windows_without_an_entry_go_first(spark, monkeypatch, most):
    monkeypatch.setattr(TT, "MAX_BITS", most)
    entries = spark.range(4000).select(F.concat(F.lit("e"), F.col("id") * 3).alias("gram"))
    cand = spark.range(12000).select("id", F.col("id").alias("block"), F.concat(F.lit("e"), F.col("id")).alias("gram"))
    cand = cand.union(cand.limit(10)).union(spark.createDataFrame([(-1, -1, None)], "id long, block long, gram string"))
    kept = TT.possible(cand, entries)
    assert kept.columns == cand.columns
    assert kept.join(entries, "gram").count() == cand.join(entries, "gram").count() == 4000 + cand.limit(10).join(entries, "gram").count()
    assert kept.count() < 4004 + 8007 * 0.2


def test_join_is_dealt_by_the_windows_left(spark):
    docs = spark.range(50).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), F.col("id")) for j in range(40)]).alias("text"))
    terms = spark.createDataFrame([("w3x7",), ("W5x9 w6x9",), ("w39x49",), ("none",)], "term string")
    got = TT.hit_rows(docs, ["id"], "text", terms, max_broadcast_bytes=0)
    assert {(r.id, r.entry) for r in got.collect()} == {(7, "w3x7"), (9, "W5x9 w6x9"), (49, "w39x49")}
    assert "getbit" in got._jdf.queryExecution().optimizedPlan().toString()
    assert TT.hit_rows(docs, ["id"], "text", terms.limit(0), max_broadcast_bytes=0).count() == 0
